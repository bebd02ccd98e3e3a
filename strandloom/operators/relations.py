"""Which product belongs to which brand, as a video itself says it: a weighted bipartite graph from text, and names made of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandloom.functions.repairs import clean_name, name_tokens
from strandloom.functions.similarity import ratio_udf
from strandloom.operators.joins import unique_best
from strandloom.operators.mappings import fuzzy_key, mapping_safety
from strandloom.operators.naming import mentions

#: What attributes a product, how far behind its name, what each attribution weighs, and least likeness of a misheard brand and its distance from the next.
OWNED = r"\b(?:created\s+by|made\s+by|built\s+by|developed\s+by|by|from)\s+([A-Z][A-Za-z0-9+#_-]{2,}(?:\s+[A-Z][A-Za-z0-9+#_-]{2,})?)"
REACH, WEIGHT, LIKE, MARGIN = 180, 3, 0.80, 0.08


def _surfaces(name: Column) -> Column:
    """A name, and one of several capitals as the words that it is heard as."""
    apart = F.regexp_replace(name, "(?<=[a-z0-9])(?=[A-Z])", " ")
    return F.array_distinct(F.array(name, F.when(F.size(name_tokens(name)) == 1, apart).otherwise(name)))


def resolved_names(surfaces: DataFrame, names: DataFrame, accepted: DataFrame) -> DataFrame:
    """(video, surface, name): what a surface (video, surface) stands for, by an accepted spelling (video, raw, canonical), as a name (video, name), or, of one word, as the one name that it is like."""
    s = surfaces.select("video", "surface", F.lower("surface").alias("low")).distinct()
    spelt = accepted.select("video", F.lower(clean_name(F.col("raw"))).alias("low"), F.col("canonical").alias("by_spelling")).groupBy("video", "low").agg(F.min("by_spelling").alias("by_spelling"))
    own = names.groupBy("video", F.lower("name").alias("low")).agg(F.min("name").alias("by_name"))
    known = s.join(spelt, ["video", "low"], "left").join(own, ["video", "low"], "left").withColumn("name", F.coalesce("by_spelling", "by_name"))
    open_ = known.where(F.col("name").isNull() & (F.size(name_tokens(F.col("surface"))) == 1)).select("video", "surface", fuzzy_key(F.col("surface")).alias("key"))
    single = names.where(F.size(name_tokens(F.col("name"))) == 1).select("video", "name", fuzzy_key(F.col("name")).alias("nk")).where("nk <> ''").distinct()
    near = open_.withColumn("initial", F.substring("key", 1, 1)).join(single.withColumn("initial", F.substring("nk", 1, 1)), ["video", "initial"])
    near = near.where(F.abs(F.char_length("key") - F.char_length("nk")) <= 3).withColumn("like", ratio_udf("key", "nk")).where(F.col("like") >= LIKE)
    order = Window.partitionBy("video", "surface").orderBy(F.desc("like"), F.desc("name"))
    near = near.withColumn("n", F.row_number().over(order)).withColumn("next", F.lead("like").over(order)).where("n = 1").where(F.col("next").isNull() | (F.col("like") - F.col("next") >= MARGIN))
    return known.where("name IS NOT NULL").select("video", "surface", "name").union(near.select("video", "surface", "name"))


def explicit_relations(texts: DataFrame, names: DataFrame, accepted: DataFrame) -> DataFrame:
    """(video, product, brand, weight): WEIGHT for each time that a product's name is followed, within REACH characters of the video's text, by an attribution to another name.

    texts has (video, pos, text), names (video, name) of strong names, accepted (video, raw, canonical). The texts behind a row count as its continuation. Mere nearness counts nothing.
    A product's name is found within one row.
    """
    forms = names.select("video", "name", F.explode(_surfaces(F.col("name"))).alias("form")).where(F.char_length(fuzzy_key(F.col("name"))) >= 5)
    found = mentions(texts, ["video", "pos"], "text", forms.select("name", "form").distinct()).join(forms, ["video", "name", "form"])
    behind = Window.partitionBy("video").orderBy("pos").rowsBetween(1, REACH)  # each of them holds at least the blank before it
    longer = texts.select("video", "pos", F.concat_ws(" ", "text", F.array_join(F.collect_list(F.coalesce("text", F.lit(""))).over(behind), " ")).alias("on"))
    tail = found.join(longer, ["video", "pos"]).withColumn("brand_said", clean_name(F.regexp_extract(F.substring("on", F.col("end") + 1, F.lit(REACH)), OWNED, 1))).where("brand_said <> ''")
    brands = resolved_names(tail.select("video", F.col("brand_said").alias("surface")), names, accepted)
    told = tail.groupBy("video", F.col("name").alias("product"), F.col("brand_said").alias("surface")).agg((F.count("*") * WEIGHT).alias("weight"))
    met = told.join(brands, ["video", "surface"]).where(F.lower("name") != F.lower("product"))
    return met.groupBy("video", "product", F.col("name").alias("brand")).agg(F.sum("weight").alias("weight"))


def owner(relations: DataFrame) -> DataFrame:
    """(video, product, brand, weight) of products with one brand of greatest weight."""
    return unique_best(relations, ["video", "product"], [F.desc("weight"), F.col("brand")], [F.col("weight")])


def composite_names(phrases: DataFrame, relations: DataFrame, texts: DataFrame, names: DataFrame) -> DataFrame:
    """(video, raw, canonical) for phrases (video, raw) that spell one product, in several words, of one owner: `Brand's Product`, where that is safe to apply."""
    key = lambda k: F.transform(F.filter(F.sequence(F.lit(1), F.size("words")), lambda i: i + k - 1 <= F.size("words")), lambda i: fuzzy_key(F.array_join(F.slice("words", i, F.lit(k)), "")))
    runs = phrases.select("video", "raw", name_tokens(F.col("raw")).alias("words")).where(F.size("words") >= 2).select("video", "raw", F.explode(F.array_distinct(F.concat(key(2), key(3)))).alias("key"))
    technical = names.where("verified").where((F.size(name_tokens(F.col("name"))) == 1) & F.col("name").rlike("^.+[A-Z0-9]|^[A-Z0-9]+$"))
    anchors = technical.select("video", F.col("name").alias("product"), fuzzy_key(F.col("name")).alias("key")).where(F.char_length("key") >= 5)
    one = runs.join(anchors, ["video", "key"]).groupBy("video", "raw").agg(F.count_distinct("product").alias("n"), F.min("product").alias("product")).where("n = 1")
    made = one.join(owner(relations), ["video", "product"]).select("video", "raw", F.concat("brand", F.lit("'s "), "product").alias("canonical"))
    safe = mapping_safety(made, texts, names).where("reason IS NULL")
    return made.join(safe.select("video", "raw", "canonical"), ["video", "raw", "canonical"])
