"""Queries of the alignment, similarity and repair operators. SQL has no matching blocks, so most are tested on fixtures instead."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandloom.functions import similarity, text
from strandloom.operators import align
from strandloom.plans.registry import query
from strandloom.plans.tables import spread, table


@query()
def token_alignment_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn, edited, against the turns within two positions: what it uses of them."""
    near = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-2, 2)
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", F.collect_list("turn").over(near).alias("ids"), F.collect_list("text").over(near).alias("texts"))
    final = F.regexp_replace(F.lower("text"), "[.,]", "")
    return spread(c).select("conv_id", "turn", align.source_spans_udf(final, "ids", "texts").alias("a")).select("conv_id", "turn", "a.status", F.round("a.coverage", 6).alias("coverage"), F.size("a.spans").cast("long").alias("n_spans"))


@query()
def monotone_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation's turns against an edited copy: some turns gone, words replaced."""
    c = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("id"), (F.col("turn") * 10.0).alias("at"), "text")
    c = spread(c, "conv_id")
    gold = c.where("id % 5 <> 3").withColumns({"at": F.col("at") + 2.0, "text": F.replace("text", F.lit(" the "), F.lit(" "))})
    return align.align_lists(c, gold, "conv_id").withColumn("similarity", F.round("similarity", 4))


@query()
def comparison_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Averages over an alignment."""
    a = monotone_alignment(spark, sf_dir)
    matched = F.col("status") == "matched"
    return a.groupBy("conv_id").agg(F.count_if(matched).alias("n_matched"), F.count_if(~matched).alias("n_alone"), F.round(F.avg("similarity"), 4).alias("mean_similarity"), F.median("time_diff").alias("median_diff"))


@query()
def minimal_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fewest turns of a conversation that support its last turn's first sentence."""
    rows = F.struct("turn", F.lower("text").alias("low"), text.grounding_tokens(F.col("text")).alias("tokens"), "text")
    g = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(rows)).alias("r"))
    claim = F.regexp_extract(F.element_at("r.text", -1), r"^([^.]*)", 1)
    turns = align.support_udf(text.grounding_tokens(claim), "r.turn", "r.low", "r.tokens")
    return g.select("conv_id", turns.alias("turns")).select("conv_id", F.size("turns").cast("long").alias("n"), F.array_join(F.transform("turns", lambda x: x.cast("string")), ",").alias("turns"))


@query()
def edit_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns against an edited copy: what kind of edit it is, how alike both are, and the word operations."""
    c = spread(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")).withColumn("after", F.when(F.col("turn") % 3 == 0, F.replace("text", F.lit(","), F.lit(""))).otherwise(F.replace("text", F.lit(" of "), F.lit(" from "))))
    return c.select("conv_id", "turn", similarity.edit_class_udf("text", "after").alias("kind"), F.round(similarity.ratio_udf("text", "after"), 6).alias("ratio"), F.size(similarity.word_edits_udf("text", "after")).cast("long").alias("n_operations"))


@query()
def similar_name_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of names that look like spellings of one; each name stands with a letter left out too.

    Words that are alike enough share two neighbouring letters, so names meet by those: of the same word of names with as many words, or of the
    whole name from one initial, or of single words.
    """
    p = table(spark, sf_dir, "part").select("p_name").distinct()
    n = p.union(p.select(F.expr("overlay(p_name PLACING '' FROM 4 FOR 1)"))).select(F.col("p_name").alias("a")).distinct()
    pairs_of = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(w) - 1, F.lit(1))), lambda i: F.substring(w, i, F.lit(2)))
    words, squeezed = F.split(F.lower("a"), " "), F.regexp_replace(F.lower("a"), "[^a-z0-9]+", "")
    by_word = F.flatten(F.transform(words, lambda w, i: F.transform(pairs_of(w), lambda g: F.concat_ws("/", F.size(words).cast("string"), i.cast("string"), g))))
    whole = F.transform(pairs_of(squeezed), lambda g: F.concat_ws("/", F.lit("all"), F.substring(squeezed, 1, 1), g))
    keyed = n.select("a", F.explode(F.array_distinct(F.concat(by_word, whole))).alias("k"))
    pairs = keyed.join(keyed.withColumnRenamed("a", "b"), "k").where("a < b").select("a", "b").distinct()
    return pairs.where(similarity.similar_names_udf("a", "b"))


@query()
def shielded_replacement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants replaced in texts and URLs left alone."""
    p = table(spark, sf_dir, "pages").select("page_id", F.concat_ws(" ", F.lit("tionsh and"), "url", F.lit("of Tion Sh")).alias("t"))
    return p.select("page_id", similarity.replace_shielded_udf({"tion sh": "TION"})("t").alias("replaced"))


@query()
def fidelity_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an automatic rewrite of a turn may stand."""
    c = table(spark, sf_dir, "conversations").withColumn("after", F.when(F.col("turn") % 4 == 0, F.substring("text", 1, 40)).otherwise(F.replace("text", F.lit(" of "), F.lit(" from "))))
    return c.select("conv_id", "turn", similarity.fidelity_udf("text", "after").alias("g")).select("conv_id", "turn", "g.passed", "g.reason")


@query()
def span_safe_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A turn patched where a candidate differs in a few words between equal ones."""
    c = table(spark, sf_dir, "conversations").withColumn("candidate", F.regexp_replace("text", r" of (\w+)", " from $1"))
    return c.select("conv_id", "turn", similarity.patched_udf("text", "candidate").alias("p")).select("conv_id", "turn", F.sha2("p.text", 256).alias("patched"), "p.n_spans", "p.n_rejected")


@query()
def recovered_json_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complete objects of answers that were cut off."""
    answer = F.concat(F.lit('{"items": ['), F.col("props"), F.lit(", "), F.col("props"), F.lit(', {"k": '))
    e = table(spark, sf_dir, "events").select("event_id", similarity.recovered_objects_udf(answer).alias("o"))
    return e.select("event_id", F.size("o").cast("long").alias("n"), F.element_at("o", 1).alias("first"))


@query()
def normalised_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of turns in compatibility form, case folded."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", similarity.nfkc_udf("text").alias("t"))
    return c.select("conv_id", "turn", F.size(F.array_distinct(F.regexp_extract_all("t", F.lit(r"((?U)[^\W_]+)"), 1))).cast("long").alias("n_words"))


@query()
def phonetic_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that sound alike: edits between their letters, lengths within one, one clear best.

    Blocked by length; a name's nearest must lead the next by 0.03.
    """
    n = table(spark, sf_dir, "part").select(F.col("p_name").alias("a")).distinct().withColumn("len", F.char_length("a"))
    b = n.select(F.col("a").alias("b"), F.explode(F.array(F.col("len") - 1, F.col("len"), F.col("len") + 1)).alias("len"))
    pairs = n.join(b, "len").where("a <> b").withColumn("r", text.phonetic_ratio(F.col("a"), F.col("b"))).where("r <= 0.28")
    w = Window.partitionBy("a").orderBy("r", "b")
    best = pairs.withColumns({"k": F.row_number().over(w), "nxt": F.lead("r").over(w)})
    return best.where("k = 1 AND (nxt IS NULL OR nxt - r >= 0.03)").select("a", "b", F.round("r", 6).alias("ratio"))
