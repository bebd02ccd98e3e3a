"""Queries of the editorial passes over a video's utterances: repair by evidence, identities, mappings and relations of names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandloom.operators import contracts, editorial, evidence, mappings, naming, relations, ruletable
from strandloom.plans.registry import query
from strandloom.plans.tables import spread, table, utterances

#: Invented: spoken names and their official form.
SPOKEN_NAMES = {"클로드": "Claude", "미드저니": "Midjourney"}


def canonical(text: Column) -> Column:
    """Spoken names in their official form."""
    for spoken, name in SPOKEN_NAMES.items():
        text = F.replace(text, F.lit(spoken), F.lit(name))
    return text


def videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(video, pos, conv_id, turn, ko): ten conversations after one another are a video's utterances."""
    pos = F.expr("conv_id % 10 * 1000 + turn")
    return utterances(spark, sf_dir).select(F.expr("conv_id div 10").alias("video"), pos.alias("pos"), "conv_id", "turn", "ko")


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(video, at, source, priority, text): a video's first utterance as its title, the second as its description, the first of each later conversation as a chapter's label."""
    u = videos(spark, sf_dir).where("pos < 2 OR turn = 0")
    source = F.when(F.col("pos") == 0, "video_title").when(F.col("pos") == 1, "youtube_description").otherwise("creator_chapter_label")
    return u.select("video", F.col("pos").alias("at"), source.alias("source"), F.when(F.col("pos") == 1, 2).otherwise(3).alias("priority"), F.col("ko").alias("text"))


@query()
def evidence_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Misheard words and pairs of words repaired by what the video's metadata and speech support: one row per change."""
    done = evidence.repair_by_evidence(videos(spark, sf_dir), metadata(spark, sf_dir), "video", "pos", "ko", canonical)
    each = done.select("video", "pos", F.sha2("repaired", 256).alias("repaired_sha256"), F.posexplode("changes").alias("nth", "c"))
    return each.select("video", "pos", (F.col("nth") + 1).alias("nth_change"), "c.before", "c.after", "c.distance", F.array_join("c.sources", ",").alias("sources"), "c.seen", "repaired_sha256")


#: Invented: names with what they sound like and what must be near for a mere likeness to count.
NAMES = [
    editorial.Name("Claude", aliases=("Claude",), pronunciations=("클로드",)),
    editorial.Name("Notion", pronunciations=("노션",)),
    editorial.Name("Midjourney", pronunciations=("미드저니",), anchors=("모델", "Sref")),
    editorial.Name("Prompt", category="UI_feature", tier="C", pronunciations=("프롬프트",), anchors=("창", "API")),
]


def display_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(video, at, source, weight, text): as metadata, with weights, and a channel's title that names one person beside a word of the first utterance."""
    given = metadata(spark, sf_dir).select("video", "at", F.when(F.col("source") == "youtube_description", "video_description").otherwise(F.col("source")).alias("source"), F.when(F.col("priority") == 3, 4).otherwise(3).alias("weight"), "text")
    title = given.where("source = 'video_title'")
    channel = title.select("video", F.col("at") - 1, F.lit("channel_title"), F.lit(7), F.concat(F.lit("민지 "), F.regexp_extract("text", "([A-Za-z]+)", 1)))
    return given.union(channel)


@query()
def editorial_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The editorial pass: one row per change of an utterance, with its reason and evidence."""
    done = editorial.edit_videos(videos(spark, sf_dir), display_metadata(spark, sf_dir), "video", "pos", "ko", NAMES)
    each = done.select("video", "pos", F.sha2("edited", 256).alias("edited_sha256"), F.size("near").alias("n_near"), F.posexplode("changes").alias("nth", "c"))
    return each.select("video", "pos", (F.col("nth") + 1).alias("nth_change"), F.col("c.from").alias("from_text"), F.col("c.to").alias("to_text"), "c.reason", "c.evidence", "n_near", "edited_sha256")


def heard_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(video, pos, raw, canonical, text, label): parts as products said in a video of their type, their names in two words and, by key, with a letter lost, changed or added."""
    first, second, by = F.initcap(F.split_part("p_name", F.lit(" "), F.lit(1))), F.split_part("p_name", F.lit(" "), F.lit(2)), F.col("p_partkey") % 5
    lost, changed = F.expr("left(split_part(p_name, ' ', 2), length(split_part(p_name, ' ', 2)) - 1)"), F.overlay(first, F.lit("u"), F.lit(2), F.lit(1))
    raw = F.when(by == 0, F.concat_ws(" ", first, second)).when(by == 1, F.concat_ws(" ", first, lost)).when(by == 2, F.concat_ws(" ", changed, second)).when(by == 3, F.concat(first, F.lit(" "), second, F.lit("s"))).otherwise(F.concat(first, second))
    label = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("About "), first, second)).otherwise(F.col("p_type"))
    return table(spark, sf_dir, "part").select(F.col("p_type").alias("video"), F.col("p_partkey").alias("pos"), raw.alias("raw"), F.concat(first, F.initcap(second)).alias("canonical"), F.concat(F.lit("We have the "), raw, F.lit(" in "), F.lower("p_type")).alias("text"), label.alias("label"))


@query()
def mapping_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proposed spellings of a video's products, right and wrong ones, with what keeps each from being applied."""
    said = heard_parts(spark, sf_dir)
    names = said.select("video", F.col("canonical").alias("name"), F.lit(True).alias("verified")).distinct()
    right = said.select("video", "raw", "canonical")
    wrong = said.select("video", "raw", F.regexp_extract("canonical", "([A-Z][a-z]+)$", 1)).union(said.select("video", F.concat("raw", F.lit(" Pro")), "canonical")).union(said.select("video", "raw", F.concat("canonical", F.lit(" Nimbus"))))
    wrong = wrong.union(said.select("video", F.concat(F.lit("www."), F.lower("canonical"), F.lit(".com")), "canonical")).union(said.select("video", "raw", F.max("canonical").over(Window.partitionBy("video"))))
    return mappings.mapping_safety(right.union(wrong), said.select("video", "pos", "text"), names).withColumn("reason", F.coalesce("reason", F.lit("safe")))


@query()
def variant_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases that take a product's name because accepted spellings, and phrases before them that took it, are like them."""
    said = heard_parts(spark, sf_dir)
    names = said.select("video", F.col("canonical").alias("name"), F.lit(True).alias("verified")).distinct()
    accepted = said.where("pos % 3 = 0").select("video", "raw", "canonical").distinct()
    phrases = said.groupBy("video", "raw").agg(F.min("pos").cast("long").alias("nth"))
    return mappings.propagate_families(phrases, accepted, said.select("video", "pos", "text", "label"), names)


def _named(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Turns with what they become, and names (name, form): capitalised words of the turns that occur five times, and those before a lower-case word that occur three times."""
    turns = spread(table(spark, sf_dir, "conversations")).select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    word, pair = (F.regexp_extract_all("text", F.lit(f"(?<![A-Za-z0-9])({p})(?![A-Za-z0-9])"), 1) for p in ("[A-Z][a-z]{2,}", "[A-Z][a-z]{2,} [a-z]{2,}"))
    counted = turns.select(F.explode(F.concat(word, pair)).alias("name")).groupBy("name").agg(F.count("*").alias("n"))
    names = counted.where(F.col("n") >= F.when(F.contains("name", F.lit(" ")), 3).otherwise(5)).select("name", F.col("name").alias("form"))
    # every other turn loses its capitals, the others their words after "The" and "In" and the blanks behind some names
    lost = F.regexp_replace(F.regexp_replace("text", r"(?<![A-Za-z])(The|In) [a-z]+", " "), "(?<![A-Za-z])([A-Z])([a-z]+)(?= die| of| and)", "$1-$2")
    return turns.withColumn("out", F.when(F.col("turn") % 2 == 0, F.lower("text")).otherwise(lost)), names


@query(r"""
WITH t AS (SELECT conv_id, turn, regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9]+|[^A-Za-z0-9]+') AS r FROM conversations),
p AS (SELECT conv_id, turn, r[i] AS w, CASE WHEN i + 2 <= len(r) AND r[i + 1] = ' ' THEN r[i] || ' ' || r[i + 2] END AS two FROM t, unnest(range(1, len(r) + 1)) AS u(i)),
names AS (
  SELECT w AS name FROM p WHERE regexp_matches(w, '^[A-Z][a-z]{2,}$') GROUP BY w HAVING count(*) >= 5
  UNION ALL SELECT two FROM p WHERE regexp_matches(two, '^[A-Z][a-z]{2,} [a-z]{2,}$') GROUP BY two HAVING count(*) >= 3)
SELECT conv_id, turn, name, count(*) AS n_mentions
FROM (SELECT conv_id, turn, lower(w) AS form FROM p UNION ALL SELECT conv_id, turn, lower(two) FROM p WHERE two IS NOT NULL) JOIN names ON lower(name) = form GROUP BY 1, 2, 3
""")
def name_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each turn holds each name of the table's own texts, in any case."""
    turns, names = _named(spark, sf_dir)
    return naming.mentions(turns, ["conv_id", "turn"], "text", names).groupBy("conv_id", "turn", "name").agg(F.count("*").alias("n_mentions"))


@query()
def output_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What rewritten turns lack of their sources' names, and what they leave untranslated: counts by turn and kind."""
    turns, names = _named(spark, sf_dir)
    found = naming.name_issues(turns, ["conv_id", "turn"], "text", "out", names)
    return found.groupBy("conv_id", "turn", "kind").agg(F.count("*").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("what")), ","), 256).alias("what_sha256"))


@query()
def rewrites_around_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns in capitals, with their vowels gone, but for the names in them."""
    turns, names = _named(spark, sf_dir)
    done = naming.rewritten_around_names(turns, ["conv_id", "turn"], "text", names, lambda c: F.upper(F.regexp_replace(c, "[aeiou]", "")))
    return done.select("conv_id", "turn", "rewritten")


@query(r"""
WITH t AS (SELECT conv_id, turn, regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9]+|[^A-Za-z0-9]+') AS r FROM conversations),
p AS (SELECT conv_id, turn, unnest(r) AS w FROM t),
names AS (SELECT w AS name FROM p WHERE regexp_matches(w, '^[A-Z][a-z]{2,}$') GROUP BY w HAVING count(*) >= 5)
SELECT conv_id, turn, name AS rule, count(*)::INTEGER AS n FROM p JOIN names ON w = name GROUP BY 1, 2, 3
""")
def rule_table_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a table of rules changes in the turns: each frequent capitalised word, as a word of its own, gets a mark around it."""
    turns, names = _named(spark, sf_dir)
    single = names.where(~F.contains("name", F.lit(" ")))
    rules = single.select((-F.char_length("name")).alias("nth"), F.col("name").alias("id"), F.col("name").alias("word"), F.lit("<$1>").alias("replacement"), F.lit("high").alias("confidence"))
    done = ruletable.apply_word_rules(turns, ["conv_id", "turn"], rules, "text")
    return done.select("conv_id", "turn", F.explode("changes").alias("c")).select("conv_id", "turn", "c.rule", "c.n")


@query(r"""
WITH p AS (SELECT p_type AS video, upper(split_part(p_name, ' ', 1)[1]) || split_part(p_name, ' ', 1)[2:] || upper(split_part(p_name, ' ', 2)[1]) || split_part(p_name, ' ', 2)[2:] AS product, p_brand AS brand FROM part),
r AS (SELECT video, product, brand, 3 * count(*) AS weight FROM p GROUP BY 1, 2, 3)
SELECT *, weight = max(weight) OVER w AND count(*) OVER (PARTITION BY video, product, weight) = 1 AS is_owner FROM r WINDOW w AS (PARTITION BY video, product)
""")
def product_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as products attributed to their brands in text, in a video of their type: the weights, and each product's one owner."""
    said = heard_parts(spark, sf_dir)
    first = F.regexp_replace("canonical", "(?<=[a-z])(?=[A-Z])", " ")
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pos"), "p_brand")
    texts = said.join(part, "pos").select("video", "pos", F.concat(F.lit("Here "), F.when(F.col("pos") % 2 == 0, F.col("canonical")).otherwise(F.lower(first)), F.lit(" is made by "), "p_brand", F.lit(".")).alias("text"))
    names = said.select("video", F.col("canonical").alias("name")).union(said.join(part, "pos").select("video", "p_brand")).distinct()
    # brands are names that texts attribute nothing to
    rel = relations.explicit_relations(texts, names, said.select("video", "raw", "canonical").limit(0)).where(~F.startswith("product", F.lit("Brand#")))
    own = relations.owner(rel).select("video", "product", "brand", F.lit(True).alias("is_owner"))
    return rel.join(own, ["video", "product", "brand"], "left").withColumn("is_owner", F.coalesce("is_owner", F.lit(False)))


@query()
def segmentation_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers made of each order's lines as sections, with what their columns get wrong: every error with its path."""
    l = table(spark, sf_dir, "lineitem")
    role = F.when(F.col("l_returnflag") == "A", "learning").when(F.col("l_returnflag") == "R", F.when(F.col("l_linenumber") == 1, "promotion").otherwise("other_non_learning")).otherwise(F.when(F.col("l_quantity") < 45, "learning").otherwise("advert"))
    learns = role == "learning"
    part = lambda test, name, value: F.when(test, F.concat(F.lit(f'"{name}": '), value))
    said = F.array_join(F.array_compact(F.array(
        part(F.lit(True), "start_utterance_id", F.when(F.col("l_tax") == 0.08, F.lit('" "')).otherwise(F.format_string('"U%d"', "l_linenumber"))),
        part(F.lit(True), "role", F.concat(F.lit('"'), role, F.lit('"'))),
        part(F.lit(True), "confidence", F.round(F.col("l_discount") * 12, 2).cast("string")),
        part(F.col("l_quantity") > 2, "needs_review", F.when(F.col("l_tax") > 0.07, F.lit('"yes"')).otherwise(F.lit("true"))),
        part(learns | (F.col("l_quantity") > 48), "title", F.lit('"T"')), part(learns, "summary", F.lit('"S"')), part(learns & (F.col("l_discount") > 0.01), "boundary_reason", F.lit('"B"')),
        part(F.col("l_quantity") == 50, "end_seconds", F.lit("5")),
    )), ", ")
    one = F.struct("l_linenumber", F.concat(F.lit("{"), said, F.lit("}")).alias("s"))
    answers = l.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(one)).alias("x"), F.sum("l_linenumber").alias("n"))
    whole = F.concat(F.lit('{"sections": ['), F.array_join(F.transform("x", lambda y: y["s"]), ", "), F.lit("]"), F.when(F.col("n") % 5 == 0, F.lit("}")).otherwise(F.lit(', "warnings": ["w"]}')))
    raw = F.when(F.col("n") % 11 == 0, F.concat(F.lit("```json "), whole, F.lit("```"))).otherwise(whole)
    return answers.select("l_orderkey", F.posexplode(contracts.answer_errors(raw, contracts.SEGMENTATION)).alias("nth", "error"))
