"""Queries of the source contract: which rows count, what a document is, and the ranges and lookups built from its rows.

Conversations stand for videos, their turns for utterances; odd values are made from ids, so that each rule meets rows that break it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandloom.functions import clock
from strandloom.operators import folds, members
from strandloom.plans.registry import query
from strandloom.plans.tables import UTT, table, utterances


@query(f"""
WITH {UTT}, r AS (SELECT conv_id, turn, CASE WHEN turn % 5 = 4 THEN ' ' ELSE ' U' || turn || ' ' END AS id, CASE WHEN (conv_id + turn) % 7 = 3 THEN 'n/a' ELSE start_s::VARCHAR END AS s, end_s::VARCHAR AS e, CASE WHEN turn % 2 = 0 THEN '' ELSE 'C' || chapter END AS ch, CASE WHEN (conv_id + turn) % 6 = 5 THEN '  ' ELSE ko END AS x FROM utt)
SELECT conv_id, trim(id) AS utterance_id, nullif(trim(ch), '') AS chapter_id, try_cast(s AS DOUBLE) AS start_seconds, try_cast(e AS DOUBLE) AS end_seconds, trim(x) AS text FROM r WHERE trim(id) <> '' AND trim(x) <> '' AND try_cast(s AS DOUBLE) IS NOT NULL AND try_cast(e AS DOUBLE) IS NOT NULL
""")
def row_normalisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with an id, a text and times that can be read; blank chapters are none."""
    odd = F.col("conv_id") + F.col("turn")
    u = utterances(spark, sf_dir).select(
        "conv_id",
        F.trim(F.when(F.col("turn") % 5 == 4, " ").otherwise(F.concat(F.lit(" U"), F.col("turn").cast("string"), F.lit(" ")))).alias("utterance_id"),
        F.nullif(F.trim(F.when(F.col("turn") % 2 == 0, "").otherwise(F.concat(F.lit("C"), F.col("chapter").cast("string")))), F.lit("")).alias("chapter_id"),
        F.expr("try_cast(if((conv_id + turn) % 7 = 3, 'n/a', cast(start_s AS STRING)) AS DOUBLE)").alias("start_seconds"),
        F.expr("try_cast(cast(end_s AS STRING) AS DOUBLE)").alias("end_seconds"),
        F.trim(F.when(odd % 6 == 5, "  ").otherwise(F.col("ko"))).alias("text"),
    )
    return u.where("utterance_id <> '' AND text <> '' AND start_seconds IS NOT NULL AND end_seconds IS NOT NULL")


@query(f"""
WITH {UTT}, r AS (SELECT conv_id, turn, CASE WHEN turn % 7 = 6 THEN '' ELSE 'U' || (turn // 2) END AS id, CASE WHEN turn % 5 = 1 THEN 'nan'::DOUBLE WHEN (conv_id + turn) % 9 = 4 THEN -1 ELSE start_s END AS s, CASE WHEN turn % 4 = 3 THEN start_s - 1 ELSE end_s END AS e FROM utt),
v AS (SELECT *, id <> '' AND NOT isnan(s) AND s >= 0 AND e >= 0 AND e >= s AS ok FROM r), n AS (SELECT *, CASE WHEN ok THEN row_number() OVER (PARTITION BY conv_id, id, ok ORDER BY turn) END AS nth FROM v)
SELECT conv_id, turn, CASE WHEN NOT ok THEN 'ignored_utterance_without_valid_id_or_timestamp' WHEN nth > 1 THEN 'ignored_duplicate_utterance_id:' || id ELSE 'valid' END AS outcome,
 CASE WHEN nth = 1 THEN row_number() OVER (PARTITION BY conv_id, coalesce(nth, 0) = 1 ORDER BY s, e, id) END AS place FROM n
""")
def valid_utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Utterances with an id and finite times in order, the first of each id, with their place by time; and why others are left out."""
    start = F.when(F.col("turn") % 5 == 1, float("nan")).when((F.col("conv_id") + F.col("turn")) % 9 == 4, -1.0).otherwise(F.col("start_s"))
    end = F.when(F.col("turn") % 4 == 3, F.col("start_s") - 1).otherwise(F.col("end_s"))
    u = utterances(spark, sf_dir).select("conv_id", "turn", F.when(F.col("turn") % 7 == 6, "").otherwise(F.concat(F.lit("U"), F.expr("turn div 2").cast("string"))).alias("id"), start.alias("s"), end.alias("e"))
    u = u.withColumn("ok", (F.col("id") != "") & ~F.isnan("s") & (F.col("s") >= 0) & (F.col("e") >= 0) & (F.col("e") >= F.col("s")))
    u = u.withColumn("nth", F.when(F.col("ok"), F.row_number().over(Window.partitionBy("conv_id", "id", "ok").orderBy("turn"))))
    first = F.coalesce(F.col("nth") == 1, F.lit(False))
    outcome = F.when(~F.col("ok"), "ignored_utterance_without_valid_id_or_timestamp").when(F.col("nth") > 1, F.concat(F.lit("ignored_duplicate_utterance_id:"), "id")).otherwise("valid")
    place = F.row_number().over(Window.partitionBy("conv_id", first).orderBy("s", "e", "id"))
    return u.select("conv_id", "turn", outcome.alias("outcome"), F.when(first, place.cast("long")).alias("place"))


@query("""
WITH c AS (SELECT doc_id, [CASE WHEN doc_id % 3 = 0 THEN 'https://example.org/v/' || doc_id END, CASE WHEN doc_id % 3 = 1 THEN '' ELSE 'Title ' || doc_id END, CASE WHEN doc_id % 5 > 0 THEN source END, CASE WHEN n_chars > 0 THEN (n_chars // 10)::VARCHAR END, lang, CASE WHEN quality IS NOT NULL THEN quality::VARCHAR END] AS v FROM documents LEFT JOIN labels USING (doc_id)),
k AS (SELECT doc_id, v, ['source_url', 'title', 'channel_name', 'duration_seconds', 'source_language', 'like_count'] AS names FROM c)
SELECT doc_id, 'video_id=V' || doc_id || coalesce(';' || nullif(array_to_string(list_filter([CASE WHEN coalesce(v[i], '') <> '' THEN names[i] || '=' || v[i] END FOR i IN range(1, 7)], lambda x: x IS NOT NULL), ';'), ''), '') AS contract FROM k
""")
def source_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's source as the fields that it has; empty ones are left out."""
    d = table(spark, sf_dir, "documents").drop("text").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    doc = F.col("doc_id").cast("string")
    optional = {
        "source_url": F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("https://example.org/v/"), doc)),
        "title": F.when(F.col("doc_id") % 3 == 1, "").otherwise(F.concat(F.lit("Title "), doc)),
        "channel_name": F.when(F.col("doc_id") % 5 > 0, F.col("source")),
        "duration_seconds": F.when(F.col("n_chars") > 0, F.expr("cast(n_chars div 10 AS STRING)")),
        "source_language": F.col("lang"),
        "like_count": F.col("quality").cast("string"),
    }
    fields = F.array_compact(F.array(F.concat(F.lit("video_id=V"), doc), *[F.when(v != "", F.concat(F.lit(f"{k}="), v)) for k, v in optional.items()]))
    return d.select("doc_id", F.array_join(fields, ";").alias("contract"))


@query("""
WITH s AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'FULL' WHEN 1 THEN 'CH-' || doc_id ELSE '' END AS p, CASE doc_id % 3 WHEN 0 THEN 'whole_video' WHEN 1 THEN 'chapter' ELSE '' END AS t FROM documents)
SELECT doc_id, CASE WHEN p = 'FULL' OR (p = '' AND t = 'whole_video') THEN 'whole_video' WHEN p <> '' OR t = 'chapter' THEN 'processed_chapter_only' ELSE 'unknown' END AS scope,
 array_to_string(list_filter([CASE WHEN p <> '' THEN 'processed_chapter.chapter_id=' || p END, CASE WHEN (p = 'FULL' OR p = '') AND t <> '' THEN 'translation_scope=' || t END], lambda x: x IS NOT NULL), ',') AS evidence,
 CASE WHEN p NOT IN ('', 'FULL') AND t = 'whole_video' THEN 'translation_scope_whole_video_conflicts_with_non_full_processed_chapter' WHEN p = '' AND t = '' THEN 'source_scope_cannot_be_proven_from_current_result' END AS warning FROM s
""")
def scope_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a result covers the whole video, one chapter or can't be told, why, and what contradicts."""
    p = F.when(F.col("doc_id") % 4 == 0, "FULL").when(F.col("doc_id") % 4 == 1, F.concat(F.lit("CH-"), F.col("doc_id").cast("string"))).otherwise("")
    t = F.when(F.col("doc_id") % 3 == 0, "whole_video").when(F.col("doc_id") % 3 == 1, "chapter").otherwise("")
    d = table(spark, sf_dir, "documents").select("doc_id", p.alias("p"), t.alias("t"))
    full, none, whole = F.col("p") == "FULL", F.col("p") == "", F.col("t") == "whole_video"
    scope = F.when(full | (none & whole), "whole_video").when(~none | (F.col("t") == "chapter"), "processed_chapter_only").otherwise("unknown")
    evidence = F.array_compact(F.array(F.when(~none, F.concat(F.lit("processed_chapter.chapter_id="), "p")), F.when((full | none) & (F.col("t") != ""), F.concat(F.lit("translation_scope="), "t"))))
    warning = F.when(~none & ~full & whole, "translation_scope_whole_video_conflicts_with_non_full_processed_chapter").when(none & (F.col("t") == ""), "source_scope_cannot_be_proven_from_current_result")
    return d.select("doc_id", scope.alias("scope"), F.array_join(evidence, ",").alias("evidence"), warning.alias("warning"))


@query("""
WITH c AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1), d AS (SELECT doc_id, CASE WHEN doc_id % 11 = 3 THEN 'v0' ELSE 'v1' END AS version, CASE WHEN doc_id % 7 = 2 THEN ' ' ELSE 'https://example.org/' || doc_id END AS url, CASE WHEN doc_id % 13 = 5 THEN '' ELSE 'V' || doc_id END AS id, n, CASE WHEN doc_id % 2 = 0 THEN 'collected' ELSE 'failed' END AS status FROM documents LEFT JOIN c ON conv_id = doc_id),
e AS (SELECT *, list_filter([CASE WHEN version <> 'v1' THEN 'collection_schema_version_mismatch' END, CASE WHEN trim(url) = '' THEN 'collection_source_url_missing' END, CASE WHEN trim(id) = '' THEN 'collection_video_id_missing' END, CASE WHEN n IS NULL THEN 'collection_transcript_items_must_be_a_list' END], lambda x: x IS NOT NULL) AS errors FROM d)
SELECT doc_id, array_to_string(errors, ',') AS errors, len(errors) = 0 AND status = 'collected' AND n > 0 AS eligible, CASE WHEN n > 0 AND status = 'collected' THEN 'text_complete' WHEN n IS NULL THEN 'transcript_missing' ELSE 'metadata_only' END AS gate, coalesce(n, 0) AS segment_count FROM e
""")
def collected_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents put together from their parts, with what is missing, the gate, and whether they may be processed."""
    c = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.count("*").alias("n"))
    doc = F.col("doc_id")
    d = table(spark, sf_dir, "documents").select("doc_id").join(c, "doc_id", "left")
    collected = doc % 2 == 0
    errors = F.array_compact(F.array(F.when(doc % 11 == 3, "collection_schema_version_mismatch"), F.when(F.trim(F.when(doc % 7 == 2, " ").otherwise("u")) == "", "collection_source_url_missing"), F.when(F.trim(F.when(doc % 13 == 5, "").otherwise("V")) == "", "collection_video_id_missing"), F.when(F.col("n").isNull(), "collection_transcript_items_must_be_a_list")))
    gate = F.when((F.col("n") > 0) & collected, "text_complete").when(F.col("n").isNull(), "transcript_missing").otherwise("metadata_only")
    eligible = (F.size(errors) == 0) & collected & (F.coalesce("n", F.lit(0)) > 0)
    return d.select("doc_id", F.array_join(errors, ",").alias("errors"), eligible.alias("eligible"), gate.alias("gate"), F.coalesce("n", F.lit(0)).cast("long").alias("segment_count"))


@query("""
WITH l AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN [l_linenumber, l_linenumber + 1] END AS parts FROM lineitem) SELECT l_orderkey, l_linenumber FROM l WHERE CASE WHEN parts IS NOT NULL THEN list_contains(parts, 3) ELSE l_linenumber = 3 END
""")
def part_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that belong to a part: by their list of parts if they have one, else by their own."""
    own = F.col("l_linenumber")
    parts = F.when(own % 2 == 0, F.array(own, own + 1))
    return table(spark, sf_dir, "lineitem").where(F.when(parts.isNotNull(), F.array_contains(parts, 3)).otherwise(own == 3)).select("l_orderkey", "l_linenumber")


@query(f"""
WITH {UTT} SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY start_s, turn) AS no, lpad((start_s::BIGINT // 60)::VARCHAR, 2, '0') || ':' || lpad((start_s::BIGINT % 60)::VARCHAR, 2, '0') AS start_label, ko AS text, turn % 3 = 0 AS verified FROM utt
""")
def editor_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A draft's rows as an editor shows them, numbered."""
    no = F.row_number().over(Window.partitionBy("conv_id").orderBy("start_s", "turn"))
    return utterances(spark, sf_dir).select("conv_id", no.cast("long").alias("no"), clock.seconds_to_clock(F.col("start_s")).alias("start_label"), F.col("ko").alias("text"), (F.col("turn") % 3 == 0).alias("verified"))


@query("""
WITH k AS (SELECT p_partkey AS id, p_retailprice AS s, p_retailprice + p_size AS e FROM part WHERE p_size > 5)
SELECT l_orderkey, count(*) AS n_wanted, count(id) AS n_known, min(s) AS start_seconds, max(e) AS end_seconds FROM lineitem LEFT JOIN k ON id = l_partkey GROUP BY 1
""")
def segment_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edited rows looked up by their segments' ids: unknown ones are dropped, and start and end are those of the known."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_partkey").alias("ids"))
    known = table(spark, sf_dir, "part").where("p_size > 5").select(F.col("p_partkey").alias("id"), F.struct(F.col("p_retailprice").alias("s"), (F.col("p_retailprice") + F.col("p_size")).alias("e")).alias("t"))
    found = rows.select("l_orderkey", F.explode("ids").alias("id")).join(known, "id", "left").groupBy("l_orderkey").agg(F.count("*").alias("n_wanted"), F.collect_list("t").alias("ts"))
    return found.select("l_orderkey", "n_wanted", F.size("ts").cast("long").alias("n_known"), F.array_min(F.transform("ts", lambda t: t["s"])).alias("start_seconds"), F.array_max(F.transform("ts", lambda t: t["e"])).alias("end_seconds"))


@query(f"""
WITH {UTT}, i AS (SELECT conv_id, CASE WHEN turn % 2 = 0 THEN end_s ELSE start_s + 3 END AS e, end_s FROM utt WHERE conv_id % 4 <> 1 OR turn < 0), m AS (SELECT conv_id, max(end_s) AS u FROM utt GROUP BY 1)
SELECT m.conv_id, coalesce(CASE WHEN m.conv_id % 3 = 0 AND m.conv_id > 0 THEN m.conv_id * 10.0::DOUBLE END, max(i.e), any_value(u), 0.0) AS duration FROM m LEFT JOIN i USING (conv_id) GROUP BY 1
""")
def video_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A video's length: stated and positive, else where its items end, else where its units end."""
    stated = F.when(F.col("conv_id") % 3 == 0, F.col("conv_id") * 10.0)
    item_end = F.when(F.col("conv_id") % 4 != 1, F.coalesce(F.when(F.col("turn") % 2 == 0, F.col("end_s")), F.col("start_s") + 3.0))
    ends = utterances(spark, sf_dir).groupBy("conv_id").agg(F.max(item_end).alias("items"), F.max("end_s").alias("units"))
    return ends.select("conv_id", F.coalesce(F.when(stated > 0, stated), "items", "units", F.lit(0.0)).alias("duration"))


@query(f"""
WITH {UTT} SELECT conv_id, 'CCH-01' AS content_chapter_id, min(start_s) AS start_seconds, max(end_s) AS end_seconds, string_agg('U' || turn, ',' ORDER BY start_s, end_s, turn) AS ids, array_to_string(list_sort(list(DISTINCT 'C' || chapter)), ',') AS creator_ids, CASE WHEN conv_id % 3 = 0 THEN 'whole' ELSE 'Label ' || conv_id END AS title, 0.0::DOUBLE AS confidence, true AS needs_review FROM utt WHERE conv_id % 5 <> 4 GROUP BY conv_id
""")
def seed_chapter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One chapter that covers all a result has, to be reviewed, unless its scope is unknown."""
    u = utterances(spark, sf_dir).where(F.col("conv_id") % 5 != 4)
    label = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    ordered = F.array_sort(F.collect_list(F.struct("start_s", "end_s", "turn", label("U", "turn").alias("id"))))
    s = u.groupBy("conv_id").agg(F.min("start_s").alias("start_seconds"), F.max("end_s").alias("end_seconds"), ordered.alias("o"), F.array_sort(F.collect_set(label("C", "chapter"))).alias("c"))
    title = F.when(F.col("conv_id") % 3 == 0, "whole").otherwise(F.concat(F.lit("Label "), F.col("conv_id").cast("string")))
    return s.select("conv_id", F.lit("CCH-01").alias("content_chapter_id"), "start_seconds", "end_seconds", F.array_join(F.col("o.id"), ",").alias("ids"), F.array_join("c", ",").alias("creator_ids"), title.alias("title"), F.lit(0.0).alias("confidence"), F.lit(True).alias("needs_review"))


@query(f"""
WITH {UTT}, s AS (SELECT *, len(regexp_extract_all(ko, '확인|저장')) AS score, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM utt WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
b AS (SELECT conv_id, max(score) AS top, any_value(n) AS n FROM s GROUP BY 1), p AS (SELECT s.*, row_number() OVER (PARTITION BY s.conv_id ORDER BY CASE WHEN top > 0 THEN -score ELSE 0 END, CASE WHEN top > 0 THEN abs(i - (s.n - 1) / 2) ELSE abs(i - s.n // 2) END, i) AS k, top FROM s JOIN b USING (conv_id))
SELECT conv_id, turn, score::BIGINT AS score, top = 0 AS fallback_used, least(greatest((start_s + end_s) / 2, 12.0), 45.0) AS target_seconds FROM p WHERE k = 1
""")
def representative_or_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chapter's row of greatest score, ties to the middle; the middle row where none scores. The target is its midpoint, held within the chapter."""
    w = Window.partitionBy("conv_id")
    s = utterances(spark, sf_dir).withColumns({"score": F.regexp_count("ko", F.lit("확인|저장")).cast("long"), "i": F.row_number().over(w.orderBy("turn")) - 1, "n": F.count("*").over(w)})
    row = F.struct("turn", "score", "start_s", "end_s")
    middle = -F.abs(F.col("i") - (F.col("n") - 1) / 2)
    best = s.groupBy("conv_id").agg(F.max("score").alias("top"), F.max_by(row, F.struct(F.col("score"), middle, -F.col("i"))).alias("b"), F.max(F.when(F.col("i") == F.floor(F.col("n") / 2), row)).alias("m"))
    fallback = F.col("top") <= 0
    best = best.withColumn("r", F.when(fallback, F.col("m")).otherwise(F.col("b")))
    return best.select("conv_id", "r.turn", "r.score", fallback.alias("fallback_used"), F.least(F.greatest((F.col("r.start_s") + F.col("r.end_s")) / 2, F.lit(12.0)), F.lit(45.0)).alias("target_seconds"))


@query(f"""
WITH {UTT}, c AS (SELECT conv_id, chapter, min(start_s) AS a, max(end_s) AS b FROM utt GROUP BY 1, 2), t AS (SELECT *, least(greatest(CASE WHEN chapter % 2 = 0 THEN a + 0.1 ELSE (a + b) / 2 + 3 END, a), b) AS t FROM c),
q AS (SELECT *, [[t], [least(greatest(t - 2.0, a), b)], [least(greatest(t + 2.0, a), b)], [least(greatest(t - 1.0, a), b)], [least(greatest(t + 1.0, a), b)], [a], [b], [(a + b) / 2]] AS v FROM t),
r AS (SELECT conv_id, chapter, list_sort(list_reduce(v, lambda acc, x: CASE WHEN len(acc) < 3 AND len(list_filter(acc, lambda e: abs(e - x[1]) < 0.25 - 1e-9)) = 0 THEN list_concat(acc, x) ELSE acc END)) AS times FROM q)
SELECT conv_id, chapter, len(times)::BIGINT AS n, round(times[1], 6) AS first, round(times[-1], 6) AS last, round(list_sum(times), 6) AS total FROM r
""")
def frame_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to three times for a chapter's picture, at least a quarter of a second apart, the target first."""
    c = utterances(spark, sf_dir).groupBy("conv_id", "chapter").agg(F.min("start_s").alias("a"), F.max("end_s").alias("b"))
    clamp = lambda v: F.least(F.greatest(v, F.col("a")), F.col("b"))
    c = c.withColumn("t", clamp(F.when(F.col("chapter") % 2 == 0, F.col("a") + 0.1).otherwise((F.col("a") + F.col("b")) / 2 + 3)))
    t = F.col("t")
    wanted = F.array(clamp(t - 2.0), clamp(t + 2.0), clamp(t - 1.0), clamp(t + 1.0), F.col("a"), F.col("b"), (F.col("a") + F.col("b")) / 2)
    far = lambda acc, v: F.forall(acc, lambda e: F.abs(e - v) >= 0.25 - 1e-9)
    times = F.array_sort(F.aggregate(wanted, F.array(t), lambda acc, v: F.when((F.size(acc) < 3) & far(acc, v), F.concat(acc, F.array(v))).otherwise(acc)))
    c = c.withColumn("times", times)
    return c.select("conv_id", "chapter", F.size("times").cast("long").alias("n"), F.round(F.element_at("times", 1), 6).alias("first"), F.round(F.element_at("times", -1), 6).alias("last"), F.round(F.aggregate("times", F.lit(0.0), lambda s, v: s + v), 6).alias("total"))


@query("""
WITH s AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN '' ELSE trim(url) END AS u, CASE WHEN page_id % 2 = 0 THEN 'id_' || page_id ELSE '' END AS v FROM pages)
SELECT page_id, CASE WHEN u <> '' THEN u WHEN v <> '' THEN 'https://www.youtube.com/watch?v=' || v END AS source_url, nullif(v, '') AS video_id, CASE WHEN u <> '' THEN 'preserved_source_url' WHEN v <> '' THEN 'canonical_youtube_url_from_video_id' END AS method FROM s
""")
def source_locator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a source is: its own URL, else one made from its id, else nowhere."""
    u = F.when(F.col("page_id") % 3 == 0, "").otherwise(F.trim("url"))
    v = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("id_"), F.col("page_id").cast("string"))).otherwise("")
    s = table(spark, sf_dir, "pages").select("page_id", u.alias("u"), v.alias("v"))
    has_u, has_v = F.col("u") != "", F.col("v") != ""
    made = F.concat(F.lit("https://www.youtube.com/watch?v="), F.url_encode("v"))
    return s.select("page_id", F.when(has_u, F.col("u")).when(has_v, made).alias("source_url"), F.nullif("v", F.lit("")).alias("video_id"), F.when(has_u, "preserved_source_url").when(has_v, "canonical_youtube_url_from_video_id").alias("method"))


@query(r"""
WITH u AS (SELECT page_id, unnest(regexp_extract_all(html || ' <a href="' || coalesce(url, '') || '">', 'https?://[^\s<>"'')\]]+')) AS u FROM pages), d AS (SELECT page_id, list_sort(list(DISTINCT u)) AS us FROM u GROUP BY 1)
SELECT page_id, len(us)::BIGINT AS n_urls, sha256(array_to_string(us, chr(10))) AS urls FROM d
""")
def url_trust_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The different URLs that a page states; others aren't trusted."""
    body = F.concat("html", F.lit(' <a href="'), F.coalesce("url", F.lit("")), F.lit('">'))
    found = F.regexp_extract_all(body, F.lit(r"""(https?://[^\s<>"')\]]+)"""), 1)
    us = F.array_sort(F.array_distinct(found))
    return table(spark, sf_dir, "pages").select("page_id", us.alias("us")).where(F.size("us") > 0).select("page_id", F.size("us").cast("long").alias("n_urls"), F.sha2(F.array_join("us", "\n"), 256).alias("urls"))


@query(r"""
WITH w AS (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS x, generate_subscripts(string_split(text, ' '), 1) AS i FROM conversations), t AS (SELECT conv_id, turn, i, trim(x, ' ,.;:()[]{}' || chr(9) || chr(10)) AS x FROM w),
k AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn, lower(x) ORDER BY i) AS nth FROM t WHERE x <> '')
SELECT conv_id, turn, count(*) AS n, sha256(string_agg(x, ' ' ORDER BY i)) AS kept FROM k WHERE nth = 1 GROUP BY 1, 2
""")
def keep_first_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A turn's words without marks around them, the first spelling of each."""
    trimmed = F.transform(F.split("text", " "), lambda x: F.btrim(x, F.lit(" \t\n,.;:()[]{}")))
    w = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(trimmed).alias("i", "x")).where("x <> ''")
    first = w.groupBy("conv_id", "turn", F.lower("x").alias("k")).agg(F.min(F.struct("i", "x")).alias("f"))
    kept = first.groupBy("conv_id", "turn").agg(F.array_sort(F.collect_list("f")).alias("fs"))
    return kept.select("conv_id", "turn", F.size("fs").cast("long").alias("n"), F.sha2(F.array_join(F.col("fs.x"), " "), 256).alias("kept"))


@query(f"""
WITH RECURSIVE {UTT}, o AS (SELECT conv_id, turn, start_s AS s, end_s AS e, length(text) AS size, regexp_matches(text, '[.!?…]["''’”)]*$') AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM utt WHERE trim(text) <> ''),
r AS (SELECT conv_id, turn, rn, 0::BIGINT AS grp, s AS f, e AS l, size AS c, 1 AS n, t AND e - s >= 14 AS v FROM o WHERE rn = 1
 UNION ALL SELECT conv_id, turn, rn, CASE WHEN b THEN g + 1 ELSE g END, f2, CASE WHEN b THEN e ELSE greatest(l, e) END, CASE WHEN b THEN size ELSE c + size END, CASE WHEN b THEN 1 ELSE n + 1 END, t AND (CASE WHEN b THEN e ELSE greatest(l, e) END) - f2 >= 14 FROM (
  SELECT o.conv_id, o.turn, o.rn, r.grp AS g, o.s, o.e, o.size, o.t, r.l, r.c, r.n, r.v OR o.s - r.l > 5.5 OR o.e - r.f > 42 OR r.c + o.size + r.n > 900 AS b, CASE WHEN r.v OR o.s - r.l > 5.5 OR o.e - r.f > 42 OR r.c + o.size + r.n > 900 THEN o.s ELSE r.f END AS f2
  FROM r JOIN o ON o.conv_id = r.conv_id AND o.rn = r.rn + 1))
SELECT conv_id, turn, grp FROM r
""")
def lookback_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments grouped until a sentence ends after enough seconds; before a gap, or what would make the group too long."""
    u = utterances(spark, sf_dir).where(F.trim("text") != "").withColumns({"size": F.char_length("text"), "terminal": F.col("text").rlike("[.!?…][\"'’”)]*$")})
    u = u.select("conv_id", "turn", "start_s", "end_s", "size", "terminal")
    return folds.fold(u, ["conv_id"], ["turn"], ["start_s", "end_s", "size", "terminal"], folds.lookback_groups(14.0, 42.0, 900, 5.5)).select("conv_id", "turn", "grp")


@query()
def long_text_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in pieces of at most 420 characters: whole sentences together, longer ones cut at a space."""
    pieces = folds.chunks_udf(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(pieces).alias("nth", "chunk")).select("doc_id", (F.col("nth") + 1).cast("long").alias("nth"), F.char_length("chunk").cast("long").alias("n_chars"), "chunk")


_ROLES = ("promotion", "giveaway", "broadcast_ops", "small_talk", "off_topic", "duplicate", "other_non_learning")


@query(f"""
WITH t AS (SELECT l_orderkey AS id, l_linenumber AS nth, CASE WHEN l_suppkey % 5 = 0 THEN l_linenumber - 1 ELSE l_linenumber END AS start, CASE WHEN l_returnflag = 'N' THEN 'learning' WHEN l_returnflag = 'A' THEN 'non_learning' ELSE 'other' END AS class, CASE l_partkey % 4 WHEN 0 THEN 'promotion' WHEN 1 THEN 'small_talk' WHEN 2 THEN 'music' END AS role FROM lineitem),
m AS (SELECT id, count(*) AS n FROM t GROUP BY 1), s AS (SELECT t.*, n, lag(start) OVER w AS before, lag(class) OVER w AS class_before, row_number() OVER w AS k, count(*) OVER (PARTITION BY t.id, start ORDER BY nth) AS seen FROM t JOIN m USING (id) WHERE n >= 2 WINDOW w AS (PARTITION BY t.id ORDER BY nth, start, class, coalesce(role, ''))),
e AS (SELECT id, nth, unnest([CASE WHEN seen > 1 THEN 'duplicate_start_utterance_id' END, CASE WHEN start < 1 OR start > n THEN 'start_outside_candidate' END, CASE WHEN k = 1 AND start <> 1 AND start BETWEEN 1 AND n THEN 'first_transition_must_start_at_candidate_start' END, CASE WHEN start BETWEEN 1 AND n AND start <= before THEN 'starts_not_strictly_increasing' END, CASE WHEN class = 'other' THEN 'unsupported_class' END, CASE WHEN class = class_before AND class <> 'other' THEN 'consecutive_classes_must_alternate' END, CASE WHEN class = 'learning' AND role IS NOT NULL THEN 'learning_transition_forbids_role' END, CASE WHEN class = 'non_learning' AND coalesce(role, '') NOT IN {_ROLES} THEN 'non_learning_role_must_be_allowed' END]) AS rule FROM s)
SELECT id, nth, rule FROM e WHERE rule IS NOT NULL
UNION ALL SELECT id, 0, 'mixed_transitions_must_have_at_least_two_items' FROM m WHERE n < 2
UNION ALL SELECT id, 0, 'mixed_transitions_must_cover_both_classes' FROM s GROUP BY id HAVING NOT (bool_or(class = 'learning') AND bool_or(class = 'non_learning'))
""")
def role_audit_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with a mixed decision's transitions: starts, classes, roles, and both classes covered."""
    l = table(spark, sf_dir, "lineitem")
    kind = F.when(F.col("l_returnflag") == "N", "learning").when(F.col("l_returnflag") == "A", "non_learning").otherwise("other")
    role = F.when(F.col("l_partkey") % 4 == 0, "promotion").when(F.col("l_partkey") % 4 == 1, "small_talk").when(F.col("l_partkey") % 4 == 2, "music")
    start = F.when(F.col("l_suppkey") % 5 == 0, F.col("l_linenumber") - 1).otherwise(F.col("l_linenumber"))
    t = l.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("nth"), start.alias("start"), kind.alias("class"), role.alias("role"))
    w = Window.partitionBy("id").orderBy("nth", "start", "class", F.coalesce("role", F.lit("")))
    s = t.withColumns({"n": F.count("*").over(Window.partitionBy("id")), "before": F.lag("start").over(w), "class_before": F.lag("class").over(w), "k": F.row_number().over(w), "seen": F.count("*").over(Window.partitionBy("id", "start").orderBy("nth"))})
    within = F.col("start").between(1, F.col("n"))
    c = F.col("class")
    rules = {
        "duplicate_start_utterance_id": F.col("seen") > 1,
        "start_outside_candidate": ~within,
        "first_transition_must_start_at_candidate_start": (F.col("k") == 1) & (F.col("start") != 1) & within,
        "starts_not_strictly_increasing": within & (F.col("start") <= F.col("before")),
        "unsupported_class": c == "other",
        "consecutive_classes_must_alternate": (c == F.col("class_before")) & (c != "other"),
        "learning_transition_forbids_role": (c == "learning") & F.col("role").isNotNull(),
        "non_learning_role_must_be_allowed": (c == "non_learning") & ~F.coalesce("role", F.lit("")).isin(*_ROLES),
    }
    each = members.violations(s.where("n >= 2"), ["id", "nth"], rules)
    whole = s.groupBy("id").agg(F.max("n").alias("n"), (F.max(c == "learning") & F.max(c == "non_learning")).alias("both"))
    few = whole.where("n < 2").select("id", F.lit(0).alias("nth"), F.lit("mixed_transitions_must_have_at_least_two_items").alias("rule"))
    one = whole.where("n >= 2 AND NOT both").select("id", F.lit(0).alias("nth"), F.lit("mixed_transitions_must_cover_both_classes").alias("rule"))
    return each.unionByName(few).unionByName(one)


@query("""
WITH q AS (SELECT l_orderkey AS o_orderkey, l_linenumber, l_quantity > 40 AND l_tax > 0.06 AS blocking, CASE WHEN l_returnflag = 'R' THEN 'unassigned_phase' ELSE 'fidelity' END AS type, coalesce(l_returnflag = 'R' AND l_discount > 0.08, false) AS excluded FROM lineitem),
e AS (SELECT o_orderkey, 'publish:unassigned_phase:' || l_linenumber AS error FROM q WHERE type = 'unassigned_phase' AND NOT excluded
 UNION ALL SELECT o_orderkey, 'publish:blocking_review_item:' || l_linenumber || ':' || type FROM q WHERE blocking AND NOT (type = 'unassigned_phase' AND excluded))
SELECT o_orderkey, count(error) AS n_errors, count(error) = 0 AS publishable, coalesce(string_agg(error, ',' ORDER BY error), '') AS errors FROM orders LEFT JOIN e USING (o_orderkey) GROUP BY 1
""")
def publish_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What keeps a draft from being published: phases without a part or a reason, and blocking items that no reason resolves."""
    l = table(spark, sf_dir, "lineitem")
    phase = F.when(F.col("l_returnflag") == "R", F.when(F.col("l_discount") > 0.08, "reason").otherwise(""))
    blocking = (F.col("l_quantity") > 40) & (F.col("l_tax") > 0.06)
    kind = F.when(F.col("l_returnflag") == "R", "unassigned_phase").otherwise("fidelity")
    nth = F.col("l_linenumber").cast("string")
    said = F.array_compact(F.array(F.when(phase == "", F.concat(F.lit("publish:unassigned_phase:"), nth)), F.when(blocking & ~F.coalesce(phase == "reason", F.lit(False)), F.concat(F.lit("publish:blocking_review_item:"), nth, F.lit(":"), kind))))
    errors = l.select(F.col("l_orderkey").alias("o_orderkey"), F.explode(said).alias("error")).groupBy("o_orderkey").agg(F.array_sort(F.collect_list("error")).alias("es"))
    o = table(spark, sf_dir, "orders").select("o_orderkey").join(errors, "o_orderkey", "left")
    es = F.coalesce("es", F.array().cast("array<string>"))
    return o.select("o_orderkey", F.size(es).cast("long").alias("n_errors"), (F.size(es) == 0).alias("publishable"), F.array_join(es, ",").alias("errors"))


@query("""
WITH r AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN props WHEN 1 THEN '```json ' || props || ' ```' WHEN 2 THEN '[1]' WHEN 3 THEN left(props, 4) WHEN 4 THEN '  ' ELSE '{"sections": [{"start": "U1", "role": "learning"}], "warnings": []}' END AS raw FROM events),
s AS (SELECT event_id, CASE WHEN trim(raw) = '' THEN 'response_text_is_empty' WHEN contains(raw, '```') THEN 'markdown_fence_is_forbidden' WHEN NOT json_valid(trim(raw)) THEN 'response_must_be_one_exact_json_object' WHEN json_type(trim(raw)) <> 'OBJECT' THEN 'response_root_must_be_an_object' ELSE 'ok' END AS status, raw FROM r)
SELECT event_id, status, CASE WHEN status = 'ok' THEN CASE WHEN json_type(raw, '$.sections') IS NULL THEN 'missing_top_level_fields:sections,warnings' WHEN json_array_length(raw, '$.sections') = 0 THEN 'sections_must_not_be_empty' ELSE '' END END AS contract FROM s
""")
def strict_json_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers that must be one JSON object without a fence, and whether an object has the sections it must have."""
    six = F.col("event_id") % 6
    fixed = '{"sections": [{"start": "U1", "role": "learning"}], "warnings": []}'
    raw = F.when(six == 0, F.col("props")).when(six == 1, F.concat(F.lit("```json "), "props", F.lit(" ```"))).when(six == 2, "[1]").when(six == 3, F.substring("props", 1, 4)).when(six == 4, "  ").otherwise(fixed)
    r = table(spark, sf_dir, "events").select("event_id", raw.alias("raw")).withColumn("v", F.try_parse_json(F.trim("raw")))
    root = F.expr("substring(schema_of_variant(v), 1, 6)")
    status = F.when(F.trim("raw") == "", "response_text_is_empty").when(F.contains("raw", F.lit("```")), "markdown_fence_is_forbidden").when(F.col("v").isNull(), "response_must_be_one_exact_json_object").when(root != "OBJECT", "response_root_must_be_an_object").otherwise("ok")
    r = r.withColumn("status", status)
    sections = F.from_json("raw", "sections array<struct<start:string,role:string>>, warnings array<string>")
    contract = F.when(sections["sections"].isNull(), "missing_top_level_fields:sections,warnings").when(F.size(sections["sections"]) == 0, "sections_must_not_be_empty").otherwise("")
    return r.select("event_id", "status", F.when(F.col("status") == "ok", contract).alias("contract"))
