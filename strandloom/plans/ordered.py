"""Queries of the window and fold operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandloom.operators import folds, islands
from strandloom.plans.registry import query
from strandloom.plans.tables import CHAP, SEG, chapters, segments, table

GAP = 21600.0  # the definition's 2.5 s between captions, at the pace of events: six hours
CAP = 259200.0
U, E = ["user_id"], ["start_s", "event_id"]


@query(f"""
WITH {SEG}, m AS (SELECT *, event_type = 'error' AS t, event_type = 'signup' AS s,
  max(end_s) OVER (PARTITION BY user_id ORDER BY start_s, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM seg),
f AS (SELECT *, coalesce(lag(t) OVER w, false) OR s OR coalesce(start_s - reach > {GAP}, false) AS b FROM m WINDOW w AS (PARTITION BY user_id ORDER BY start_s, event_id)),
g AS (SELECT *, sum(b::INT) OVER w - first_value(b::INT) OVER w AS island,
  CASE WHEN t THEN 'terminal_punctuation' WHEN lead(b) OVER w IS NULL THEN 'transcript_end' WHEN lead(b) OVER w AND lead(s) OVER w THEN 'speaker_change' WHEN lead(b) OVER w THEN 'time_gap' END AS reason
  FROM f WINDOW w AS (PARTITION BY user_id ORDER BY start_s, event_id))
SELECT user_id, island::BIGINT AS island, count(*) AS n, min(start_s) AS start_s, max(end_s) AS end_s, max(reason) AS reason FROM g GROUP BY ALL
""")
def sentence_islands_by_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Islands of a user's events between terminal events, new speakers and gaps."""
    rows = islands.islands(segments(spark, sf_dir), U, E, F.col("event_type") == "error", F.col("event_type") == "signup", GAP)
    return rows.groupBy("user_id", F.col("island").cast("long").alias("island")).agg(F.count("*").alias("n"), F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"), F.max("reason").alias("reason"))


@query(f"""
WITH {SEG}, {CHAP} SELECT c.user_id, chapter_id, c.start_s, coalesce(c.end_s, m.e) AS end_s
FROM chap c JOIN (SELECT user_id, max(end_s) AS e FROM seg GROUP BY 1) m USING (user_id)
""")
def chapter_lead_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters end where the next begins, the last with the stream."""
    last = segments(spark, sf_dir).groupBy("user_id").agg(F.max("end_s").alias("_e"))
    marks = chapters(spark, sf_dir).join(last, "user_id")
    return islands.lead_ranges(marks, U, ["start_s", "chapter_id"], "start_s", F.col("_e")).drop("_e")


@query("""
WITH m AS (SELECT *, row_number() OVER w = 1 OR role IS DISTINCT FROM lag(role) OVER w AS is_head FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
r AS (SELECT *, sum(is_head::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM m)
SELECT conv_id, run::BIGINT AS run, min(role) AS role, count(*) AS n, min(turn) AS first_turn, max(turn) AS last_turn FROM r GROUP BY conv_id, run
""")
def owner_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of turns of one role."""
    rows = islands.runs(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], F.col("role"))
    return rows.groupBy("conv_id", "run").agg(F.min("role").alias("role"), F.count("*").alias("n"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"))


@query("""
WITH m AS (SELECT *, row_number() OVER w = 1 OR role IS DISTINCT FROM lag(role) OVER w AS is_head FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
r AS (SELECT *, sum(is_head::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM m)
SELECT conv_id, role, count(DISTINCT run) AS n_runs FROM r GROUP BY 1, 2 HAVING count(DISTINCT run) > 1
""")
def discontiguous_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles that come back after their run was closed."""
    rows = islands.runs(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], F.col("role"))
    return rows.groupBy("conv_id", "role").agg(F.count_distinct("run").alias("n_runs")).where("n_runs > 1")


@query("""
SELECT conv_id, turn FROM (SELECT conv_id, turn, row_number() OVER w = 1 OR role IS DISTINCT FROM lag(role) OVER w AS h FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE h
""")
def run_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns that open a run, where a script shows its header."""
    return islands.runs(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], F.col("role")).where("is_head").select("conv_id", "turn")


@query("""
SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY quality, n_chars DESC, doc_id) AS rank FROM documents JOIN labels USING (doc_id)
""")
def rank_in_chapter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents of a source, the worst and longest first."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    return islands.rank_within(rows, ["source"], [F.col("quality"), F.desc("n_chars"), F.col("doc_id")]).select("source", "doc_id", F.col("rank").cast("long").alias("rank"))


@query("""
SELECT conv_id, turn, array_to_string(list(role || ':' || length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), ' ') AS context FROM conversations
""")
def neighbour_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn with two turns on either side."""
    rows = table(spark, sf_dir, "conversations").withColumn("v", F.concat_ws(":", "role", F.char_length("text")))
    rows = islands.surrounding(rows, ["conv_id"], ["turn"], "v", 2)
    return rows.select("conv_id", "turn", F.array_join("context", " ").alias("context"))


@query("""
WITH w AS (SELECT conv_id, turn, list_distinct(string_split(lower(text), ' ')) AS f FROM conversations),
p AS (SELECT *, lag(f) OVER (PARTITION BY conv_id ORDER BY turn) AS g FROM w)
SELECT conv_id, turn, len(list_intersect(f, g))::BIGINT AS n_common, round(len(list_intersect(f, g)) / least(len(f), len(g)), 6) AS overlap FROM p WHERE g IS NOT NULL AND len(list_intersect(f, g)) / least(len(f), len(g)) >= 0.05
""")
def neighbour_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns that share words with the turn before: the share of the smaller word set."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_distinct(F.split(F.lower("text"), " ")).alias("f"))
    rows = rows.withColumn("g", F.lag("f").over(Window.partitionBy("conv_id").orderBy("turn"))).where("g IS NOT NULL")
    common = F.size(F.array_intersect("f", "g"))
    share = common / F.least(F.size("f"), F.size("g"))
    return rows.where(share >= 0.05).select("conv_id", "turn", common.cast("long").alias("n_common"), F.round(share, 6).alias("overlap"))


@query("""
WITH RECURSIVE o AS (SELECT conv_id, turn, row_number() OVER w AS rn, length(text) < 200 AND lead(turn) OVER w IS NOT NULL AS j FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
r AS (SELECT conv_id, turn, rn, j AS takes_next, false AS is_taken FROM o WHERE rn = 1
  UNION ALL SELECT o.conv_id, o.turn, o.rn, o.j AND NOT r.takes_next, r.takes_next FROM r JOIN o ON o.conv_id = r.conv_id AND o.rn = r.rn + 1)
SELECT conv_id, turn, takes_next, is_taken FROM r
""")
def pair_merge_by_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short turns take in the next turn; a turn that was taken in takes none."""
    rows = islands.merge_pairs(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], F.char_length("text") < 200)
    return rows.select("conv_id", "turn", "takes_next", "is_taken")


@query("""
WITH s AS (SELECT o_custkey, o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS pos, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
SELECT o_custkey, o_orderkey AS first_order, pos AS first_pos, coalesce(lead(pos) OVER (PARTITION BY o_custkey ORDER BY pos) - 1, n) AS last_pos FROM s WHERE pos = 1 OR o_orderstatus = 'P'
""")
def section_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders in sections that begin at each pending order."""
    w = Window.partitionBy("o_custkey")
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", F.row_number().over(w.orderBy("o_orderkey")).cast("long").alias("pos"), F.count("*").over(w).alias("n"))
    starts = rows.where("pos = 1 OR o_orderstatus = 'P'")
    out = islands.section_ranges(starts, ["o_custkey"], "pos", F.col("n"))
    return out.select("o_custkey", F.col("o_orderkey").alias("first_order"), F.col("pos").alias("first_pos"), "last_pos")


@query("""
SELECT o_custkey, o_orderkey, 'UT-' || lpad((row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))::VARCHAR, 5, '0') AS utterance_id FROM orders
""")
def sequence_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running ids by position."""
    rows = islands.numbered_ids(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], "UT-", 5, "utterance_id")
    return rows.select("o_custkey", "o_orderkey", "utterance_id")


@query("SELECT c_mktsegment, max(regexp_extract(c_name, '(\\d+)$', 1)::BIGINT) + 1 AS next_number FROM customer GROUP BY 1")
def next_numeric_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next free number after the names' numeric suffixes."""
    return table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(islands.next_number("c_name").alias("next_number"))


@query("""
SELECT o_custkey, o_orderkey, previous FROM (SELECT o_custkey, o_orderkey, o_orderdate, lag(epoch_us(o_orderdate)) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS previous FROM orders) WHERE epoch_us(o_orderdate) <= previous
""")
def chronology_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that aren't later than the one of the number before."""
    at = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', o_orderdate)")
    rows = table(spark, sf_dir, "orders").withColumn("at", at)
    return islands.out_of_order(rows, ["o_custkey"], ["o_orderkey"], "at").select("o_custkey", "o_orderkey", "previous")


# ---- folds

_NTH = "row_number() OVER (PARTITION BY user_id ORDER BY start_s, event_id) AS rn"


@query(f"""
WITH RECURSIVE {SEG}, o AS (SELECT *, round(value)::BIGINT AS size, event_type = 'signup' AS sp, event_type = 'view' AS st, {_NTH} FROM seg),
r AS (SELECT user_id, event_id, rn, 0::BIGINT AS grp, start_s AS f, end_s AS e, size AS c FROM o WHERE rn = 1
 UNION ALL SELECT user_id, event_id, rn, CASE WHEN b THEN g + 1 ELSE g END, CASE WHEN b THEN start_s ELSE f END, CASE WHEN b THEN end_s ELSE greatest(e, end_s) END, CASE WHEN b THEN size ELSE c + 1 + size END FROM (
   SELECT o.user_id, o.event_id, o.rn, r.grp AS g, o.start_s, o.end_s, r.f, r.e, r.c, o.size,
     o.sp OR o.start_s - r.e > {GAP} OR o.end_s - r.f > {CAP} OR r.c + 1 + o.size > 600 OR (o.st AND (r.e - r.f >= 43200 OR r.c >= 150)) AS b
   FROM r JOIN o ON o.user_id = r.user_id AND o.rn = r.rn + 1))
SELECT user_id, grp, count(*) AS n, min(event_id) AS first_event FROM r GROUP BY 1, 2
""")
def utterance_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Utterances: closed by speaker, gap, length, or a strong start once long enough."""
    rows = segments(spark, sf_dir).withColumns({"size": F.round("value").cast("long"), "sp": F.col("event_type") == "signup", "st": F.col("event_type") == "view"})
    done = folds.fold(rows, U, E, ["start_s", "end_s", "size", "sp", "st"], folds.utterance_groups(GAP, CAP, 600, 43200.0, 150))
    return done.groupBy("user_id", "grp").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))


@query("""
WITH RECURSIVE o AS (SELECT conv_id, turn, length(text) AS size, turn * 7.0 AS s, turn * 7.0 + 5.0 AS e, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations),
r AS (SELECT conv_id, turn, rn, 0::BIGINT AS grp, s AS f, e AS l, size AS c, 1 AS n FROM o WHERE rn = 1
 UNION ALL SELECT conv_id, turn, rn, CASE WHEN b THEN g + 1 ELSE g END, CASE WHEN b THEN s ELSE f END, CASE WHEN b THEN e ELSE greatest(l, e) END, CASE WHEN b THEN size ELSE c + 1 + size END, CASE WHEN b THEN 1 ELSE n + 1 END FROM (
   SELECT o.conv_id, o.turn, o.rn, r.grp AS g, o.s, o.e, o.size, r.f, r.l, r.c, r.n, r.n >= 4 OR o.e - r.f > 30 OR r.c + 1 + o.size > 1000 OR (r.l - r.f >= 14 AND r.n >= 2) AS b
   FROM r JOIN o ON o.conv_id = r.conv_id AND o.rn = r.rn + 1))
SELECT conv_id, turn, grp FROM r
""")
def sentence_groups_max4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of at most four turns, 30 seconds and 1,000 characters."""
    at = F.col("turn") * 7.0
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.char_length("text").alias("size"), at.alias("s"), (at + 5.0).alias("e"))
    return folds.fold(rows, ["conv_id"], ["turn"], ["s", "e", "size"], folds.sentence_groups(4, 30.0, 1000, 14.0, 2)).select("conv_id", "turn", "grp")


@query(f"""
WITH RECURSIVE {SEG}, o AS (SELECT *, event_type = 'error' AS t, {_NTH} FROM seg),
r AS (SELECT user_id, event_id, rn, 0::BIGINT AS grp, start_s AS f, end_s AS e, t OR end_s - start_s >= {CAP} AS v FROM o WHERE rn = 1
 UNION ALL SELECT user_id, event_id, rn, CASE WHEN b THEN g + 1 ELSE g END, CASE WHEN b THEN s ELSE f END, e, t OR e - (CASE WHEN b THEN s ELSE f END) >= {CAP} FROM (
   SELECT o.user_id, o.event_id, o.rn, r.grp AS g, o.start_s AS s, r.f, greatest(r.e, o.end_s) AS e, o.t, r.v OR o.start_s - r.e > {GAP} AS b
   FROM r JOIN o ON o.user_id = r.user_id AND o.rn = r.rn + 1))
SELECT user_id, event_id, grp FROM r
""")
def islands_with_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Islands that are also cut once they have lasted a limit."""
    rows = segments(spark, sf_dir).withColumn("t", F.col("event_type") == "error")
    return folds.fold(rows, U, E, ["start_s", "end_s", "t"], folds.capped_islands(GAP, CAP)).select("user_id", "event_id", "grp")


@query("""
WITH RECURSIVE o AS (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents),
r AS (SELECT source, doc_id, rn, 0::BIGINT AS batch, 1 AS n, n_chars AS c FROM o WHERE rn = 1
 UNION ALL SELECT source, doc_id, rn, CASE WHEN b THEN g + 1 ELSE g END, CASE WHEN b THEN 1 ELSE n + 1 END, CASE WHEN b THEN size ELSE c + size END FROM (
   SELECT o.source, o.doc_id, o.rn, r.batch AS g, r.n, r.c, o.n_chars AS size, r.n >= 10 OR r.c + o.n_chars > 7800 AS b FROM r JOIN o ON o.source = r.source AND o.rn = r.rn + 1))
SELECT source, doc_id, batch FROM r
""")
def batch_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of a source in batches of at most ten and 7,800 characters."""
    rows = table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    return folds.fold(rows, ["source"], ["doc_id"], ["n_chars"], folds.batches(10, 7800), "batch").select("source", "doc_id", "batch")


@query("SELECT source, doc_id, ((row_number() OVER (PARTITION BY source ORDER BY doc_id)) - 1) // 6 AS batch FROM documents")
def fixed_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of six."""
    rows = islands.numbered_within(table(spark, sf_dir, "documents").select("source", "doc_id"), "source", ["doc_id"])
    return rows.select("source", "doc_id", F.floor((F.col("nth") - 1) / 6).alias("batch"))


_CLUSTER = f"""{SEG}, t AS (SELECT user_id, event_id, start_s - 1800 AS s, end_s + 1800 AS e, value FROM seg WHERE event_type IN ('error', 'purchase')),
o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY s, e, event_id) AS rn FROM t),
r AS (SELECT user_id, event_id, rn, 0::BIGINT AS cluster, s AS f, e AS l, s, e, value FROM o WHERE rn = 1
 UNION ALL SELECT user_id, event_id, rn, CASE WHEN b THEN g + 1 ELSE g END, CASE WHEN b THEN s ELSE f END, CASE WHEN b THEN e ELSE greatest(l, e) END, s, e, value FROM (
   SELECT o.*, r.cluster AS g, r.f, r.l, o.s - r.l > 7200 OR greatest(r.l, o.e) - r.f > 28800 AS b FROM r JOIN o ON o.user_id = r.user_id AND o.rn = r.rn + 1)),
w AS (SELECT user_id, cluster, min(s) AS s, max(e) AS e, max(value) AS priority, count(*) AS n FROM r GROUP BY 1, 2)"""


def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = segments(spark, sf_dir).where("event_type IN ('error', 'purchase')")
    rows = rows.select("user_id", "event_id", (F.col("start_s") - 1800).alias("s"), (F.col("end_s") + 1800).alias("e"), "value")
    done = folds.fold(rows, U, ["s", "e", "event_id"], ["s", "e"], folds.interval_clusters(7200.0, 28800.0), "cluster")
    return done.groupBy("user_id", "cluster").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.max("value").alias("priority"), F.count("*").alias("n"))


@query(f"WITH RECURSIVE {_CLUSTER} SELECT user_id, cluster, s, e, priority, n FROM w")
def interval_clusters_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Padded intervals in clusters with a largest gap and a largest length."""
    return _windows(spark, sf_dir)


@query(f"""
WITH RECURSIVE {_CLUSTER}, p AS (SELECT *, e - s AS d, row_number() OVER (PARTITION BY user_id ORDER BY priority DESC, s, cluster) AS k FROM w),
b AS (SELECT user_id, cluster, k, CASE WHEN d <= 86400 THEN d ELSE 0 END AS used, (d <= 86400)::BIGINT AS chosen FROM p WHERE k = 1
 UNION ALL SELECT p.user_id, p.cluster, p.k, CASE WHEN b.used + p.d <= 86400 THEN b.used + p.d ELSE b.used END, (b.used + p.d <= 86400)::BIGINT FROM b JOIN p ON p.user_id = b.user_id AND p.k = b.k + 1)
SELECT user_id, cluster, chosen FROM b
""")
def budget_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters by priority while they fit a day; what doesn't fit is skipped."""
    rows = _windows(spark, sf_dir).withColumn("d", F.col("e") - F.col("s"))
    return folds.fold(rows, U, [F.desc("priority"), F.col("s"), F.col("cluster")], ["d"], folds.within_budget(86400.0), "chosen").select("user_id", "cluster", "chosen")


@query(f"""
WITH RECURSIVE {_CLUSTER}, p AS (SELECT *, e - s AS d, CASE WHEN priority >= 150 THEN 129600 ELSE 86400 END AS cap, row_number() OVER (PARTITION BY user_id ORDER BY priority >= 150 DESC, priority DESC, s, cluster) AS k FROM w),
b AS (SELECT user_id, cluster, k, CASE WHEN d <= cap THEN d ELSE 0 END AS used, (d <= cap)::BIGINT AS chosen FROM p WHERE k = 1
 UNION ALL SELECT p.user_id, p.cluster, p.k, CASE WHEN b.used + p.d <= p.cap THEN b.used + p.d ELSE b.used END, (b.used + p.d <= p.cap)::BIGINT FROM b JOIN p ON p.user_id = b.user_id AND p.k = b.k + 1)
SELECT user_id, cluster, chosen FROM b
""")
def adaptive_budget_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Urgent clusters up to a cap, then the others up to the base budget."""
    rows = _windows(spark, sf_dir).withColumns({"d": F.col("e") - F.col("s"), "urgent": F.col("priority") >= 150})
    order = [F.desc("urgent"), F.desc("priority"), F.col("s"), F.col("cluster")]
    return folds.fold(rows, U, order, ["d", "urgent"], folds.within_two_budgets(86400.0, 129600.0), "chosen").select("user_id", "cluster", "chosen")


@query("""
WITH RECURSIVE t AS (SELECT conv_id, max(turn) // 2 AS mid FROM conversations GROUP BY 1),
o AS (SELECT conv_id, turn, length(text) AS size, row_number() OVER (PARTITION BY conv_id ORDER BY abs(turn - mid), turn) AS k FROM conversations JOIN t USING (conv_id)),
b AS (SELECT conv_id, turn, k, CASE WHEN size <= 800 THEN size ELSE 0 END AS used, (size <= 800)::BIGINT AS kept FROM o WHERE k = 1
 UNION ALL SELECT o.conv_id, o.turn, o.k, CASE WHEN b.used + o.size <= 800 THEN b.used + o.size ELSE b.used END, (b.used + o.size <= 800)::BIGINT FROM b JOIN o ON o.conv_id = b.conv_id AND o.k = b.k + 1)
SELECT conv_id, turn, kept FROM b
""")
def nearest_context_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns nearest to the middle of a conversation while they fit 800 characters."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.char_length("text").alias("size"))
    mid = rows.groupBy("conv_id").agg(F.floor(F.max("turn") / 2).alias("mid"))
    rows = rows.join(mid, "conv_id")
    return folds.fold(rows, ["conv_id"], [F.abs(F.col("turn") - F.col("mid")), F.col("turn")], ["size"], folds.within_budget(800), "kept").select("conv_id", "turn", "kept")


@query("""
SELECT conv_id, turn FROM (SELECT conv_id, turn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS c FROM conversations) WHERE c <= 800
""")
def prefix_context_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first turns of a conversation up to 800 characters: a running sum, as it stops at the first that is too long."""
    total = F.sum(F.char_length("text")).over(Window.partitionBy("conv_id").orderBy("turn"))
    return table(spark, sf_dir, "conversations").withColumn("c", total).where("c <= 800").select("conv_id", "turn")


@query("""
WITH d AS (SELECT source AS chapter, doc_id, CASE WHEN quality = 0 THEN 4.0 ELSE 1.0 END + toxic * 2.0 AS score FROM documents JOIN labels USING (doc_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY chapter ORDER BY score DESC, doc_id) AS depth FROM d),
a AS (SELECT doc_id, 0 AS phase, row_number() OVER (ORDER BY score DESC, doc_id) AS k FROM r WHERE score >= 5.5
 UNION ALL SELECT doc_id, 1, row_number() OVER (ORDER BY depth, chapter) FROM r WHERE depth <= 3
 UNION ALL SELECT doc_id, 2, row_number() OVER (ORDER BY score DESC, doc_id) FROM r),
f AS (SELECT doc_id, min((phase, k)) AS first_place FROM a GROUP BY 1)
SELECT doc_id, row_number() OVER (ORDER BY first_place) AS place FROM f ORDER BY first_place LIMIT 24
""")
def review_sampling_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """24 rows to review: the strong ones, then the best three of each chapter in turn, then the rest by score."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("chapter")).join(table(spark, sf_dir, "labels"), "doc_id")
    d = d.withColumn("score", F.when(F.col("quality") == 0, 4.0).otherwise(1.0) + F.col("toxic") * 2.0)
    r = islands.rank_within(d, ["chapter"], [F.desc("score"), F.col("doc_id")], "depth")
    # each phase's order is a struct, so the first place of a row is a minimum and no phase has to be numbered
    place = F.struct(F.lit(0).alias("phase"), (-F.col("score")).alias("x"), F.lit("").alias("y"), F.col("doc_id").alias("z"))
    turn = F.struct(F.lit(1).alias("phase"), F.col("depth").cast("double").alias("x"), F.col("chapter").alias("y"), F.col("doc_id").alias("z"))
    rest = F.struct(F.lit(2).alias("phase"), (-F.col("score")).alias("x"), F.lit("").alias("y"), F.col("doc_id").alias("z"))
    at = F.least(F.when(F.col("score") >= 5.5, place).otherwise(rest), F.when(F.col("depth") <= 3, turn).otherwise(rest))
    top = r.select("doc_id", at.alias("at")).orderBy("at").limit(24)
    return top.select("doc_id", F.row_number().over(Window.orderBy("at")).cast("long").alias("place"))


@query("""
WITH m AS (SELECT conv_id, turn, role, text, row_number() OVER w = 1 OR role IS DISTINCT FROM lag(role) OVER w AS h FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
r AS (SELECT *, sum(h::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM m)
SELECT conv_id, min(turn) AS turn, sha256(string_agg(text, ' ' ORDER BY turn)) AS joined FROM r GROUP BY conv_id, run
""")
def merged_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring turns of one role as one, their texts joined."""
    rows = islands.runs(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], F.col("role"))
    texts = F.array_sort(F.collect_list(F.struct("turn", "text")))
    return rows.groupBy("conv_id", "run").agg(F.min("turn").alias("turn"), texts.alias("t")).select("conv_id", "turn", F.sha2(F.array_join("t.text", " "), 256).alias("joined"))
