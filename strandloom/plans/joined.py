"""Queries of the join operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandloom.operators import joins
from strandloom.plans.registry import query
from strandloom.plans.tables import CHAP, SEG, chapters, pieces, segments, table

DAY = 86400.0


@query(f"""
WITH {SEG}, {CHAP}, f AS (SELECT user_id, arg_min(chapter_id, start_s) AS first_id FROM chap GROUP BY 1)
SELECT s.user_id, s.event_id, coalesce(c.chapter_id, f.first_id) AS chapter_id
FROM seg s ASOF LEFT JOIN chap c ON s.user_id = c.user_id AND s.start_s >= c.start_s LEFT JOIN f ON s.user_id = f.user_id
""")
def chapter_asof_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chapter that each event falls in: the latest that has begun, else the first."""
    rows = segments(spark, sf_dir).select("user_id", "event_id", "start_s")
    return joins.asof(rows, chapters(spark, sf_dir), "user_id", "start_s", "event_id", ["chapter_id"], first_if_none=True).drop("start_s")


@query(f"""
WITH {SEG}, {CHAP} SELECT c.user_id, chapter_id, count(*) AS n, min(s.event_id) AS first_event, max(s.event_id) AS last_event
FROM chap c JOIN seg s ON s.user_id = c.user_id AND s.start_s >= c.start_s AND s.start_s < coalesce(c.end_s, 'infinity'::DOUBLE) GROUP BY 1, 2
""")
def chapter_interval_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events that start within each chapter. Chapters of one user don't overlap, so the as-of owner is the interval's."""
    rows = segments(spark, sf_dir).select("user_id", "event_id", "start_s")
    owned = joins.asof(rows, chapters(spark, sf_dir), "user_id", "start_s", "event_id", ["chapter_id"]).where("chapter_id IS NOT NULL")
    return owned.groupBy("user_id", "chapter_id").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"), F.max("event_id").alias("last_event"))


@query(f"""
WITH {SEG}, {CHAP} SELECT c.user_id, c.chapter_id,
  (SELECT arg_max(event_id, (start_s, event_id)) FROM seg s WHERE s.user_id = c.user_id AND s.start_s < c.start_s) AS previous_event,
  (SELECT arg_min(event_id, (start_s, event_id)) FROM seg s WHERE s.user_id = c.user_id AND s.start_s >= c.end_s) AS next_event FROM chap c
""")
def chapter_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event before each chapter and the first one after it."""
    w = Window.partitionBy("user_id").orderBy("start_s", "event_id")
    rows = segments(spark, sf_dir).withColumn("previous_event", F.lag("event_id").over(w))
    heads = rows.where("event_type = 'signup'").select("user_id", "start_s", F.col("event_id").alias("chapter_id"), "previous_event")
    # the next chapter's own event is the first that starts at or after this one's end
    after = F.lead("chapter_id").over(Window.partitionBy("user_id").orderBy("start_s", "chapter_id"))
    return heads.select("user_id", "chapter_id", "previous_event", after.alias("next_event"))


@query(f"""
WITH {SEG}, {CHAP}, r AS (SELECT DISTINCT user_id, floor(start_s / {DAY * 5}) AS part FROM seg),
g AS (SELECT user_id, part, part * {DAY * 5} AS s, (part + 1) * {DAY * 5} AS e FROM r)
SELECT g.user_id, part::BIGINT AS part, string_agg(chapter_id, ',' ORDER BY c.start_s) AS chapter_ids FROM g JOIN chap c ON c.user_id = g.user_id AND c.start_s < g.e AND coalesce(c.end_s, 1e10) > g.s GROUP BY 1, 2
""")
def chapter_overlap_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chapters that overlap each stretch of five days, in order."""
    five = DAY * 5
    parts = segments(spark, sf_dir).select("user_id", F.floor(F.col("start_s") / five).alias("part")).distinct()
    parts = parts.withColumns({"l_start": F.col("part") * five, "l_end": (F.col("part") + 1) * five})
    marks = chapters(spark, sf_dir)
    end = F.lead("start_s").over(Window.partitionBy("user_id").orderBy("start_s", "chapter_id"))
    last = marks.join(parts.groupBy("user_id").agg(F.max("l_end").alias("stop")), "user_id")
    marks = last.select("user_id", "chapter_id", F.col("start_s").alias("r_start"), F.coalesce(end, "stop").alias("r_end"))
    met = joins.overlap(parts, marks, "user_id", five)
    ids = F.array_sort(F.collect_list(F.struct("r_start", "chapter_id")))
    return met.groupBy("user_id", "part").agg(ids.alias("i")).select("user_id", "part", F.array_join(F.transform("i", lambda x: x["chapter_id"].cast("string")), ",").alias("chapter_ids"))


@query(f"""
WITH {SEG}, {CHAP}, t AS (SELECT user_id, chapter_id, start_s - 43200 AS low, start_s + 43200 AS high FROM chap)
SELECT t.user_id, t.chapter_id, count(s.event_id) AS n, round(sum(s.value), 4) AS total FROM t JOIN seg s ON s.user_id = t.user_id AND s.end_s > t.low AND s.start_s < t.high GROUP BY 1, 2
""")
def context_window_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events within half a day of each chapter's start."""
    t = chapters(spark, sf_dir).select("user_id", "chapter_id", (F.col("start_s") - 43200).alias("l_start"), (F.col("start_s") + 43200).alias("l_end"))
    s = segments(spark, sf_dir).select("user_id", "event_id", "value", F.col("start_s").alias("r_start"), F.col("end_s").alias("r_end"))
    return joins.overlap(t, s, "user_id", DAY).groupBy("user_id", "chapter_id").agg(F.count("event_id").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query(f"""
WITH {SEG}, o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY start_s, event_id) AS pos FROM seg)
SELECT a.user_id, a.event_id, min(b.event_id) AS low, max(b.event_id) AS high, count(*) AS n FROM o a JOIN o b ON a.user_id = b.user_id AND b.pos BETWEEN a.pos - 2 AND a.pos + 2 GROUP BY 1, 2
""")
def candidate_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment candidates: two positions on either side."""
    w = Window.partitionBy("user_id").orderBy("start_s", "event_id").rowsBetween(-2, 2)
    return segments(spark, sf_dir).select("user_id", "event_id", F.min("event_id").over(w).alias("low"), F.max("event_id").over(w).alias("high"), F.count("*").over(w).alias("n"))


@query(f"""
WITH {SEG}, {CHAP}, b AS (SELECT user_id, chapter_id, (start_s + lag(start_s) OVER w) / 2 AS lo, (start_s + lead(start_s) OVER w) / 2 AS hi FROM chap WINDOW w AS (PARTITION BY user_id ORDER BY start_s, chapter_id))
SELECT b.user_id, b.chapter_id, count(*) AS n_words, round(sum(s.value * 100))::BIGINT AS hundredths FROM b JOIN seg s ON s.user_id = b.user_id
  AND (s.start_s + s.end_s) / 2 >= coalesce(b.lo, '-infinity'::DOUBLE) AND (s.start_s + s.end_s) / 2 < coalesce(b.hi, 'infinity'::DOUBLE) GROUP BY 1, 2
""")
def midpoint_word_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event's midpoint belongs to the nearest chapter start; the bounds lie halfway between starts and are exclusive."""
    w = Window.partitionBy("user_id").orderBy("start_s", "chapter_id")
    bounds = chapters(spark, sf_dir).withColumn("at", (F.col("start_s") + F.lag("start_s").over(w)) / 2)
    bounds = bounds.select("user_id", "chapter_id", F.coalesce("at", F.lit(float("-inf"))).alias("at"))
    words = segments(spark, sf_dir).select("user_id", "event_id", "value", ((F.col("start_s") + F.col("end_s")) / 2).alias("at"))
    owned = joins.asof(words, bounds, "user_id", "at", "event_id", ["chapter_id"]).where("chapter_id IS NOT NULL")
    return owned.groupBy("user_id", "chapter_id").agg(F.count("*").alias("n_words"), F.round(F.sum(F.col("value") * 100)).cast("long").alias("hundredths"))


@query("""
SELECT s_suppkey, string_agg(p_partkey, ',' ORDER BY pos) AS found, count(*) FILTER (WHERE p_partkey IS NULL) AS missing FROM (
  SELECT s_suppkey, unnest([s_suppkey * 3, s_suppkey * 7, s_suppkey * 7, s_suppkey * 31]) AS id, generate_subscripts([1, 2, 3, 4], 1) AS pos FROM supplier) x LEFT JOIN part ON p_partkey = id GROUP BY 1
""")
def ordered_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of ids to rows, in the lists' order, unknown ids counted."""
    ids = F.array(F.col("s_suppkey") * 3, F.col("s_suppkey") * 7, F.col("s_suppkey") * 7, F.col("s_suppkey") * 31)
    flat = table(spark, sf_dir, "supplier").select("s_suppkey", F.posexplode(ids).alias("pos", "id"))
    got = flat.join(table(spark, sf_dir, "part").select("p_partkey"), F.col("id") == F.col("p_partkey"), "left")
    found = F.array_sort(F.collect_list(F.when(F.col("p_partkey").isNotNull(), F.struct("pos", "p_partkey"))))
    out = got.groupBy("s_suppkey").agg(found.alias("f"), F.count_if(F.col("p_partkey").isNull()).alias("missing"))
    joined = F.array_join(F.transform("f", lambda x: x["p_partkey"].cast("string")), ",")
    return out.select("s_suppkey", F.when(F.size("f") > 0, joined).alias("found"), "missing")


@query("""
WITH o AS (SELECT s_suppkey AS k, s_name AS name, s_acctbal AS bal FROM supplier WHERE s_suppkey % 2 = 0), p AS (SELECT c_custkey AS k, c_name AS name, c_acctbal AS bal FROM customer WHERE c_custkey % 3 = 0)
SELECT coalesce(o.k, p.k) AS k, coalesce(p.name, o.name) AS name, coalesce(p.bal, o.bal) AS bal, CASE WHEN o.k IS NULL THEN 'patch' WHEN p.k IS NULL THEN 'base' ELSE 'both' END AS origin FROM o FULL JOIN p ON o.k = p.k
""")
def override_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two catalogues as one: the published side wins, and rows of either side stay."""
    base = table(spark, sf_dir, "supplier").where("s_suppkey % 2 = 0").selectExpr("s_suppkey AS k", "s_name AS name", "s_acctbal AS bal")
    patch = table(spark, sf_dir, "customer").where("c_custkey % 3 = 0").selectExpr("c_custkey AS k", "c_name AS name", "c_acctbal AS bal")
    return joins.override(base, patch, "k", ["name", "bal"])


@query("""
SELECT o.o_orderkey, o.o_totalprice >= 300000 AS targeted, CASE WHEN o.o_totalprice >= 300000 THEN 'new' WHEN l.f IS NOT DISTINCT FROM o.o_orderstatus THEN 'kept' ELSE 'stale' END AS state
FROM orders o LEFT JOIN (SELECT l_orderkey, min(l_linestatus) AS f FROM lineitem GROUP BY 1) l ON l.l_orderkey = o.o_orderkey
""")
def carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targeted rows are replaced; others keep their selection while the key and the fingerprint still match, else are stale."""
    kept = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min("l_linestatus").alias("f"))
    o = table(spark, sf_dir, "orders").join(kept, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    targeted = F.col("o_totalprice") >= 300000
    state = F.when(targeted, "new").when(F.col("f").eqNullSafe(F.col("o_orderstatus")), "kept").otherwise("stale")
    return o.select("o_orderkey", targeted.alias("targeted"), state.alias("state"))


@query("""
WITH s AS (SELECT DISTINCT l_suppkey, l_partkey AS e FROM lineitem), p AS (SELECT DISTINCT p_size, p_partkey AS e FROM part),
c AS (SELECT l_suppkey, p_size, count(*) AS n_common FROM s JOIN p USING (e) GROUP BY 1, 2), n AS (SELECT l_suppkey, count(*) AS n FROM s GROUP BY 1),
r AS (SELECT *, rank() OVER (PARTITION BY l_suppkey ORDER BY n_common DESC) AS k, count(*) OVER (PARTITION BY l_suppkey, n_common) AS ties FROM c JOIN n USING (l_suppkey))
SELECT l_suppkey, p_size, n_common FROM r WHERE k = 1 AND ties = 1 AND n_common / n >= 0.02
""")
def max_overlap_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The size group whose parts a supplier's lines share most: none at a tie or under a fiftieth."""
    s = table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_partkey").alias("e"))
    p = table(spark, sf_dir, "part").select("p_size", F.col("p_partkey").alias("e"))
    n = s.groupBy("l_suppkey").agg(F.count_distinct("e").alias("n"))
    pairs = joins.set_overlaps(s, p, "e", "l_suppkey", "p_size").join(n, "l_suppkey")
    best = joins.unique_best(pairs, ["l_suppkey"], [F.desc("n_common"), F.col("p_size")], [F.col("n_common")])
    return best.where("n_common / n >= 0.02").select("l_suppkey", "p_size", "n_common")


_SETS = "s AS (SELECT l_orderkey, list_sort(list(DISTINCT l_suppkey)) AS ids FROM lineitem GROUP BY 1)"


@query(f"""WITH {_SETS}, k AS (SELECT ids, count(*) AS n_orders, min(l_orderkey) AS first_order FROM s GROUP BY ids HAVING count(*) > 1) SELECT array_to_string(ids, ',') AS ids, n_orders, first_order FROM k""")
def set_equality_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with exactly the same set of suppliers, as groups instead of pairs."""
    sets = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_set("l_suppkey")), ",").alias("ids"))
    return sets.groupBy("ids").agg(F.count("*").alias("n_orders"), F.min("l_orderkey").alias("first_order")).where("n_orders > 1")


@query("""
WITH e AS (SELECT DISTINCT l_orderkey AS o, l_suppkey AS s FROM lineitem), n AS (SELECT o, count(*) AS n FROM e GROUP BY 1),
c AS (SELECT a.o AS a, b.o AS b, count(*) AS n_common FROM e a JOIN e b ON a.s = b.s AND a.o < b.o AND a.o // 64 = b.o // 64 GROUP BY 1, 2)
SELECT a, b, n_common FROM c JOIN n x ON x.o = a JOIN n y ON y.o = b WHERE n_common / least(x.n, y.n) >= 0.5
""")
def pairwise_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of sections of one document (64 orders) that share half of the smaller one's members."""
    e = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS o", "l_suppkey AS s").distinct()
    n = e.groupBy("o").agg(F.count("*").alias("n"))
    e = e.withColumn("doc", F.expr("o div 64"))
    c = e.withColumnRenamed("o", "a").join(e.withColumnRenamed("o", "b"), ["doc", "s"]).where("a < b").groupBy("a", "b").agg(F.count("*").alias("n_common"))
    c = c.join(n.select(F.col("o").alias("a"), F.col("n").alias("na")), "a").join(n.select(F.col("o").alias("b"), F.col("n").alias("nb")), "b")
    return c.where(F.col("n_common") / F.least("na", "nb") >= 0.5).select("a", "b", "n_common")


@query("""
WITH s AS (SELECT l_orderkey, list(DISTINCT l_returnflag || l_linestatus) AS ids FROM lineitem GROUP BY 1), p AS (SELECT l_orderkey, ids, lag(ids) OVER (PARTITION BY l_orderkey // 100 ORDER BY l_orderkey) AS b FROM s)
SELECT l_orderkey, len(list_intersect(ids, b))::BIGINT AS n_common FROM p WHERE b IS NOT NULL AND len(list_intersect(ids, b)) / least(len(ids), len(b)) >= 0.8
""")
def adjacent_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring sections that share four fifths of the smaller one."""
    s = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.concat("l_returnflag", "l_linestatus")).alias("ids"))
    p = s.withColumn("b", F.lag("ids").over(Window.partitionBy(F.expr("l_orderkey div 100")).orderBy("l_orderkey"))).where("b IS NOT NULL")
    common = F.size(F.array_intersect("ids", "b"))
    return p.where(common / F.least(F.size("ids"), F.size("b")) >= 0.8).select("l_orderkey", common.cast("long").alias("n_common"))


@query("""
SELECT 'order_without_lines' AS rule, o_orderkey AS id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
UNION ALL SELECT DISTINCT 'line_without_order', l_orderkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT 'order_without_customer', o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
UNION ALL SELECT 'customer_with_orders', c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)
""")
def integrity_semi_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References that lead nowhere, and those that are used."""
    o, l, c = (table(spark, sf_dir, t) for t in ("orders", "lineitem", "customer"))
    rule = lambda df, name, key: df.select(F.lit(name).alias("rule"), F.col(key).alias("id"))
    n, buyers = pieces(l), o.select("o_orderkey", "o_custkey").repartition(pieces(o), "o_custkey")
    o, l, c = o.select("o_orderkey").repartition(n, "o_orderkey"), l.select("l_orderkey").repartition(n, "l_orderkey").distinct(), c.select("c_custkey").repartition(pieces(o), "c_custkey")
    return (
        rule(o.join(l, o["o_orderkey"] == l["l_orderkey"], "left_anti"), "order_without_lines", "o_orderkey")
        .union(rule(l.join(o, o["o_orderkey"] == l["l_orderkey"], "left_anti"), "line_without_order", "l_orderkey"))
        .union(rule(buyers.join(c, buyers["o_custkey"] == c["c_custkey"], "left_anti"), "order_without_customer", "o_orderkey"))
        .union(rule(c.join(buyers, buyers["o_custkey"] == c["c_custkey"], "left_semi"), "customer_with_orders", "c_custkey"))
    )


@query("""
WITH l AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line FROM documents),
c AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE line = upper(line)) AS n_upper FROM l GROUP BY 1)
SELECT doc_id, CASE WHEN quality = 0 AND toxic = 1 THEN 0 WHEN quality = 0 THEN 1 WHEN toxic = 1 THEN 2 ELSE 3 END::BIGINT AS severity,
 CASE WHEN quality = 0 AND toxic = 1 THEN 'blocking' WHEN quality = 0 THEN 'needs review' WHEN toxic = 1 THEN 'check wording' ELSE 'fine' END AS reason, n_lines, n_upper
FROM documents JOIN c USING (doc_id) LEFT JOIN labels USING (doc_id) WHERE quality = 0 OR toxic = 1 OR n_upper > 0
""")
def review_items_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What there is to review: documents with their labels and line findings, severity and reason."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    c = d.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count_if(F.col("line") == F.upper("line")).alias("n_upper"))
    j = c.join(table(spark, sf_dir, "labels"), "doc_id", "left")
    bad, toxic = F.col("quality") == 0, F.col("toxic") == 1
    severity = F.when(bad & toxic, 0).when(bad, 1).when(toxic, 2).otherwise(3)
    reason = F.when(bad & toxic, "blocking").when(bad, "needs review").when(toxic, "check wording").otherwise("fine")
    return j.where(bad | toxic | (F.col("n_upper") > 0)).select("doc_id", severity.cast("long").alias("severity"), reason.alias("reason"), "n_lines", "n_upper")


@query("""SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders WHERE o_orderstatus = 'F') WHERE k = 1""")
def latest_gold_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest finished order of each customer."""
    done = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    newest = F.max_by(F.struct("o_orderkey", "o_totalprice"), F.struct("o_orderdate", "o_orderkey"))
    return done.groupBy("o_custkey").agg(newest.alias("x")).select("o_custkey", "x.o_orderkey", "x.o_totalprice")


@query("""
WITH n AS (SELECT DISTINCT p_name, lower(replace(p_name, ' ', '')) AS k FROM part), c AS (SELECT p_name, count(*) AS n FROM part GROUP BY 1),
p AS (SELECT a.p_name AS observed, b.p_name AS canonical, levenshtein(a.k, b.k) AS distance, c.n AS support FROM n a JOIN n b ON length(a.k) = length(b.k) AND a.p_name <> b.p_name JOIN c ON c.p_name = b.p_name),
q AS (SELECT *, row_number() OVER w AS r, lead((distance, support)) OVER w AS nxt FROM p WHERE distance BETWEEN 1 AND 2 WINDOW w AS (PARTITION BY observed ORDER BY distance, support DESC, canonical))
SELECT observed, canonical, distance::BIGINT AS distance FROM q WHERE r = 1 AND nxt IS DISTINCT FROM (distance, support)
""")
def fuzzy_unique_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each name's nearest other name of the same length, within two edits; none where two are equally good."""
    names = table(spark, sf_dir, "part").groupBy("p_name").agg(F.count("*").alias("support")).withColumn("k", F.lower(F.replace("p_name", F.lit(" "), F.lit(""))))
    a = names.select(F.col("p_name").alias("observed"), F.col("k").alias("ka"))
    b = names.select(F.col("p_name").alias("canonical"), F.col("k").alias("kb"), "support")
    pairs = joins.near_names(a, b, "ka", "kb", 2)
    best = joins.unique_best(pairs, ["observed"], [F.col("distance"), F.desc("support"), F.col("canonical")], [F.col("distance"), F.col("support")])
    return best.select("observed", "canonical", F.col("distance").cast("long").alias("distance"))


@query("""
WITH a AS (SELECT 'en' AS base, 'eng_Latn' AS code UNION ALL VALUES ('fr', 'fra_Latn'), ('es', 'spa_Latn'))
SELECT doc_id, coalesce(x.code, y.code, 'unknown') AS code FROM documents d LEFT JOIN a x ON x.base = d.lang || '-' || d.source LEFT JOIN a y ON y.base = split_part(d.lang, '-', 1)
""")
def language_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language codes by the full key, else by the base language, else unknown."""
    known = spark.createDataFrame([("en", "eng_Latn"), ("fr", "fra_Latn"), ("es", "spa_Latn")], "base string, code string")
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    full = known.select(F.col("base").alias("b1"), F.col("code").alias("c1"))
    base = known.select(F.col("base").alias("b2"), F.col("code").alias("c2"))
    j = d.join(full, F.concat_ws("-", "lang", "source") == F.col("b1"), "left").join(base, F.split_part("lang", F.lit("-"), F.lit(1)) == F.col("b2"), "left")
    return j.select("doc_id", F.coalesce("c1", "c2", F.lit("unknown")).alias("code"))


@query("""
WITH t AS (SELECT doc_id, unnest(['tion', 'the', 'ou']) AS tool, lower(text) AS x FROM documents)
SELECT tool, count(*) AS n_docs, array_to_string(list(doc_id ORDER BY doc_id)[1:6], ',') AS first_ids FROM t WHERE contains(x, ' ' || tool || ' ') GROUP BY 1
""")
def alias_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that mention each alias of a small dimension, with the first six ids.

    Spark limits each task's rows of an alias to six before it shuffles them for the ranking.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", F.lower("text").alias("x"))
    aliases = F.array(*[F.lit(a) for a in ("tion", "the", "ou")])
    hits = docs.select("doc_id", F.explode(F.filter(aliases, lambda a: F.contains(F.col("x"), F.concat(F.lit(" "), a, F.lit(" "))))).alias("tool"))
    top = F.row_number().over(Window.partitionBy("tool").orderBy("doc_id"))
    first = hits.withColumn("k", top).where("k <= 6").groupBy("tool").agg(F.array_join(F.array_sort(F.collect_list("doc_id")), ",").alias("first_ids"))
    return hits.groupBy("tool").agg(F.count("*").alias("n_docs")).join(first, "tool")


@query(f"""
WITH {SEG}, {CHAP}, s AS (SELECT s.user_id, s.event_id, a.chapter_id AS by_start, b.chapter_id AS by_end, s.value FROM seg s
 ASOF LEFT JOIN chap a ON s.user_id = a.user_id AND s.start_s >= a.start_s ASOF LEFT JOIN chap b ON s.user_id = b.user_id AND s.end_s - 0.001 >= b.start_s)
SELECT user_id, event_id, CASE WHEN by_start IS NOT DISTINCT FROM by_end THEN by_start WHEN value >= 100 THEN by_end ELSE by_start END AS owner FROM s
""")
def boundary_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owner by start, or by end where the two differ and the row belongs to the right (here: a large value)."""
    rows = segments(spark, sf_dir).select("user_id", "event_id", "value", "start_s", "end_s")
    marks = chapters(spark, sf_dir).select("user_id", F.col("start_s").alias("at"), "chapter_id")
    left = joins.asof(rows.withColumn("at", F.col("start_s")), marks.withColumnRenamed("chapter_id", "by_start"), "user_id", "at", "event_id", ["by_start"])
    both = joins.asof(left.withColumn("at", F.col("end_s") - 0.001), marks.withColumnRenamed("chapter_id", "by_end"), "user_id", "at", "event_id", ["by_end"])
    owner = F.when(F.col("by_start").eqNullSafe(F.col("by_end")), F.col("by_start")).when(F.col("value") >= 100, F.col("by_end")).otherwise(F.col("by_start"))
    return both.select("user_id", "event_id", owner.alias("owner"))
