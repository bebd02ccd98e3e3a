"""Queries of membership, validation, entity and document-draft operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandloom.operators import islands, members
from strandloom.plans.registry import query
from strandloom.plans.tables import pieces, table


@query("""SELECT user_id, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events) WHERE k = 1""")
def keep_first_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first event of each type of each user."""
    first = F.min_by(F.struct("event_id", "ts"), F.struct("ts", "event_id"))
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(first.alias("x")).select("user_id", "x.event_id", "x.ts")


_SECT = """l AS (SELECT l_orderkey AS o, l_linenumber AS pos, count(*) AS c FROM lineitem GROUP BY 1, 2),
s AS (SELECT l_orderkey AS o, min(l_linenumber) FILTER (WHERE l_returnflag = 'A') AS f, max(l_linenumber) FILTER (WHERE l_returnflag = 'A') AS t FROM lineitem GROUP BY 1
 UNION ALL SELECT l_orderkey, min(l_linenumber) FILTER (WHERE l_returnflag = 'N'), max(l_linenumber) FILTER (WHERE l_returnflag = 'N') FROM lineitem GROUP BY 1)"""


@query(f"""
WITH {_SECT}, e AS (SELECT o, unnest(range(f, t + 1))::INT AS pos FROM s WHERE f IS NOT NULL), n AS (SELECT o, pos, count(*) AS n FROM e GROUP BY 1, 2)
SELECT coalesce(l.o, n.o) AS o, coalesce(l.pos, n.pos) AS pos, CASE WHEN l.o IS NULL THEN 'unknown' WHEN n IS NULL THEN 'gap' ELSE 'overlap' END AS problem FROM l FULL JOIN n ON l.o = n.o AND l.pos = n.pos WHERE l.o IS NULL OR n IS NULL OR n > 1
""")
def exact_cover_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line positions of an order that its two sections leave out, share or make up."""
    l = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("pos"), "l_returnflag")
    n = pieces(l)
    l = l.repartition(n, "o")
    s = l.where("l_returnflag IN ('A', 'N')").groupBy("o", "l_returnflag").agg(F.min("pos").alias("f"), F.max("pos").alias("t"))
    return members.cover_violations(s, l.select("o", "pos").distinct(), ["o"], "f", "t", "pos", n)


@query("""
WITH a AS (SELECT DISTINCT o_custkey AS id FROM orders), u AS (SELECT DISTINCT c_custkey AS id FROM customer WHERE c_acctbal >= 2000), e AS (SELECT DISTINCT c_custkey AS id FROM customer WHERE c_acctbal < 2500 AND c_custkey % 3 > 0)
SELECT id, CASE WHEN id NOT IN (SELECT id FROM a) THEN 'foreign' WHEN id IN (SELECT id FROM u) THEN 'in_both' ELSE 'unaccounted' END AS problem FROM (SELECT id FROM a UNION SELECT id FROM u UNION SELECT id FROM e) x
WHERE id NOT IN (SELECT id FROM a) OR (id IN (SELECT id FROM u) AND id IN (SELECT id FROM e)) OR (id NOT IN (SELECT id FROM u) AND id NOT IN (SELECT id FROM e))
""")
def accounting_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with orders against those used and those excluded."""
    c = table(spark, sf_dir, "customer")
    allowed = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"))
    used = c.where("c_acctbal >= 2000").select(F.col("c_custkey").alias("id"))
    excluded = c.where("c_acctbal < 2500 AND c_custkey % 3 > 0").select(F.col("c_custkey").alias("id"))
    return members.accounting(allowed, used, excluded, ["id"])


@query("""SELECT p_partkey, string_agg(DISTINCT l_suppkey, ',' ORDER BY l_suppkey) AS suppliers, count(DISTINCT l_suppkey) AS n FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY 1""")
def membership_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part with the ordered ids of those that have it."""
    pairs = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct()
    g = pairs.groupBy("l_partkey").agg(F.array_join(F.array_sort(F.collect_list("l_suppkey")), ",").alias("suppliers"), F.count("*").alias("n"))
    p = table(spark, sf_dir, "part").select("p_partkey").join(g, F.col("p_partkey") == F.col("l_partkey"), "left")
    return p.select("p_partkey", "suppliers", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


@query("""SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""")
def duplicate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).where("n > 1")


@query("""
WITH i AS (SELECT l_orderkey, l_suppkey FROM lineitem WHERE l_returnflag = 'A' UNION SELECT l_orderkey, l_suppkey FROM lineitem WHERE l_quantity >= 30)
SELECT l_orderkey, string_agg(l_suppkey, ',' ORDER BY l_suppkey) AS ids FROM i GROUP BY 1
""")
def union_of_id_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")
    i = l.where("l_returnflag = 'A' OR l_quantity >= 30").select("l_orderkey", "l_suppkey").distinct()
    return i.groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_list("l_suppkey")), ",").alias("ids"))


@query("""
WITH f AS (SELECT p_brand, list(DISTINCT p_name) AS s FROM part GROUP BY 1), a AS (SELECT list(DISTINCT p_name) AS s FROM part WHERE p_type = 'PROMO')
SELECT p_brand, round(len(list_intersect(f.s, a.s)) / (len(f.s) + len(a.s) - len(list_intersect(f.s, a.s))), 6) AS jaccard FROM f, a
""")
def jaccard_to_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How alike each brand's name set and the promoted one are."""
    p = table(spark, sf_dir, "part").select("p_brand", "p_name", "p_type")
    profile = p.where("p_type = 'PROMO'").select("p_name").distinct().withColumn("_in", F.lit(True))
    n = profile.agg(F.count("*").alias("n_profile"))  # one row
    g = p.select("p_brand", "p_name").distinct().join(profile, "p_name", "left").groupBy("p_brand").agg(F.count("*").alias("own"), F.count("_in").alias("both"))
    return g.crossJoin(F.broadcast(n)).select("p_brand", F.round(F.col("both") / (F.col("own") + F.col("n_profile") - F.col("both")), 6).alias("jaccard"))


@query("""
WITH RECURSIVE n AS (SELECT p_name, count(*) AS c FROM (SELECT p_name FROM part UNION ALL SELECT substr(p_name, 2) || 'y' FROM part WHERE p_partkey % 3 = 0) GROUP BY 1), e AS (SELECT a.p_name AS a, b.p_name AS b FROM n a JOIN n b ON a.p_name <> b.p_name AND levenshtein(a.p_name, b.p_name) <= 3),
r AS (SELECT p_name AS x, p_name AS y FROM n UNION SELECT r.x, e.b FROM r JOIN e ON e.a = r.y)
SELECT x AS name, min(y) AS component, arg_max(y, (c, -length(y), y)) AS representative FROM r JOIN n ON n.p_name = y GROUP BY 1
""")
def variant_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants (three edits) as connected components, each with its most used form; some names stand with another spelling too."""
    p = table(spark, sf_dir, "part")
    names = p.select(F.col("p_name").alias("name")).union(p.where("p_partkey % 3 = 0").select(F.concat(F.expr("substring(p_name, 2)"), F.lit("y"))))
    n = names.groupBy("name").agg(F.count("*").alias("c"))
    edges = members.edit_candidates(n, "name").where(F.levenshtein("a", "b") <= 3)
    labels = members.components(edges)
    of = n.join(labels, n["name"] == labels["node"], "left").select("name", "c", F.coalesce("label", "name").alias("component"))
    best = of.groupBy("component").agg(F.max_by("name", F.struct("c", -F.char_length("name"), "name")).alias("representative"))
    return of.join(best, "component").select("name", "component", "representative")


@query("""
WITH s AS (SELECT p_name, p_type, sum(p_size)::BIGINT AS score FROM part GROUP BY 1, 2), k AS (SELECT lower(replace(p_name, ' ', '')) AS key, p_name, max(score) AS score FROM s GROUP BY 1, 2)
SELECT key, arg_max(p_name, (score, length(p_name), p_name)) AS official, max(score) AS score, (SELECT count(DISTINCT p_type) FROM s WHERE lower(replace(s.p_name, ' ', '')) = k.key) AS n_kinds FROM k GROUP BY 1
""")
def official_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms of one squeezed key: the best one stands for all, scores become the greatest, kinds are united."""
    s = table(spark, sf_dir, "part").groupBy("p_name", "p_type").agg(F.sum("p_size").alias("score")).withColumn("key", F.lower(F.replace("p_name", F.lit(" "), F.lit(""))))
    best = F.max_by("p_name", F.struct("score", F.char_length("p_name"), "p_name"))
    return s.groupBy("key").agg(best.alias("official"), F.max("score").alias("score"), F.count_distinct("p_type").alias("n_kinds"))


@query("""
SELECT p_name, min(p_retailprice) AS price FROM part WHERE lower(p_name) NOT IN (SELECT lower(p_name) FROM part WHERE p_type = 'ECONOMY' AND p_size > 48) AND regexp_matches(p_name, '^[a-z]+ [a-z]{4,}$') GROUP BY 1 HAVING count(DISTINCT p_type) >= 3
""")
def verified_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of the right shape, of three kinds at least, that no weak surface form equals."""
    p = table(spark, sf_dir, "part")
    weak = p.where("p_type = 'ECONOMY' AND p_size > 48").select(F.lower("p_name").alias("w")).distinct()
    strong = p.where(F.col("p_name").rlike("^[a-z]+ [a-z]{4,}$")).groupBy("p_name").agg(F.min("p_retailprice").alias("price"), F.count_distinct("p_type").alias("k")).where("k >= 3").drop("k")
    return strong.join(weak, F.lower("p_name") == F.col("w"), "left_anti")


@query("""
SELECT o_orderkey AS id, rule FROM (SELECT o_orderkey, unnest([CASE WHEN o_totalprice <= 2000 THEN 'price_too_small' END, CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '1-URGENT' THEN 'urgent_pending' END, CASE WHEN o_custkey IS NULL THEN 'no_customer' END, CASE WHEN year(o_orderdate) > 1999 THEN 'too_late' END]) AS rule FROM orders) WHERE rule IS NOT NULL
""")
def chapter_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules that a row breaks, one row for each."""
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "id")
    rules = {"price_too_small": F.col("o_totalprice") <= 2000, "urgent_pending": (F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") == "1-URGENT"), "no_customer": F.col("o_custkey").isNull(), "too_late": F.year("o_orderdate") > 1999}
    return members.violations(o, ["id"], rules)


_STEP_RULES = {
    "quantity_not_positive": "l_quantity <= 0",
    "quantity_too_large": "l_quantity > 49",
    "price_not_positive": "l_extendedprice <= 0",
    "unit_price_too_low": "l_extendedprice / l_quantity < 20",
    "discount_out_of_range": "l_discount < 0 OR l_discount > 0.1",
    "tax_out_of_range": "l_tax < 0 OR l_tax > 0.08",
    "unknown_line_status": "l_linestatus NOT IN ('O', 'F')",
    "unknown_return_flag": "l_returnflag NOT IN ('R', 'A', 'N')",
    "returned_but_open": "l_returnflag = 'R' AND l_linestatus = 'O'",
    "number_not_positive": "l_linenumber < 1",
    "number_too_large": "l_linenumber > 6",
}
_PACKAGE_RULES = {
    "steps_empty": "n = 0",
    "too_many_steps": "n > 6",
    "duplicate_numbers": "n > n_numbers",
    "numbering_gap": "last > n_numbers",
    "numbering_starts_late": "n > 0 AND first <> 1",
    "mixed_status": "n_status > 1",
    "total_not_positive": "o_totalprice <= 0",
    "unknown_status": "o_orderstatus NOT IN ('O', 'F', 'P')",
    "priority_missing": "o_orderpriority IS NULL OR o_orderpriority = ''",
    "pending_but_urgent": "o_orderstatus = 'P' AND o_orderpriority = '1-URGENT'",
}
_RULES_SQL = lambda rules: ", ".join(f"CASE WHEN {test} THEN '{name}' END" for name, test in rules.items())


@query(f"""
WITH s AS (SELECT l_orderkey AS id, l_linenumber AS nth, unnest([{_RULES_SQL(_STEP_RULES)}]) AS rule FROM lineitem),
g AS (SELECT o_orderkey AS id, any_value(o_totalprice) AS o_totalprice, any_value(o_orderstatus) AS o_orderstatus, any_value(o_orderpriority) AS o_orderpriority, count(l_linenumber) AS n, count(DISTINCT l_linenumber) AS n_numbers, min(l_linenumber) AS first, max(l_linenumber) AS last, count(DISTINCT l_linestatus) AS n_status FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1),
p AS (SELECT id, 0 AS nth, unnest([{_RULES_SQL(_PACKAGE_RULES)}]) AS rule FROM g)
SELECT id, nth, rule FROM s WHERE rule IS NOT NULL UNION ALL SELECT id, nth, rule FROM p WHERE rule IS NOT NULL
UNION ALL SELECT l_orderkey, l_linenumber, 'unknown_part' FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 1)
UNION ALL SELECT l_orderkey, l_linenumber, 'unknown_supplier' FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > -900)
UNION ALL SELECT o_orderkey, 0, 'unknown_customer' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > -900)
""")
def package_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with published packages: rules on each step and on each package in a pass of their own, and references that lead nowhere."""
    l, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    tests = lambda rules: {name: F.expr(test) for name, test in rules.items()}
    steps = members.violations(l.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("nth"), "*"), ["id", "nth"], tests(_STEP_RULES))
    per = l.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.count_distinct("l_linenumber").alias("n_numbers"), F.min("l_linenumber").alias("first"), F.max("l_linenumber").alias("last"), F.count_distinct("l_linestatus").alias("n_status"))
    g = o.join(per, F.col("l_orderkey") == F.col("o_orderkey"), "left").fillna(0, ["n", "n_numbers"]).withColumnRenamed("o_orderkey", "id").withColumn("nth", F.lit(0))
    packages = members.violations(g, ["id", "nth"], tests(_PACKAGE_RULES))

    def lost(rows: DataFrame, key: str, known: DataFrame, rule: str) -> DataFrame:
        return rows.join(known, F.col(key) == F.col(known.columns[0]), "left_anti").select("id", "nth", F.lit(rule).alias("rule"))

    ids = l.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("nth"), "l_partkey", "l_suppkey")
    part = table(spark, sf_dir, "part").where("p_size > 1").select("p_partkey")
    supplier = table(spark, sf_dir, "supplier").where("s_acctbal > -900").select("s_suppkey")
    customer = table(spark, sf_dir, "customer").where("c_acctbal > -900").select("c_custkey")
    orders = o.select(F.col("o_orderkey").alias("id"), F.lit(0).alias("nth"), "o_custkey")
    out = steps.unionByName(packages).unionByName(lost(ids, "l_partkey", part, "unknown_part"))
    return out.unionByName(lost(ids, "l_suppkey", supplier, "unknown_supplier")).unionByName(lost(orders, "o_custkey", customer, "unknown_customer"))


@query("""
WITH s AS (SELECT conv_id, turn, lead(turn) OVER w AS nxt, lag(turn) OVER w AS prv, row_number() OVER w AS k, role FROM conversations WHERE role <> 'assistant' WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, rule FROM (SELECT conv_id, turn, unnest([CASE WHEN k = 1 AND turn <> 0 THEN 'first_is_not_first_row' END, CASE WHEN prv IS NOT NULL AND turn <= prv THEN 'not_increasing' END, CASE WHEN nxt IS NOT NULL AND nxt - turn > 2 THEN 'long_section' END, CASE WHEN role = 'system' AND turn > 0 THEN 'late_system' END]) AS rule FROM s) WHERE rule IS NOT NULL
""")
def segmentation_answer_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Section starts that don't begin with the first row, don't increase, or leave long sections."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    s = table(spark, sf_dir, "conversations").where("role <> 'assistant'").withColumns({"nxt": F.lead("turn").over(w), "prv": F.lag("turn").over(w), "k": F.row_number().over(w)})
    rules = {"first_is_not_first_row": (F.col("k") == 1) & (F.col("turn") != 0), "not_increasing": F.col("turn") <= F.col("prv"), "long_section": F.col("nxt") - F.col("turn") > 2, "late_system": (F.col("role") == "system") & (F.col("turn") > 0)}
    return members.violations(s, ["conv_id", "turn"], rules)


@query("""
SELECT kind, severity, count(*) AS n FROM (SELECT 'quality' AS kind, CASE WHEN toxic = 1 THEN 'blocking' ELSE 'warning' END AS severity FROM labels WHERE quality = 0 UNION ALL SELECT 'toxic', 'warning' FROM labels WHERE toxic = 1) GROUP BY 1, 2
""")
def review_queue_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "labels")
    q = l.where("quality = 0").select(F.lit("quality").alias("kind"), F.when(F.col("toxic") == 1, "blocking").otherwise("warning").alias("severity"))
    return q.union(l.where("toxic = 1").select(F.lit("toxic"), F.lit("warning"))).groupBy("kind", "severity").agg(F.count("*").alias("n"))


@query("""
SELECT doc_id, CASE WHEN d.doc_id % 7 = 0 THEN 'existing' WHEN l.quality = 1 THEN 'passthrough' WHEN lang = 'en' AND n_chars >= 2000 THEN 'model' WHEN lang = 'en' THEN 'runs' ELSE 'seed' END AS policy FROM documents d LEFT JOIN labels l USING (doc_id)
""")
def policy_router(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which way a document takes: existing, verified, by model, by runs, or one seed chapter."""
    j = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    en = F.col("lang") == "en"
    policy = F.when(F.col("doc_id") % 7 == 0, "existing").when(F.col("quality") == 1, "passthrough").when(en & (F.col("n_chars") >= 2000), "model").when(en, "runs").otherwise("seed")
    return j.select("doc_id", policy.alias("policy"))


@query("""
WITH v AS (SELECT o_custkey, count(*) FILTER (WHERE o_totalprice < 5000) AS bad FROM orders GROUP BY 1)
SELECT o_custkey, o_orderkey, CASE WHEN bad = 0 THEN 'answer' ELSE 'fallback' END AS source, CASE WHEN bad = 0 THEN row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) ELSE 1 END AS section FROM orders JOIN v USING (o_custkey)
""")
def apply_or_fall_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A key's answer is taken whole if none of its rows breaks a rule; else all its rows fall back to one section."""
    w = Window.partitionBy("o_custkey")
    o = table(spark, sf_dir, "orders").withColumns({"bad": F.count_if(F.col("o_totalprice") < 5000).over(w), "nth": F.row_number().over(w.orderBy("o_orderdate", "o_orderkey"))})
    good = F.col("bad") == 0
    return o.select("o_custkey", "o_orderkey", F.when(good, "answer").otherwise("fallback").alias("source"), F.when(good, F.col("nth")).otherwise(1).cast("long").alias("section"))


@query("""
WITH p AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_quantity FROM lineitem WHERE NOT (l_quantity < 5)), m AS (SELECT l_orderkey, CASE WHEN l_linenumber = 2 THEN 1 ELSE l_linenumber END AS part, l_suppkey FROM p),
s AS (SELECT l_orderkey, part, min(l_suppkey) AS first_id, count(*) AS n FROM m GROUP BY 1, 2)
SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY part) AS new_order, n, first_id FROM s
""")
def draft_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A draft after its edits: small steps deleted, part two merged into part one, parts numbered anew."""
    from strandloom.operators import drafts

    steps = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("draft"), F.col("l_linenumber").alias("part"), F.col("l_suppkey").alias("step"), "l_quantity")
    steps = drafts.delete_steps(steps, F.col("l_quantity") < 5)
    steps = drafts.merge_parts(steps, into=1, part=2)
    parts = steps.groupBy("draft", "part").agg(F.min("step").alias("first_id"), F.count("*").alias("n"))
    parts = drafts.renumber(parts, "draft", [F.col("part")], "new_order")
    return parts.select(F.col("draft").alias("l_orderkey"), "new_order", "n", "first_id")


@query("""
SELECT o_orderkey, l_linenumber, 'step ' || l_linenumber AS label, round(l_extendedprice, 2) AS price, strftime(o_orderdate, '%Y.%m.%d') AS date_label, l_discount > 0.05 AS featured FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F'
""")
def publish_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The published view of finished drafts: labels and dates, review fields gone."""
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    l = table(spark, sf_dir, "lineitem")
    j = o.join(l, o["o_orderkey"] == l["l_orderkey"])
    return j.select("o_orderkey", "l_linenumber", F.concat(F.lit("step "), F.col("l_linenumber").cast("string")).alias("label"), F.round("l_extendedprice", 2).alias("price"), F.date_format("o_orderdate", "yyyy.MM.dd").alias("date_label"), (F.col("l_discount") > 0.05).alias("featured"))


@query("""
WITH e AS (SELECT doc_id AS id, quality AS edit FROM labels WHERE toxic = 0)
SELECT d.doc_id, CASE WHEN e.id IS NOT NULL AND edit = 0 THEN 'edited' ELSE 'kept' END AS state, CASE WHEN e.id IS NOT NULL AND edit = 0 THEN 'ED-' || lpad((row_number() OVER (PARTITION BY d.source, e.id IS NOT NULL AND coalesce(edit, 1) = 0 ORDER BY d.doc_id))::VARCHAR, 5, '0') END AS change_id FROM documents d LEFT JOIN e ON e.id = d.doc_id
""")
def manual_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits joined to their rows, each change with a running id."""
    e = table(spark, sf_dir, "labels").where("toxic = 0").select("doc_id", F.col("quality").alias("edit"))
    j = table(spark, sf_dir, "documents").select("doc_id", "source").join(e, "doc_id", "left")
    changed = F.coalesce(F.col("edit") == 0, F.lit(False))
    edited = islands.numbered_within(j.where(changed).select("doc_id", "source"), "source", ["doc_id"]).select("doc_id", F.format_string("ED-%05d", "nth").alias("change_id"))
    return j.join(edited, "doc_id", "left").select("doc_id", F.when(changed, "edited").otherwise("kept").alias("state"), "change_id")


@query("""
SELECT s_suppkey, CASE WHEN c.c_custkey IS NULL THEN 'missing' WHEN s_acctbal < 1000 THEN 'stale' WHEN s_nationkey <> c_nationkey AND s_suppkey % 2 = 0 THEN 'wrong_index' ELSE 'accepted' END AS outcome FROM supplier LEFT JOIN customer c ON c_custkey = s_suppkey * 17
""")
def selection_preflight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first reason why an item can't be committed, else accepted."""
    s = table(spark, sf_dir, "supplier").withColumn("k", F.col("s_suppkey") * 17)
    j = s.join(table(spark, sf_dir, "customer"), F.col("k") == F.col("c_custkey"), "left")
    outcome = F.when(F.col("c_custkey").isNull(), "missing").when(F.col("s_acctbal") < 1000, "stale").when((F.col("s_nationkey") != F.col("c_nationkey")) & (F.col("s_suppkey") % 2 == 0), "wrong_index").otherwise("accepted")
    return j.select("s_suppkey", outcome.alias("outcome"))


@query("""
SELECT n_nationkey, any_value(n_name) AS n_name, CASE WHEN count(c_custkey) FILTER (WHERE c_mktsegment = 'BUILDING') > 0 THEN 'manual' WHEN count(c_custkey) > 0 THEN 'generated' ELSE 'none' END AS kind, arg_min(c_custkey, (c_mktsegment <> 'BUILDING', c_acctbal < 0, c_custkey)) AS chosen FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1
""")
def preferred_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One track for each key: manual before generated, then by preference, then the first."""
    j = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "customer"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    manual = F.col("c_mktsegment") == "BUILDING"
    kind = F.when(F.count_if(manual) > 0, "manual").when(F.count("c_custkey") > 0, "generated").otherwise("none")
    chosen = F.min_by("c_custkey", F.when(F.col("c_custkey").isNotNull(), F.struct(~manual, F.col("c_acctbal") < 0, F.col("c_custkey"))))
    return j.groupBy("n_nationkey", "n_name").agg(kind.alias("kind"), chosen.alias("chosen"))
