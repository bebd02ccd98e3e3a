"""Queries of the source operators, on the tables' texts in the shapes of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.operators import members, rules
from strandloom.plans.registry import query
from strandloom.plans.tables import table
from strandloom.sources import documents
from strandloom.streaming import islands


@query("""
SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'published' WHEN doc_id % 3 = 0 THEN 'preprocessed' WHEN n_chars > 500 THEN 'acquisition' ELSE 'unknown' END AS kind FROM documents
""")
def document_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of JSON documents by their fields."""
    row = [F.struct(F.lit("U1").alias("utterance_id"))]
    parts = F.struct(
        F.when(F.col("doc_id") % 5 == 0, F.array(*row)).alias("script"),
        F.when(F.col("doc_id") % 3 == 0, F.array(*row)).alias("normalized_utterances"),
        F.when(F.col("n_chars") > 500, F.struct(F.array(F.struct(F.substring("text", 1, 20).alias("text"))).alias("items"))).alias("transcript"),
    )
    docs = table(spark, sf_dir, "documents").select("doc_id", F.from_json(F.to_json(parts), documents.ACQUISITION).alias("d"))
    return docs.select("doc_id", "d.*").select("doc_id", documents.document_kind().alias("kind"))


@query(r"""
WITH l AS (SELECT conv_id, turn, unnest(string_split((turn * 7 + 1) // 60 || ':' || lpad(((turn * 7 + 1) % 60)::VARCHAR, 2, '0') || ' - ' || role || chr(10) || 'no time' || chr(10) || '1:02:03 ' || turn, chr(10))) AS x, generate_subscripts([1, 2, 3], 1) - 1 AS line FROM conversations)
SELECT conv_id, turn, line, CASE line WHEN 0 THEN turn * 7 + 1 ELSE 3723 END AS start_s FROM l WHERE line <> 1
""")
def timestamped_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapter lines of a description."""
    s = F.col("turn") * 7 + 1
    text = F.concat(F.floor(s / 60).cast("string"), F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0"), F.lit(" - "), "role", F.lit("\nno time\n1:02:03 "), F.col("turn").cast("string"))
    c = table(spark, sf_dir, "conversations").select(F.struct("conv_id", "turn").alias("k"), text.alias("t"))
    return documents.lines_with_times(c, "k", "t").select("k.conv_id", "k.turn", F.col("line").cast("long").alias("line"), "start_s")


@query("""
WITH b AS (SELECT DISTINCT p_name AS canonical_name, 'base' AS side FROM part WHERE p_type = 'PROMO'), e AS (SELECT DISTINCT upper(p_name) AS canonical_name, 'extension' AS side FROM part WHERE p_type <> 'PROMO')
SELECT * FROM b UNION ALL SELECT * FROM e WHERE lower(canonical_name) NOT IN (SELECT lower(canonical_name) FROM b)
""")
def dimension_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registry and its extension; the base's names win."""
    p = table(spark, sf_dir, "part")
    base = p.where("p_type = 'PROMO'").select(F.col("p_name").alias("canonical_name"), F.lit("base").alias("side")).distinct()
    more = p.where("p_type <> 'PROMO'").select(F.upper("p_name").alias("canonical_name"), F.lit("extension").alias("side")).distinct()
    return documents.keep_first_by_name(base, more)


@query("""
SELECT s_suppkey, s_name AS raw, 'S' || s_nationkey AS normalized, CASE WHEN s_suppkey % 2 = 0 THEN 'high' ELSE 'medium' END AS confidence FROM supplier
""")
def glossary_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A glossary text parsed into rules."""
    line = F.concat(F.col("s_name"), F.lit(" => S"), F.col("s_nationkey").cast("string"), F.when(F.col("s_suppkey") % 2 == 0, " => high").otherwise(""))
    text = F.concat(F.lit("# a comment\n\nincomplete => \n"), line)
    g = table(spark, sf_dir, "supplier").select("s_suppkey", F.explode(rules.parse_glossary(text)).alias("r"))
    return g.select("s_suppkey", "r.raw", "r.normalized", "r.confidence")


@query(r"""
SELECT page_id, regexp_replace(url, '[\\/:*?"<>|]+', '_', 'g') AS name FROM pages
""")
def safe_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles as file names."""
    return table(spark, sf_dir, "pages").select("page_id", documents.safe_name(F.col("url")).alias("name"))


@query("""
SELECT o_custkey AS id, string_agg(DISTINCT rule, '; ' ORDER BY rule) AS line FROM (SELECT o_custkey, unnest([CASE WHEN o_totalprice < 3000 THEN 'cheap' END, CASE WHEN o_orderstatus = 'P' THEN 'pending' END]) AS rule FROM orders) WHERE rule IS NOT NULL GROUP BY 1
""")
def violation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations as one line of text per customer."""
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "id")
    v = members.violations(o, ["id"], {"cheap": F.col("o_totalprice") < 3000, "pending": F.col("o_orderstatus") == "P"})
    return documents.report_lines(v, ["id"])


@query("""
WITH m AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events), g AS (SELECT *, sum((p IS NULL OR ts - p >= INTERVAL 6 HOURS)::INT) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM m)
SELECT user_id, epoch_us(min(ts)) AS start_us, count(*) AS n FROM g GROUP BY user_id, k
""")
def stream_gap_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The streaming sessions' plan, run over the whole table at once."""
    e = table(spark, sf_dir, "events").withColumn("at", F.expr("timestamp_micros(timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts))"))
    s = islands.gap_sessions(e, "user_id", "at", "6 hours", "30 days")
    return s.select("user_id", F.unix_micros("start").alias("start_us"), "n")


@query("SELECT doc_id, source, lang, 'document' AS kind, CAST(doc_id % 97 AS BIGINT) AS n FROM documents WHERE source IS NOT NULL")
def documents_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents published as JSON, then read from the files with what couldn't be read told apart."""
    folder = f"{members.shared_folder(spark)}/documents-{members.tag()}"
    rows = table(spark, sf_dir, "documents").where("source IS NOT NULL").select("doc_id", "source", "lang", F.lit("document").alias("kind"), (F.col("doc_id") % 97).alias("n"))
    documents.publish(rows, folder)
    read = spark.read.schema("doc_id long, source string, lang string, kind string, n long, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(folder)
    return read.where("_corrupt IS NULL").drop("_corrupt")


@query("SELECT * FROM customer WHERE c_custkey = (SELECT max(o_custkey) FROM orders)")
def customer_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one customer of a key, here that of the greatest key in the orders; two rows of it would be an error."""
    key = table(spark, sf_dir, "orders").agg(F.max("o_custkey")).first()[0]
    return documents.unique_lookup(table(spark, sf_dir, "customer"), "c_custkey", key)
