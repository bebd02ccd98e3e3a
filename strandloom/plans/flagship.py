"""The flagship query: sentences of documents' lines and how many are complete."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.plans.registry import query
from strandloom.plans.tables import table


@query(r"""
WITH l AS (SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
p AS (SELECT doc_id, lang, n, unnest(regexp_extract_all(line, '[^.!?…]+[.!?…]*')) AS piece FROM l)
SELECT lang, count(*) AS n_pieces, count(*) FILTER (WHERE regexp_matches(piece, '[.!?…]$')) AS n_complete,
  round(count(*) FILTER (WHERE regexp_matches(piece, '[.!?…]$')) / count(*), 6) AS completion FROM p WHERE trim(piece, ' ') <> '' GROUP BY lang
""")
def sentence_completion_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of lines cut after terminal punctuation, and the share that ends with it, per language."""
    docs = table(spark, sf_dir, "documents").select("lang", F.explode(F.split("text", "\n")).alias("line"))
    pieces = docs.select("lang", F.explode(F.regexp_extract_all("line", F.lit("([^.!?…]+[.!?…]*)"), 1)).alias("piece")).where(F.trim("piece") != "")
    done = F.count_if(F.col("piece").rlike("[.!?…]$"))
    return pieces.groupBy("lang").agg(F.count("*").alias("n_pieces"), done.alias("n_complete"), F.round(done / F.count("*"), 6).alias("completion"))
