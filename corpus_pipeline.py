"""A training corpus from documents: five stages, each of which applies one operator to all that is left.

1. quality: documents that the pairwise quality ranker rejects go.
2. near_duplicates: one document of each SimHash group stays.
3. decontamination: documents that hold a window of a benchmark item go.
4. mixing: documents are repeated or left out so that sources meet their target weights.
5. sharding: every row gets a shard and a slot of a reproducible shuffle.

``run`` writes each stage's rows as Parquet in the shared folder and gives the next stage the table read back, so a
lost executor costs one stage's work at most.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm import decontaminate, mixture, quality, sharding, simhash
from strandloom.llm.common import cut, fresh


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text scores ACCEPT or more, with all their columns.

    Null, empty and very long texts are scored like others; equal texts and repeated rows share a fate. A table without labelled rows of both kinds keeps
    all its rows, an empty table stays empty. Columns of any name are kept as they are.
    """
    ranker = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(quality.score(F.col("text"), ranker) >= quality.ACCEPT)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each SimHash group: that of the smallest doc_id, null last; ties go to the smallest text hash, and of equal rows one stays.

    Null and empty texts have fingerprint zero and link like any other. Columns of any name are kept as they are.
    """
    return simhash.one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds no window of a benchmark item, whole or within a very long text; repeated rows share a fate.

    Null and empty texts have no words and stay. Columns of any name are kept as they are.
    """
    (hits,) = fresh(docs, "hits")
    marked = decontaminate.mark_hits(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), out=hits)
    return marked.where(F.size(f"{hits}.spans") == 0).drop(hits)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them: not at all, once or twice.

    Null is a source of its own. Rows without words, null texts among them, are taken about as often as the shortest of their source; rows equal in
    doc_id, source and text are drawn together. Columns of any name, those that the operator adds as well, keep the input's values.
    """
    size, of, target, copies = "size", "source_size", "target", "copies"
    kept = dict(zip((c for c in docs.columns if c.lower() in {size, of, target, copies}), fresh(docs, size, of, target, copies)))
    mixed = mixture.mix(docs.withColumnsRenamed(kept)).where("copies > 0")
    (copy,) = fresh(mixed, "copy")
    repeated = mixed.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col("copies")))).drop(copy, size, of, target, copies)
    return repeated.withColumnsRenamed({v: k for k, v in kept.items()}).select(*[F.col(f"`{c}`") for c in docs.columns])


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, repeated ones too, with shard and slot, which replace columns so named; null, empty and very long texts are rows like others."""
    kept = dict(zip((c for c in docs.columns if c.lower() == "row_no"), fresh(docs, "row_no")))
    placed = sharding.assign(docs.withColumnsRenamed(kept)).drop("row_no")
    return placed.withColumnsRenamed({v: k for k, v in kept.items()})


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]

#: The ranker's fit and the hashes behind fingerprints, draws and the shuffle aren't SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
