"""What several operators share: tables that cut lineage, and global row numbers."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or one below the warehouse where that is unset."""
    if configured := spark.conf.get("spark.checkpoint.dir", None):
        return configured.rstrip("/")
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints/{spark.sparkContext.applicationId}"


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Working names that df has no column of, whatever the case of letters."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        k, free = 0, f"_{name}"
        while free.lower() in taken:
            k, free = k + 1, f"_{name}{k + 1}"
        taken.add(free.lower())
        out.append(free)
    return out


#: Of rows with megabytes each: without these Parquet looks at sizes only after a hundred rows, so that a task holds as many, and reads them back together.
LARGE_ROWS = {"parquet.block.size": 8 << 20, "parquet.block.size.row.check.min": 1, "parquet.block.size.row.check.max": 1, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1}


def cut(df: DataFrame, name: str, large_rows: bool = False) -> DataFrame:
    """Writes df as a table in the shared folder and returns that table. large_rows: a row may have megabytes, so a row group has few.

    Later steps start from files that outlive any executor, and what made them runs once.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").options(**LARGE_ROWS if large_rows else {}).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Empties a table that cut wrote and that nothing reads any more: its files are replaced by one without rows."""
    path = table.inputFiles()[0].rsplit("/", 1)[0] if table.inputFiles() else None
    if path:
        table.sparkSession.createDataFrame([], table.schema).write.mode("overwrite").parquet(path)


def number_rows(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Adds ``row_no``: 0, 1, 2, ... over all rows in the given order; it replaces a column so named.

    The rows are range-partitioned and sorted, then numbered within each partition; only one count
    per partition reaches the driver, and one offset per partition is broadcast. The sorted rows
    are written first, so both passes see the same partitions even if executors are lost.
    """
    spark = df.sparkSession
    df = df.drop("row_no")
    place, piece, start = fresh(df, "place", "piece", "start")
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = cut(placed.withColumn(place, F.monotonically_increasing_id()), name)
    part = F.shiftright(place, 33)
    counts = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()
    offsets, total = [], 0
    for row in sorted(counts):
        offsets.append((row["part"], total))
        total += row["n"]
    starts = spark.createDataFrame(offsets, f"`{piece}` long, `{start}` long")
    numbered = placed.withColumn(piece, part).join(F.broadcast(starts), piece)
    within = F.col(place) - F.shiftleft(piece, 33)
    return numbered.withColumn("row_no", F.col(start) + within).drop(piece, start, place)
