"""Set membership, covers, components and violations."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions.names import fresh


def cover_violations(sections: DataFrame, rows: DataFrame, key: list[str], first: str, last: str, pos: str, pieces: int | None = None) -> DataFrame:
    """(key, pos, problem) for rows that no section covers (gap) or several do (overlap), and for sections' positions without a row (unknown).

    pieces: how many tasks share the positions, if not as many as Spark chooses.
    """
    dealt = lambda df: df.repartition(pieces, *key, pos) if pieces else df
    spread = dealt(sections.select(*key, F.explode(F.sequence(first, last)).alias(pos)))
    covered = spread.groupBy(*key, pos).agg(F.count("*").alias("n"))
    there, n = fresh(rows, "there", "n")
    joined = dealt(rows.select(*key, pos)).withColumn(there, F.lit(True)).join(covered.withColumnRenamed("n", n), [*key, pos], "full_outer")
    problem = F.when(F.col(there).isNull(), "unknown").when(F.col(n).isNull(), "gap").when(F.col(n) > 1, "overlap")
    return joined.select(*key, pos, problem.alias("problem")).where("problem IS NOT NULL")


def accounting(allowed: DataFrame, used: DataFrame, excluded: DataFrame, ids: list[str]) -> DataFrame:
    """(ids, problem) where used and excluded don't split what is allowed: unaccounted, foreign or in both."""
    side = lambda df, n: df.select(*ids).distinct().withColumn(n, F.lit(True))
    names = fresh(allowed.select(*ids), "used", "excluded", "allowed")
    j = side(allowed, names[2]).join(side(used, names[0]), ids, "full_outer").join(side(excluded, names[1]), ids, "full_outer")
    u, e, a = (F.coalesce(c, F.lit(False)) for c in names)
    problem = F.when((u | e) & ~a, "foreign").when(u & e, "in_both").when(a & ~u & ~e, "unaccounted")
    return j.select(*ids, problem.alias("problem")).where("problem IS NOT NULL")


def violations(rows: DataFrame, ids: list[str], rules: dict[str, Column]) -> DataFrame:
    """(ids, rule) for each rule that a row breaks, in one pass: a rule is true where it is broken."""
    broken = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), name) for name, c in rules.items()]))
    return rows.select(*ids, F.explode(broken).alias("rule"))


def edit_candidates(names: DataFrame, name: str, edits: int = 3) -> DataFrame:
    """Pairs (a, b), a < b, of different names that hold all pairs within so many edits, and few others.

    A name is cut into edits + 1 pieces, one of which any name within the edits has unchanged, shifted by that many places at
    most. So names meet by (length, piece number, piece), not each with each.
    """
    n = edits + 1
    short = names.select(F.col(name).alias("a"), F.char_length(name).alias("size")).distinct()
    begin = lambda size, i: F.floor(size * i / n).cast("int")
    parts = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct(i.alias("i"), begin(F.col("size"), i).alias("at"), (begin(F.col("size"), i + 1) - begin(F.col("size"), i)).alias("n")))
    left = short.select("a", "size", F.explode(parts).alias("p")).select("a", "size", "p.i", F.substring("a", F.col("p.at") + 1, F.col("p.n")).alias("piece"))
    sizes = F.filter(F.sequence(F.col("size") - edits, F.col("size") + edits), lambda s: s >= 0)
    right = short.select(F.col("a").alias("b"), F.explode(sizes).alias("size")).select("b", "size", F.explode(parts).alias("p"))
    right = right.select("b", "size", "p", F.explode(F.sequence(F.greatest(F.col("p.at") - edits, F.lit(0)), F.col("p.at") + edits)).alias("at"))
    right = right.select("b", "size", "p.i", F.substring("b", F.col("at") + 1, F.col("p.n")).alias("piece")).distinct()
    pairs = left.join(right, ["size", "i", "piece"]).where("a <> b")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def tag() -> str:
    return uuid.uuid4().hex


def shared_folder(spark: SparkSession) -> str:
    """The folder that executors share: spark.checkpoint.dir, or below the warehouse where that is unset."""
    return (spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints").rstrip("/")


def saved(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the folder that executors share, so that loops start from files."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{tag()}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(edges: DataFrame) -> DataFrame:
    """(node, label) with the smallest node of each component of the edges (a, b): labels spread to neighbours and jump to their label's label until none changes."""
    both = saved(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = saved(both.groupBy("a").agg(F.least("a", F.min("b")).alias("label")).withColumnRenamed("a", "node"), "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        spread = labels.join(near, F.col("node") == F.col("a"), "left").select("node", "label", F.least("label", "near").alias("new"))
        jump = spread.select(F.col("node").alias("_n"), F.col("new").alias("_l"))
        moved = saved(spread.join(jump, F.col("new") == F.col("_n"), "left").select("node", "label", F.least("new", "_l").alias("new")), "labels")
        if moved.where("label <> new").isEmpty():
            return moved.select("node", "label")
        labels = moved.select("node", F.col("new").alias("label"))
