"""Joins on time and on sets: as-of, interval ownership, overlap, override, set overlap, fuzzy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandloom.operators.members import edit_candidates


def asof(rows: DataFrame, marks: DataFrame, key: str, at: str, tie: str, values: list[str], first_if_none: bool = False) -> DataFrame:
    """rows with the values of the latest mark at or before them (marks have the columns key, at and values).

    Both go into one ordering per key, in which a row takes what the last mark said: no pairs are made, whatever the number
    of marks. With first_if_none, rows before the first mark take the first one.
    """
    said = F.struct(*values)
    union = rows.select("*", F.lit(1).alias("_kind"), F.lit(None).cast(marks.select(said.alias("s")).schema["s"].dataType).alias("_said"))
    as_rows = marks.select(*[F.col(c) if c in (key, at) else F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in rows.columns], F.lit(0).alias("_kind"), said.alias("_said"))
    spec = Window.partitionBy(key).orderBy(at, "_kind", tie)
    out = union.unionByName(as_rows)
    last = F.last("_said", ignorenulls=True).over(spec.rowsBetween(Window.unboundedPreceding, 0))
    if first_if_none:
        last = F.coalesce(last, F.first("_said", ignorenulls=True).over(spec.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    out = out.withColumn("_last", last).where("_kind = 1")
    return out.select(*rows.columns, *[F.col("_last")[v].alias(v) for v in values])


def overlap(left: DataFrame, right: DataFrame, key: str, span: float) -> DataFrame:
    """Pairs of intervals of one key that overlap: left (key, l_start, l_end), right (key, r_start, r_end), ends exclusive.

    Each interval goes into the buckets of `span` that it touches, buckets are joined by equality, and a pair counts in
    the first bucket that both touch only.
    """

    def buckets(start: str, end: str) -> Column:
        return F.explode(F.sequence(F.floor(F.col(start) / span), F.floor(F.col(end) / span)))

    a = left.withColumn("_b", buckets("l_start", "l_end"))
    b = right.withColumn("_b", buckets("r_start", "r_end"))
    first = F.greatest(F.floor(F.col("l_start") / span), F.floor(F.col("r_start") / span))
    return a.join(b, [key, "_b"]).where((F.col("l_start") < F.col("r_end")) & (F.col("r_start") < F.col("l_end")) & (F.col("_b") == first)).drop("_b")


def override(base: DataFrame, patch: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Full outer merge in which the patch's values win; origin says where a row came from."""
    p = patch.select(F.col(key).alias("_key"), *[F.col(v).alias(f"_{v}") for v in values], F.lit(True).alias("_there"))
    b = base.select(key, *values, F.lit(True).alias("_base"))
    j = b.join(p, b[key] == p["_key"], "full_outer")
    origin = F.when(F.col("_there") & F.col("_base"), "both").when(F.col("_there"), "patch").otherwise("base")
    picked = [F.when(F.col("_there"), F.col(f"_{v}")).otherwise(F.col(v)).alias(v) for v in values]
    return j.select(F.coalesce(key, "_key").alias(key), *picked, origin.alias("origin"))


def set_overlaps(left: DataFrame, right: DataFrame, element: str, left_id: str, right_id: str) -> DataFrame:
    """(left_id, right_id, n_common) for id pairs whose element sets meet."""
    a, b = left.select(left_id, element).distinct(), right.select(right_id, element).distinct()
    return a.join(b, element).groupBy(left_id, right_id).agg(F.count("*").alias("n_common"))


def unique_best(pairs: DataFrame, key: list[str], order: list[Column], ties: list[Column]) -> DataFrame:
    """The first row of each key, unless the next one equals it in the tie columns."""
    spec = Window.partitionBy(*key).orderBy(*order)
    marked = pairs.withColumns({"_n": F.row_number().over(spec), "_same": F.lead(F.struct(*ties)).over(spec).eqNullSafe(F.struct(*ties))})
    return marked.where("_n = 1 AND NOT _same").drop("_n", "_same")


def near_names(left: DataFrame, right: DataFrame, left_name: str, right_name: str, most: int) -> DataFrame:
    """Pairs of names of one length and at most `most` edits, but not equal: with the distance. Names meet by pieces that the edits leave whole."""
    names = left.select(F.col(left_name).alias("name")).union(right.select(F.col(right_name).alias("name")))
    near = edit_candidates(names, "name", most).where(F.char_length("a") == F.char_length("b")).withColumn("distance", F.levenshtein("a", "b", most)).where("distance > 0")
    both = near.select("a", "b", "distance").union(near.select("b", "a", "distance"))
    return left.join(both, left[left_name] == both["a"]).join(right, F.col("b") == right[right_name]).drop("a", "b")
