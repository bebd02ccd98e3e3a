"""Window operators over ordered rows: islands, runs, neighbours, ranges and running ids.

All take the columns that identify a document (key) and those that order its rows (order); nothing depends
on the physical order of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from strandloom.functions.names import fresh
from strandloom.operators import members


def ordered(key: list[str], order: list[str]) -> WindowSpec:
    return Window.partitionBy(*key).orderBy(*order)


def before(spec: WindowSpec) -> WindowSpec:
    return spec.rowsBetween(Window.unboundedPreceding, -1)


def so_far(spec: WindowSpec) -> WindowSpec:
    return spec.rowsBetween(Window.unboundedPreceding, 0)


def lead_ranges(rows: DataFrame, key: list[str], order: list[str], start: str, last_end: Column, end: str = "end_s") -> DataFrame:
    """The end of each range is the next one's start, or last_end."""
    return rows.withColumn(end, F.coalesce(F.lead(start).over(ordered(key, order)), last_end))


def islands(rows: DataFrame, key: list[str], order: list[str], terminal: Column, speaker: Column, gap_s: float) -> DataFrame:
    """rows with island (from 0) and reason, why the island of the row ends, on each island's last row.

    A new island begins after a terminal row, at a change of speaker, or where the row starts more than gap_s after
    the greatest end so far.
    """
    spec = ordered(key, order)
    t, s, reach, new, reason = fresh(rows, "terminal", "speaker", "reach", "new", "why")
    marked = rows.withColumns({t: terminal, s: speaker, reach: F.max("end_s").over(before(spec))})
    late = F.coalesce(F.col("start_s") - F.col(reach) > gap_s, F.lit(False))
    ended = F.coalesce(F.lag(t).over(spec), F.lit(False))
    marked = marked.withColumn(new, ended | F.col(s) | late)
    following = F.lead(new).over(spec)
    why = (
        F.when(F.col(t), "terminal_punctuation")
        .when(following.isNull(), "transcript_end")
        .when(following & F.lead(s).over(spec), "speaker_change")
        .when(following, "time_gap")
    )
    marked = marked.withColumn(reason, why)
    marked = marked.withColumn("island", F.sum(F.col(new).cast("int")).over(so_far(spec)) - F.first(F.col(new).cast("int")).over(so_far(spec)))
    return marked.withColumn("reason", F.col(reason)).drop(t, s, reach, new, reason)


def runs(rows: DataFrame, key: list[str], order: list[str], value: Column) -> DataFrame:
    """rows with run (from 1) of equal neighbouring values, and is_head."""
    spec = ordered(key, order)
    (v,) = fresh(rows, "value")
    marked = rows.withColumn(v, value)
    head = F.row_number().over(spec) == 1
    head = head | ~F.col(v).eqNullSafe(F.lag(v).over(spec))
    marked = marked.withColumn("is_head", head)
    return marked.withColumn("run", F.sum(F.col("is_head").cast("int")).over(so_far(spec)).cast("long")).drop(v)


def rank_within(rows: DataFrame, key: list[str], order: list[Column], out: str = "rank") -> DataFrame:
    return rows.withColumn(out, F.row_number().over(Window.partitionBy(*key).orderBy(*order)))


def surrounding(rows: DataFrame, key: list[str], order: list[str], value: str, reach: int, out: str = "context") -> DataFrame:
    """The values of up to `reach` rows on each side, in order, the row's own included."""
    return rows.withColumn(out, F.collect_list(value).over(ordered(key, order).rowsBetween(-reach, reach)))


def numbered_ids(rows: DataFrame, key: list[str], order: list[str], prefix: str, digits: int, out: str) -> DataFrame:
    return rows.withColumn(out, F.format_string(f"{prefix}%0{digits}d", F.row_number().over(ordered(key, order))))


def next_number(ids: str) -> Column:
    """One more than the greatest numeric suffix; 1 if there is none."""
    return F.coalesce(F.max(F.regexp_extract(ids, r"(\d+)$", 1).try_cast("long")), F.lit(0)) + 1


def section_ranges(starts: DataFrame, key: list[str], pos: str, last: Column) -> DataFrame:
    """Sections from their first positions: each ends one before the next, the last at `last`."""
    following = F.lead(pos).over(ordered(key, [pos]))
    return starts.withColumn("last_pos", F.coalesce(following - 1, last))


def out_of_order(rows: DataFrame, key: list[str], order: list[str], value: str) -> DataFrame:
    """Rows whose value isn't greater than that of the row before."""
    return rows.withColumn("previous", F.lag(value).over(ordered(key, order))).where(F.col(value) <= F.col("previous"))


def merge_pairs(rows: DataFrame, key: list[str], order: list[str], joins_next: Column) -> DataFrame:
    """rows with pair_head: each row that joins its successor takes it in, unless it was itself taken in.

    In an unbroken run of rows that join their successors, every other one is a head, so a run's parity decides.
    """
    spec = ordered(key, order)
    joins, stop, nth = fresh(rows, "joins", "stop", "nth")
    marked = rows.withColumn(joins, joins_next & F.lead(F.lit(1)).over(spec).isNotNull())
    marked = marked.withColumn(stop, F.sum((~F.col(joins)).cast("int")).over(before(spec)))
    marked = marked.withColumn(stop, F.coalesce(stop, F.lit(0)))
    marked = marked.withColumn(nth, F.row_number().over(Window.partitionBy(*key, stop).orderBy(*order)))
    head = F.col(joins) & (F.col(nth) % 2 == 1)
    return marked.withColumn("takes_next", head).withColumn("is_taken", F.coalesce(F.lag("takes_next").over(spec), F.lit(False))).drop(joins, stop, nth)


def numbered_within(rows: DataFrame, key: str, order: list, out: str = "nth") -> DataFrame:
    """rows with 1, 2, 3, ... in order within each key, however many rows a key has.

    Rows are range-partitioned by key and order, so a hot key spreads over partitions; each is numbered on its own, after
    the counts of the key's partitions before it.
    """
    part, of, at, n, ahead = fresh(rows, "part", "of", "at", "n", "ahead")
    placed = members.saved(rows.repartitionByRange(key, *order).withColumn(part, F.spark_partition_id()), "numbered")
    counts = placed.groupBy(F.col(key).alias(of), F.col(part).alias(at)).agg(F.count("*").alias(n))
    before = F.coalesce(F.sum(n).over(Window.partitionBy(of).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(of, at, before.alias(ahead))
    joined = placed.join(offsets, F.col(key).eqNullSafe(F.col(of)) & (F.col(part) == F.col(at)))
    within = F.row_number().over(Window.partitionBy(key, part).orderBy(*order))
    return joined.withColumn(out, F.col(ahead) + within).drop(part, of, at, ahead)
