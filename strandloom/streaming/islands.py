"""The gap rule of islands on a stream: an extension, as sessions that close when the watermark passes their gap."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def gap_sessions(events: DataFrame, key: str, at: str, gap: str, late: str) -> DataFrame:
    """(key, start, end, n) per island of events no more than `gap` apart; events later than `late` behind the newest are dropped."""
    sessions = events.withWatermark(at, late).groupBy(key, F.session_window(at, gap).alias("s")).agg(F.count("*").alias("n"))
    return sessions.select(key, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def running_counts(events: DataFrame, stage: str) -> DataFrame:
    """Calls per stage so far, for output mode complete."""
    return events.groupBy(stage).agg(F.count("*").alias("n_calls"))
