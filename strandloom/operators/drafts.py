"""Edits of a draft as transformations of its tables of parts and steps; what is derived is computed after them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def delete_steps(steps: DataFrame, which: Column) -> DataFrame:
    return steps.where(~F.coalesce(which, F.lit(False)))


def merge_parts(steps: DataFrame, into: int, part: int) -> DataFrame:
    return steps.withColumn("part", F.when(F.col("part") == part, into).otherwise(F.col("part")))


def split_part(steps: DataFrame, part: int, at_step: int, new_part: int) -> DataFrame:
    """Steps of the part from at_step on go to the new part."""
    return steps.withColumn("part", F.when((F.col("part") == part) & (F.col("step") >= at_step), new_part).otherwise(F.col("part")))


def move_part(parts: DataFrame, draft: str, part: int, to: int, out: str = "new_order") -> DataFrame:
    """parts numbered anew with one of them moved to a place (from 1)."""
    others = parts.where(F.col("part") != part)
    rank = F.row_number().over(Window.partitionBy(draft).orderBy("part"))
    placed = others.withColumn("_at", F.when(rank < to, rank * 2).otherwise(rank * 2 + 2))
    moved = placed.unionByName(parts.where(F.col("part") == part).withColumn("_at", F.lit(to * 2)))
    return renumber(moved, draft, [F.col("_at"), F.col("part")], out).drop("_at")


def renumber(parts: DataFrame, draft: str, order: list[Column], out: str) -> DataFrame:
    return parts.withColumn(out, F.row_number().over(Window.partitionBy(draft).orderBy(*order)).cast("long"))


def assign_phase(phases: DataFrame, phase: str, part: int | None, reason: str | None = None) -> DataFrame:
    """A phase goes to a part, or with no part is excluded, for which a reason is needed."""
    if part is None and not reason:
        raise ValueError("an excluded phase needs a reason")
    mine = F.col("phase") == phase
    return phases.withColumns({"part": F.when(mine, F.lit(part).cast("int")).otherwise(F.col("part")), "excluded_reason": F.when(mine, F.lit(reason)).otherwise(F.col("excluded_reason"))})


def toggle_evidence(evidence: DataFrame, step: int, utterance: str) -> DataFrame:
    """The (step, utterance) row goes if it is there and comes if it isn't."""
    one = evidence.sparkSession.createDataFrame([(step, utterance)], "step int, utterance string")
    return evidence.join(one, ["step", "utterance"], "left_anti").unionByName(one.join(evidence, ["step", "utterance"], "left_anti"))


def derived(steps: DataFrame, evidence: DataFrame) -> DataFrame:
    """Each part's number of steps and its bounds from its steps' evidence (start_s, end_s)."""
    spans = steps.join(evidence, ["draft", "step"], "left")
    return spans.groupBy("draft", "part").agg(F.count_distinct("step").alias("n_steps"), F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"))
