"""State-dependent grouping: decisions that depend on what was decided since the last break.

These are folds, not windows. Rows are partitioned by document and sorted; each task streams its documents with a constant
amount of state, so no document has to fit into memory.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Makes the state of a new document: a function from a row's values to what the fold says of that row.
Folder = Callable[[], Callable[..., int]]


ROWS = 1024  # of which a fold holds the values at once


def fold(rows: DataFrame, key: list[str], order: list, values: list[str], folder: Folder, out: str = "grp") -> DataFrame:
    """rows with one more integer column: what each document's folder returns for its rows, in order. Columns that the fold doesn't read pass by it as they are."""
    placed = rows.repartition(*[F.col(k) for k in key]).sortWithinPartitions(*key, *order)
    schema = T.StructType([*rows.schema.fields, T.StructField(out, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, step = object(), None
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                part, said = batch.slice(at, ROWS), []
                pdf = part.select(list(dict.fromkeys([*key, *values]))).to_pandas()
                for k, *v in zip(pdf[key].itertuples(index=False, name=None), *(pdf[c] for c in values)):
                    if k != current:
                        current, step = k, folder()
                    said.append(step(*v))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(said, pa.int64())], names=[*part.schema.names, out])

    return placed.mapInArrow(run, schema)


def utterance_groups(gap_s: float, max_duration: float, max_chars: int, strong_duration: float, strong_chars: int) -> Folder:
    """Group numbers for (start, end, chars, speaker change, strong start): a group closes before a change of speaker, a gap, or
    what would make it too long; before a strong start once it is long enough."""

    def new() -> Callable[..., int]:
        group, first, reach, chars = -1, 0.0, 0.0, 0

        def step(start: float, end: float, size: int, speaker: bool, strong: bool) -> int:
            nonlocal group, first, reach, chars
            long_enough = reach - first >= strong_duration or chars >= strong_chars
            if group < 0 or speaker or start - reach > gap_s or end - first > max_duration or chars + 1 + size > max_chars or (strong and long_enough):
                group, first, reach, chars = group + 1, start, end, size
            else:
                reach, chars = max(reach, end), chars + 1 + size
            return group

        return step

    return new


def sentence_groups(max_sentences: int, max_duration: float, max_chars: int, enough_duration: float, enough_sentences: int) -> Folder:
    """Group numbers for (start, end, chars): full by sentences, duration or characters, or long enough already."""

    def new() -> Callable[..., int]:
        group, first, last, chars, n = -1, 0.0, 0.0, 0, 0

        def step(start: float, end: float, size: int) -> int:
            nonlocal group, first, last, chars, n
            if n == 0 or n >= max_sentences or end - first > max_duration or chars + 1 + size > max_chars or (last - first >= enough_duration and n >= enough_sentences):
                group, first, last, chars, n = group + 1, start, end, size, 1
            else:
                last, chars, n = max(last, end), chars + 1 + size, n + 1
            return group

        return step

    return new


def lookback_groups(enough_s: float, most_s: float, max_chars: int, gap_s: float) -> Folder:
    """Group numbers for (start, end, chars, terminal): a group closes before a gap or what would make it too long, and after a
    sentence's end once it has lasted long enough."""

    def new() -> Callable[..., int]:
        group, first, reach, chars, n, over = -1, 0.0, 0.0, 0, 0, True

        def step(start: float, end: float, size: int, terminal: bool) -> int:
            nonlocal group, first, reach, chars, n, over
            if over or start - reach > gap_s or end - first > most_s or chars + size + n > max_chars:
                group, first, reach, chars, n = group + 1, start, end, size, 1
            else:
                reach, chars, n = max(reach, end), chars + size, n + 1
            over = bool(terminal) and reach - first >= enough_s
            return group

        return step

    return new


def capped_islands(gap_s: float, cap_s: float) -> Folder:
    """Island numbers for (start, end, terminal): as islands, and cut once an island has lasted cap_s."""

    def new() -> Callable[..., int]:
        group, first, reach, over = -1, 0.0, float("-inf"), True

        def step(start: float, end: float, terminal: bool) -> int:
            nonlocal group, first, reach, over
            if over or start - reach > gap_s:
                group, first = group + 1, start
            reach = max(reach, end)
            over = bool(terminal) or reach - first >= cap_s
            return group

        return step

    return new


def batches(max_rows: int, max_chars: int) -> Folder:
    """Batch numbers for (chars): a batch closes before the row that would exceed its rows or characters."""

    def new() -> Callable[..., int]:
        batch, n, chars = -1, 0, 0

        def step(size: int) -> int:
            nonlocal batch, n, chars
            if batch < 0 or n >= max_rows or chars + size > max_chars:
                batch, n, chars = batch + 1, 0, 0
            n, chars = n + 1, chars + size
            return batch

        return step

    return new


def interval_clusters(max_gap_s: float, max_window_s: float) -> Folder:
    """Cluster numbers for (start, end) in order of start: near enough to the cluster's end, and the whole not too long."""

    def new() -> Callable[..., int]:
        cluster, first, reach = -1, 0.0, 0.0

        def step(start: float, end: float) -> int:
            nonlocal cluster, first, reach
            wide = max(reach, end)
            if cluster < 0 or start - reach > max_gap_s or wide - first > max_window_s:
                cluster, first, reach = cluster + 1, start, end
            else:
                reach = wide
            return cluster

        return step

    return new


def within_budget(budget: float) -> Folder:
    """1 for (size) if it still fits the budget, else 0; what is skipped doesn't end the selection."""

    def new() -> Callable[..., int]:
        used = 0.0

        def step(size: float) -> int:
            nonlocal used
            if used + size > budget:
                return 0
            used += size
            return 1

        return step

    return new


def within_two_budgets(base: float, cap: float) -> Folder:
    """As within_budget, for (size, urgent) with urgent rows first: those may use the cap, the others fill up to the base."""

    def new() -> Callable[..., int]:
        used = 0.0

        def step(size: float, urgent: bool) -> int:
            nonlocal used
            if used + size > (cap if urgent else base):
                return 0
            used += size
            return 1

        return step

    return new


_SENTENCE = re.compile(r"(?<=[.!?。！？…])\s*")


def chunks(text: str | None, most: int = 420) -> list[str]:
    """Whole sentences together up to `most` characters; a longer sentence is cut at its last space in the second half, or hard."""
    flat = " ".join((text or "").split())
    if len(flat) <= most:
        return [flat] if flat else []
    out, held = [], ""
    for sentence in filter(None, map(str.strip, _SENTENCE.split(flat))):
        if held and len(held) + 1 + len(sentence) > most:
            out.append(held)
            held = ""
        while len(sentence) > most:
            at = sentence.rfind(" ", 0, most + 1)
            at = most if at < most // 2 else at
            out.append(sentence[:at].strip())
            sentence = sentence[at:].strip()
        held = f"{held} {sentence}" if held and sentence else held or sentence
    return [*out, held] if held else out


@F.pandas_udf(T.ArrayType(T.StringType()))
def chunks_udf(texts: pd.Series) -> pd.Series:
    return pd.Series([chunks(t) for t in texts])
