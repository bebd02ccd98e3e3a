"""Periodic runs: maximal stretches of words that repeat a block at least three times.

Periods up to ``DIRECT`` are found by comparing the words with themselves at each lag. Longer ones are found at several scales
of periods lo < q <= p. A gram is p consecutive words. As it is at least as long as the period, its copies
within a run lie whole periods apart. Each window of neighbouring grams gives the one of smallest hash (its minimizer), and a run
of three periods holds the same window twice, one period apart; so it holds two equal minimizers at that
distance with no third between. Such pairs are seeds, extended to both sides by hashes of prefixes; what they give is then compared word by word.

All texts of a piece are looked at as one sequence, ordered by length, with a word of its own behind each text: no run crosses it, and
larger scales take only the longer texts. Documents aren't shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import fresh
from strandloom.llm.words import joined, mix64, numbered, pieces, spans

LEAST = 24  # words of a run at least
TIMES = 3  # periods of a run at least
DIRECT = 8  # periods up to which every lag is compared
BODY = "body"  # working column of texts
RUN = "array<struct<start:bigint,length:bigint,period:bigint>>"
_BASE = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out) if n else out


class _Prefixes:
    """Hashes of any stretch of a sequence of numbers."""

    def __init__(self, x: np.ndarray) -> None:
        self.n = len(x)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix64(x.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(x)))))
        self.back = _powers(_BACK, len(x) + 1)

    def of(self, at: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        return (self.sums[at + size] - self.sums[at]) * self.back[at]

    def common(self, i: np.ndarray, j: np.ndarray, most: np.ndarray, right: bool) -> np.ndarray:
        """How many numbers from i and from j on (or before i and before j) are the same, up to most."""
        low, high = np.zeros_like(i), most.copy()
        while (low < high).any():
            mid = (low + high + 1) // 2
            same = self.of(i, mid) == self.of(j, mid) if right else self.of(i - mid, mid) == self.of(j - mid, mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low


def _at_lag(x: np.ndarray, q: int) -> np.ndarray:
    """(start, end, q) of every stretch of period q that is long enough."""
    same = np.zeros(max(len(x) - q, 0) + 2, np.int8)
    same[1:-1] = x[q:] == x[: len(x) - q]
    edges = np.flatnonzero(np.diff(same))
    s, e = edges[::2], edges[1::2] + q
    keep = e - s >= max(LEAST, TIMES * q)
    return np.stack((s[keep], e[keep], np.full(keep.sum(), q)), 1)


def _least(keys: np.ndarray, w: int) -> np.ndarray:
    """The least of each w neighbours."""
    width = 1
    while width * 2 <= w:
        keys = np.minimum(keys[:-width], keys[width:])
        width *= 2
    return np.minimum(keys[: len(keys) - (w - width)], keys[w - width :])


def _at_scale(x: np.ndarray, pre: _Prefixes, base: int, lo: int, p: int) -> list[np.ndarray]:
    """Runs of periods lo < q <= p in x[base:]."""
    w = 2 * (lo + 1) - p + 1  # as many grams as lie twice, one period apart, within three periods
    n = len(x) - base - p + 1
    if n < w:
        return []
    at = np.arange(base, base + n)
    grams = pre.of(at, p)
    bits = np.uint64(max(int(n).bit_length(), 1))
    keys = ((mix64(grams) >> bits) << bits) | np.arange(n, dtype=np.uint64)
    chosen = (_least(keys, w) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)  # they never go back
    chosen = chosen[np.concatenate(([True], chosen[1:] != chosen[:-1]))]
    order = chosen[np.argsort(grams[chosen], kind="stable")]
    near = (grams[order[1:]] == grams[order[:-1]]) & (order[1:] - order[:-1] > lo) & (order[1:] - order[:-1] <= p)
    i, j = order[:-1][near] + base, order[1:][near] + base
    if not len(i):
        return []
    q = j - i
    right = pre.common(i, j, len(x) - j, True)
    left = pre.common(i, j, i, False)
    found = np.unique(np.stack((i - left, j + right, q), 1), axis=0)
    found = found[found[:, 1] - found[:, 0] >= np.maximum(LEAST, TIMES * found[:, 2])]
    out, doubtful = [], set()
    for s, e, q in found.tolist():
        whole = np.array_equal(x[s : e - q], x[s + q : e]) and (s == 0 or x[s - 1] != x[s - 1 + q]) and (e == len(x) or x[e] != x[e - q])
        if whole:
            out.append(np.array([[s, e, q]]))
        else:  # two unlike stretches have one hash
            doubtful.add(q)
    return out + [_at_lag(x, q) for q in sorted(doubtful)]


def runs_of(texts: list[np.ndarray]) -> list[np.ndarray]:
    """For each sequence of numbers from 0 on, the rows (start, length, period) of its runs, by start and period."""
    size = np.array([len(t) for t in texts], np.int64)
    order = np.argsort(size, kind="stable")
    ahead = np.concatenate(([0], np.cumsum(size[order] + 1)))
    top = max((int(t.max()) for t in texts if len(t)), default=0)
    x = np.empty(int(ahead[-1]), np.int64)
    for k, d in enumerate(order):
        x[ahead[k] : ahead[k + 1] - 1] = texts[d]
        x[ahead[k + 1] - 1] = top + 1 + k
    longest = int(size.max()) if len(size) else 0
    out = [np.zeros((0, 3), np.int64)]
    if longest >= LEAST:
        out += [_at_lag(x, q) for q in range(1, min(DIRECT, longest // TIMES) + 1)]
        lo, pre = DIRECT, None
        while lo < longest // TIMES:
            pre = pre or _Prefixes(x)
            p = min(lo * 3 // 2, longest // TIMES)
            base = int(ahead[np.searchsorted(size[order], TIMES * (lo + 1))])  # shorter texts have no run of these periods
            out += _at_scale(x, pre, base, lo, p)
            lo = p
    found = np.unique(np.concatenate(out), axis=0)  # by start, end, period
    smallest = np.concatenate(([True], (found[1:, :2] != found[:-1, :2]).any(1))) if len(found) else np.zeros(0, bool)
    found = found[smallest]
    found = found[np.lexsort((found[:, 2], found[:, 0]))]
    of = np.searchsorted(ahead, found[:, 0], "right") - 1
    cuts = np.searchsorted(of, np.arange(len(texts) + 1))
    result: list[np.ndarray] = [found[:0]] * len(texts)
    for k, d in enumerate(order):
        rows = found[cuts[k] : cuts[k + 1]]
        result[d] = np.stack((rows[:, 0] - ahead[k], rows[:, 1] - rows[:, 0], rows[:, 2]), 1)
    return result


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """False for a word that some run holds behind its first period."""
    depth = np.zeros(n + 1, np.int64)
    np.add.at(depth, runs[:, 0] + runs[:, 2], 1)
    np.add.at(depth, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(depth[:-1]) == 0


def _collapse(text: bytes, runs: np.ndarray) -> bytes:
    words = text.split()  # at ASCII space, as the runs count them
    if not len(runs):
        return b" ".join(words)
    return b" ".join([w for w, stays in zip(words, kept_words(len(words), runs)) if stays])


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    struct = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    for batch, texts in pieces(batches, BODY):
        data, at = joined(texts, lower=False)
        starts, ends = spans(data)
        ids, _, _ = numbered(data, starts, ends)
        cuts = np.searchsorted(starts, at)
        found = runs_of([ids[cuts[i] : cuts[i + 1]] for i in range(len(texts))])
        flat = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
        offsets = np.concatenate(([0], np.cumsum([len(f) for f in found]))).astype(np.int32)
        rows = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], fields=list(struct))
        collapsed = pa.array([_collapse(t, f).decode() for t, f in zip(texts, found)], pa.string())
        rest = [batch.column(k) for k in range(1, batch.num_columns)]
        names = batch.schema.names[1:]
        yield pa.RecordBatch.from_arrays([*rest, pa.ListArray.from_arrays(pa.array(offsets), rows), collapsed], names=[*names, "runs", "collapsed"])


def periodic_runs(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns named in keep) with runs and collapsed, which replace columns so named.

    Words are maximal stretches of bytes other than ASCII space, compared exactly; case counts. A run is a maximal stretch of smallest period q and
    at least max(LEAST, TIMES * q) words; runs has (start, length, period) in words from 0, by start and period, of every run, overlapping ones too.
    collapsed is the text without the words that a run holds behind its first period, joined by one blank.
    A null or empty text has no run and an empty collapsed text. Rows are looked at one by one: repeated rows give the same result, null ids and other columns
    stay as they are. A text of any length is one row of one task; its time grows as n log n.
    """
    columns = [c for c in (keep if keep is not None else docs.columns) if c.lower() not in ("runs", "collapsed")]
    names = fresh(docs, *(f"c{i}" for i in range(len(columns))))
    moved = docs.select(F.col("text").cast("binary").alias(BODY), *(docs[c].alias(n) for c, n in zip(columns, names)))
    kinds = ", ".join(f"`{n}` {moved.schema[n].dataType.simpleString()}" for n in names)
    found = moved.mapInArrow(_find, f"{kinds}{', ' if kinds else ''}runs {RUN}, collapsed string")
    return found.select(*(found[n].alias(c) for c, n in zip(columns, names)), "runs", "collapsed")


def strongest(runs: str) -> Column:
    """Of a column of runs the one of greatest length/period, compared exactly; ties: smallest start, then period. Null without runs."""

    def better(best: Column, r: Column) -> Column:
        return F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best)

    return F.aggregate(runs, F.lit(None).cast(RUN.removeprefix("array<")[:-1]), better)
