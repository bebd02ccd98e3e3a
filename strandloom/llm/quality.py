"""Document quality by Bradley-Terry pairwise ranking.

Pairs of labelled documents, one of label 1 and one of label 0, are preferences. A score linear in the documents'
features is fitted by logistic loss on the pairs' feature differences, and the threshold is a quantile of the fitted
scores: the one with the fewest errors on the labelled rows.

Features come from the text alone: shares of byte classes, word shapes and repetition, and the words and byte trigrams, hashed
into buckets. The fit sees a sample of labelled rows bounded by ``SAMPLE``; scores are computed for every whole text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.llm.passages import mix64, word_hashes

SAMPLE = 20_000  # labelled rows at most
PAIRS = 50_000  # preference pairs at most
FOLDS = 5  # rows whose crc32 is 0 modulo this are held out
ACCEPT = 0.3  # the score at the threshold
RIDGE = 1e-2
CHUNK = 5_000  # pairs whose differences are held at once
SEED = 11

_CLASS = np.zeros(256, np.int64)  # a byte's class; 0: control characters
for _n, _bytes in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\x0b\x0c", b"\n", b".,;:!?'\"-()", b"#$%&*+/<=>@[\\]^_`{|}~", bytes(range(128, 256))), 1):
    _CLASS[list(_bytes)] = _n
N_CLASSES = 9
N_SHAPES = 5
BUCKETS = 128  # of words, and of trigrams
N_FEATURES = N_CLASSES + N_SHAPES + 2 * BUCKETS
PIECE = 1 << 20  # bytes of text looked at together


def _piece(texts: list[bytes]) -> np.ndarray:
    n = len(texts)
    size = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b" ".join(texts), np.uint8)  # the blanks between texts are left out below
    starts = np.cumsum(np.append(0, size[:-1] + 1)) if n else np.zeros(0, np.int64)
    of = np.repeat(np.arange(n), size)
    own = np.arange(len(of)) + of  # each byte's place in data
    kinds = _CLASS[data[own]]
    counts = np.bincount(of * N_CLASSES + kinds, minlength=n * N_CLASSES).reshape(n, N_CLASSES)
    out = np.zeros((n, N_FEATURES))
    out[:, :N_CLASSES] = np.sqrt(counts / np.maximum(size, 1)[:, None])
    out[:, 1] = np.sqrt(counts[:, 2] / np.maximum(counts[:, 1] + counts[:, 2], 1))  # capitals among letters
    words, places = word_hashes(data)
    text = np.searchsorted(starts, places, "right") - 1
    m = np.bincount(text, minlength=n)
    some = np.maximum(m, 1)
    solid = ((_CLASS[data] != 4) & (_CLASS[data] != 5)).astype(np.int64)
    letters = np.add.reduceat(solid, places) if len(places) else places
    again = np.flatnonzero((words[1:] == words[:-1]) & (text[1:] == text[:-1])) + 1
    different = np.unique(mix64(words ^ mix64(text.astype(np.uint64))), return_index=True)[1]
    kinds_of_words = np.bincount(text[different], minlength=n)
    shapes = out[:, N_CLASSES : N_CLASSES + N_SHAPES]
    shapes[:, 0] = np.sqrt(np.bincount(text[again], minlength=n) / some)
    shapes[:, 1] = np.log1p(m)
    shapes[:, 2] = np.log1p(m) - np.log1p(kinds_of_words)
    shapes[:, 3] = np.where(m > 0, np.log(np.maximum(size, 1) / some), 0)
    shapes[:, 4] = np.sqrt(np.bincount(text[letters < 2], minlength=n) / some)
    at = N_CLASSES + N_SHAPES
    hashed = np.bincount(text * BUCKETS + (words % np.uint64(BUCKETS)).astype(np.int64), minlength=n * BUCKETS).reshape(n, BUCKETS)
    out[:, at : at + BUCKETS] = np.sqrt(hashed / some[:, None])
    if len(own) > 2:
        three = data[own].astype(np.uint32)
        three = (three[:-2] * np.uint32(0x9E3779B1) ^ three[1:-1] * np.uint32(0x85EBCA6B) ^ three[2:] * np.uint32(0xC2B2AE35)) * np.uint32(0x27D4EB2F)
        within = of[2:] == of[:-2]
        hashed = np.bincount(of[:-2][within] * BUCKETS + (three[within] >> np.uint32(25)).astype(np.int64), minlength=n * BUCKETS).reshape(n, BUCKETS)
        out[:, at + BUCKETS :] = np.sqrt(hashed / np.maximum(size, 1)[:, None])
    return out


def features(texts: list[bytes | None]) -> np.ndarray:
    """One row per text; a null or empty text has zeros."""
    out, held, total = [np.zeros((0, N_FEATURES))], [], 0
    for t in texts:
        held.append(t or b"")
        total += len(held[-1])
        if total >= PIECE:
            out.append(_piece(held))
            held, total = [], 0
    if held:
        out.append(_piece(held))
    return np.concatenate(out)


@F.pandas_udf(T.BinaryType())
def features_udf(texts: pd.Series) -> pd.Series:
    return pd.Series([x.tobytes() for x in features(list(texts)).astype(np.float16)])


@dataclass(frozen=True)
class Ranker:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Each row's products are added by themselves, so equal rows get equal scores in whatever batch they are."""
        out = np.empty(len(x))
        for at in range(0, len(x), 256):
            z = np.clip((x[at : at + 256] - self.mean) / self.scale, -8, 8) * self.weights
            for i, row in enumerate(z, at):
                out[i] = np.add.reduce(row)
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        """From 0 to 1; ACCEPT at the threshold, and one unit of log-odds per unit of raw score."""
        return 1 / (1 + np.exp(-np.clip(self.raw(x) - self.threshold + np.log(ACCEPT / (1 - ACCEPT)), -500, 500)))


def fit(x: np.ndarray, good: np.ndarray, pairs: int = PAIRS, seed: int = SEED) -> Ranker:
    """Newton's method on the pairs' logistic loss with a small ridge. Without both labels all scores are equal and pass."""
    mean = x.mean(0, dtype=np.float64) if len(x) else np.zeros(N_FEATURES)
    scale = np.maximum(x.std(0, dtype=np.float64), 1e-6) if len(x) else np.ones(N_FEATURES)
    above, below = np.flatnonzero(good), np.flatnonzero(~good)
    w = np.zeros(N_FEATURES)
    if not len(above) or not len(below):
        return Ranker(mean, scale, w, 0.0)
    z = x.astype(np.float32)  # the driver holds the sample once, in single precision
    z -= mean.astype(np.float32)
    z /= scale.astype(np.float32)
    np.clip(z, -8, 8, out=z)
    rnd = np.random.default_rng(seed)
    better, worse = rnd.choice(above, pairs), rnd.choice(below, pairs)
    for _ in range(30):
        grad, curve = -RIDGE * w, RIDGE * np.eye(N_FEATURES)
        for at in range(0, pairs, CHUNK):
            d = (z[better[at : at + CHUNK]] - z[worse[at : at + CHUNK]]).astype(np.float64)
            p = 1 / (1 + np.exp(np.clip(d @ w, -500, 500)))  # chance of the wrong order
            grad = grad + d.T @ p / pairs
            curve += (d * (p * (1 - p))[:, None]).T @ d / pairs
        step = np.linalg.solve(curve, grad)
        w = w + step
        if np.abs(step).max() < 1e-4:
            break
    raw = z @ w
    order = np.argsort(raw, kind="stable")
    # errors when the k lowest are rejected: good ones among them, and bad ones above
    errors = np.concatenate(([0], np.cumsum(good[order]))) + (~good).sum() - np.concatenate(([0], np.cumsum(~good[order])))
    least = np.flatnonzero(errors == errors.min())
    quantile = least[len(least) // 2] / len(raw)
    return Ranker(mean, scale, w, float(np.quantile(raw, quantile)))


def held_out(doc_id: Column) -> Column:
    """False for a null doc_id, which has no label."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Ranker:
    """Fits on labelled rows outside the held-out fold, those of smallest hash up to the sample's bound.

    Null labels and null ids don't count. Documents of one doc_id share its label, and several labels of one doc_id are rows of their own; equal
    rows count as often as they occur. Null, empty and very long texts are learned from like others. Without rows of both labels all scores are equal
    and pass. Other columns of either table aren't looked at.
    """
    known = labels.select("doc_id", "quality").where("doc_id IS NOT NULL AND quality IS NOT NULL").where(~held_out(F.col("doc_id")))
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample)  # bounded, so it may be broadcast
    texts = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    rows = texts.select("doc_id", "quality", F.xxhash64("text").alias("h"), features_udf(F.col("text").cast("binary")).alias("x"))
    got = rows.orderBy(F.xxhash64("doc_id"), "h", "quality").limit(sample).select("quality", "x").collect()
    x = np.zeros((len(got), N_FEATURES), np.float32)
    for i, r in enumerate(got):
        x[i] = np.frombuffer(r["x"], np.float16)
    return fit(x, np.array([r["quality"] == 1 for r in got], bool))


def score(text: Column, ranker: Ranker) -> Column:
    """The score, 0 to 1, of every whole text, equal for equal texts; null and empty texts have zero features and a score like any other."""

    @F.pandas_udf(T.DoubleType())
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series(ranker.score(features(list(texts))))

    return scored(text.cast("binary"))
