"""Collocations: phrases whose words meet more often than their parts would let expect, by two passes over all texts.

First pass: the hashes of all phrases, counted per piece of text, are dealt out by ranges of the hash. Each range keeps a Misra-Gries summary of
counters: whenever there are more counters than its capacity, the count of the first one beyond it is taken from all. As the summaries
of pieces are merged under the range's whole mass, and the capacity is ``SLACK`` times that mass over the threshold, no more than threshold / SLACK is ever
taken; a phrase at the threshold always keeps its counter. Survivors are told by one bit each in a filter of fixed size.

Second pass: phrases that pass the filter are counted as strings, exactly. Hashes that meet let more through and change no result.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.llm.common import cut
from strandloom.llm.words import LOWER, mix64, numbered, pieces, spans

BREAK = np.zeros(256, bool)  # between pieces that no phrase crosses
BREAK[[*b".,;:!?", *range(10, 14)]] = True
BETWEEN = BREAK.copy()  # between words
BETWEEN[[9, 32]] = True
FEW, MANY = 2, 3  # words of a phrase
LEAST = 10  # occurrences of a candidate
COVER = 50  # percent of a phrase's occurrences within a longer candidate that drop it
TOP = 2000  # phrases reported per language
SLACK = 2  # counters per occurrence that a summary's mass could hold at the threshold
RANGES = 4  # of hashes per shuffle partition, one summary at a time in memory
HASH_BITS = 48
FILTER_BITS = 27  # 16 MiB, whatever the input
SUMMARY = "part int, kind int, mass long, n int, gaps binary, counts binary"


def _grams(texts: list[bytes], seed: int, many: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each size from 0 (all words as one) to many: (size, bytes, start, end, hash, count) of the different phrases; they lie in the bytes with one blank between words."""
    data = LOWER[np.frombuffer(b"\n".join(texts), np.uint8)]
    blank = (data == 32) | (data == 9)
    data = np.where(blank, np.uint8(32), data)[~(blank & np.concatenate(([False], blank[:-1])))]
    starts, ends = spans(data, BETWEEN)
    yield 0, data, np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1, np.uint64), np.array([len(starts)])
    if not len(starts):
        return
    ids, first, word = numbered(data, starts, ends)
    piece = np.searchsorted(np.flatnonzero(BREAK[data]), starts)
    codes, at, h = ids, np.arange(len(ids)), mix64(word ^ np.uint64(seed))  # of each phrase: number and first word; of each number: hash
    yield 1, data, starts[first], ends[first], h, np.bincount(ids)
    for size in range(2, many + 1):
        longer = at + size - 1 < len(ids)
        at, codes = at[longer], codes[longer]
        longer = piece[at] == piece[at + size - 1]
        at, codes = at[longer], codes[longer]
        if not len(at):
            return
        before = codes
        codes, _ = pd.factorize(before * len(first) + ids[at + size - 1])
        head = np.zeros(codes.max() + 1, np.int64)
        head[codes[::-1]] = np.arange(len(codes))[::-1]
        h = mix64(h[before[head]] * np.uint64(0x9E3779B97F4A7C15) + word[ids[at[head] + size - 1]])
        yield size, data, starts[at[head]], ends[at[head] + size - 1], h, np.bincount(codes)


def _by_lang(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[str, int, list[bytes]]]]:
    """Per piece its languages, each with a seed for hashes and its texts."""
    for batch, texts in pieces(batches, "body"):
        held: dict[str, list[bytes]] = {}
        for lang, t in zip(batch.column(batch.schema.get_field_index("lang")).to_pylist(), texts):
            held.setdefault(lang, []).append(t)
        yield [(lang, zlib.crc32(lang.encode()) * 0x9E3779B1 + 1, t) for lang, t in held.items()]


def _planes(x: np.ndarray) -> bytes:
    """The bytes of whole numbers, lowest ones of all first; as many as the largest needs."""
    n = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n].T.tobytes()


def _unplanes(b: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    planes = np.frombuffer(b, np.uint8).reshape(-1, n)
    out[:, : len(planes)] = planes.T
    return out.reshape(-1).view("<u8").astype(np.uint64)


def _counted(parts: int, many: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per piece and range of hashes: its mass (kind 0), and the hashes with their counts (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for langs in _by_lang(batches):
            found = [(h, n) for _, seed, texts in langs for size, _, _, _, h, n in _grams(texts, seed, many) if size]
            if not found:
                continue
            h = np.concatenate([x[0] for x in found]) >> np.uint64(64 - HASH_BITS)
            order = np.argsort(h)
            h, n = h[order], np.concatenate([x[1] for x in found])[order]
            edges = [-(-(p << HASH_BITS) // parts) for p in range(parts + 1)]
            cuts = np.searchsorted(h, np.array(edges, np.uint64))
            rows = []
            for p in np.flatnonzero(np.diff(cuts)).tolist():
                own, counts = h[cuts[p] : cuts[p + 1]], n[cuts[p] : cuts[p + 1]]
                gaps = np.diff(own, prepend=np.uint64(edges[p]))
                rows += [(p, 0, int(counts.sum()), 0, None, None), (p, 1, 0, len(own), _planes(gaps), _planes(counts))]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
            for at in range(0, len(rows), 64):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[at : at + 64]), kinds)], names=[f.split()[0] for f in SUMMARY.split(", ")])

    return run


class Summary:
    """Misra-Gries counters of hashes, merged from counts of parts."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.taken = capacity, 0
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.held.append((keys, counts))
        self.size += len(keys)
        if self.size > 2 * self.capacity + 1024:
            self.shrink()

    def shrink(self) -> tuple[np.ndarray, np.ndarray]:
        keys = np.concatenate([k for k, _ in self.held] or [np.zeros(0, np.uint64)])
        counts = np.concatenate([c for _, c in self.held] or [np.zeros(0, np.int64)]).astype(np.int64)
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
        heads = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
        keys, counts = keys[heads], np.add.reduceat(counts, heads) if len(heads) else counts
        if len(keys) > self.capacity:
            beyond = len(keys) - self.capacity - 1
            take = int(np.partition(counts, beyond)[beyond])  # of the first one beyond the capacity
            self.taken += take
            keys, counts = keys[counts > take], counts[counts > take] - take
        self.held, self.size = [(keys, counts)], len(keys)
        return keys, counts

    def survivors(self, least: int) -> np.ndarray:
        keys, counts = self.shrink()
        return keys[counts + self.taken >= least]


def _surviving(parts: int, least: int, bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(first, filter) of every range: the bytes of the filter that it sets, compressed, from byte first on."""

    def told(keys: np.ndarray) -> pa.RecordBatch:
        at = (keys >> np.uint64(HASH_BITS - bits)).astype(np.int64)
        first = int(at[0]) >> 3
        own = np.zeros((int(at[-1]) >> 3) - first + 1 << 3, bool)
        own[at - 8 * first] = True
        return pa.RecordBatch.from_arrays([pa.array([first], pa.int64()), pa.array([zlib.compress(np.packbits(own).tobytes(), 1)], pa.binary())], names=["first", "filter"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, mass, summary = -1, 0, None
        for batch in batches:
            for r in batch.to_pylist():
                if r["part"] != part:
                    if summary and len(keys := summary.survivors(least)):
                        yield told(keys)
                    part, mass, summary = r["part"], 0, None
                if r["kind"] == 0:  # all masses come before the first counts
                    mass += r["mass"]
                    continue
                summary = summary or Summary(SLACK * mass // least + 1)
                edge = np.uint64(-(-(part << HASH_BITS) // parts))
                summary.add(np.cumsum(_unplanes(r["gaps"], r["n"])) + edge, _unplanes(r["counts"], r["n"]))
        if summary and len(keys := summary.survivors(least)):
            yield told(keys)

    return run


def survivor_filter(texts: DataFrame, least: int, many: int, bits: int = FILTER_BITS) -> bytes:
    """One bit per hash value's first bits; set for every phrase of at least that many occurrences. At most 2**bits / 8 bytes reach the driver, plus one per range."""
    ranges = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = RANGES * ranges
    dealt = texts.mapInArrow(_counted(parts, many), SUMMARY).repartition(ranges, "part").sortWithinPartitions("part", "kind")
    out = np.zeros(1 << bits - 3, np.uint8)
    for r in dealt.mapInArrow(_surviving(parts, least, bits), "first long, filter binary").collect():  # bounded by the filter's size
        own = np.frombuffer(zlib.decompress(r["filter"]), np.uint8)
        out[r["first"] : r["first"] + len(own)] |= own
    return out.tobytes()


def counted_phrases(texts: DataFrame, passing: bytes, many: int, bits: int = FILTER_BITS) -> DataFrame:
    """(lang, phrase, f): exact counts of all phrases that pass the filter, and of all words of a language under the empty phrase."""
    held = texts.sparkSession.sparkContext.broadcast(passing)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.frombuffer(held.value, np.uint8)
        for langs in _by_lang(batches):
            for lang, seed, texts in langs:
                for size, data, starts, ends, h, n in _grams(texts, seed, many):
                    bit = (h >> np.uint64(64 - bits)).astype(np.int64)
                    pick = np.flatnonzero((bitmap[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8)) & 1) if size else np.zeros(1, np.int64)
                    starts, length = starts[pick], ends[pick] - starts[pick]
                    offsets = np.concatenate(([0], np.cumsum(length)))
                    body = data[np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], length)]
                    phrases = pa.StringArray.from_buffers(len(pick), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(body.tobytes()))
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(pick), pa.string()), phrases, pa.array(n[pick].astype(np.int64))], names=["lang", "phrase", "n"])

    return texts.mapInArrow(run, "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("f"))


def phrases(docs: DataFrame, few: int = FEW, many: int = MANY, least: int = LEAST, cover: int = COVER, top: int = TOP, bits: int = FILTER_BITS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases of few to many words.

    A-Z are lower-cased, texts split at ``. , ; : ! ?`` and line ends into pieces and these at blanks and tabs into words. a counts a phrase's occurrences within pieces, overlapping ones too,
    n all words of the language; l and r count the two parts at the cut of lowest score, floor(1000000 * a * a / (l * r)), ties to the first cut.
    Exact for counts below 10**16. Candidates occur at least `least` times; one is dropped if its words lie within a longer candidate (itself dropped or not) that
    makes up `cover` percent of its occurrences or more. Ranks go by score, then a, both falling, then the phrase's bytes.

    A null lang is ``und``, as is that value itself. Null and empty texts hold no word. Repeated rows count as often as they occur; ids and
    other columns aren't looked at. A text is held by one task whatever its length. An empty table gives no row.
    """
    # texts are dealt out as they lie: one language may hold most of them
    given = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("body"))
    passing = survivor_filter(given, least, many, bits)
    freq = cut(counted_phrases(given, passing, many, bits).where((F.col("f") >= least) | (F.col("phrase") == "")), "phrases")
    words = F.split("phrase", " ")
    own = freq.withColumn("words", words).where(F.size("words").between(2, many))
    sized = own.where(F.size("words") >= few)
    # every candidate meets the longest count of what holds it in one aggregation, without a join
    shorter = F.explode(F.flatten(F.transform(F.sequence(F.lit(few), F.greatest(F.lit(few), F.size("words") - 1)), lambda k: F.transform(F.sequence(F.lit(1), F.size("words") - k + 1), lambda i: F.array_join(F.slice("words", i, k), " ")))))
    held = sized.where(F.size("words") > few).select("lang", shorter.alias("phrase"), F.lit(None).cast("long").alias("a"), F.col("f").alias("within"))
    met = sized.select("lang", "phrase", F.col("f").alias("a"), F.lit(None).cast("long").alias("within")).unionByName(held)
    stay = met.groupBy("lang", "phrase").agg(F.max("a").alias("a"), F.max("within").alias("within")).where(F.col("within").isNull() | (100 * F.col("within") < cover * F.col("a")))
    stay = stay.select("lang", "phrase", "a", words.alias("words"))
    cuts = stay.select("lang", "phrase", "a", "words", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("words", F.lit(1), F.col("k")), " ").alias("left"), F.array_join(F.slice("words", F.col("k") + 1, F.size("words") - F.col("k")), " ").alias("right"))
    parts = freq.where("phrase <> ''")
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"]).drop("left")
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"]).drop("right")
    exact = [f"cast({c} as decimal(16, 0))" for c in ("a", "l", "r")]
    scored = cuts.withColumn("score", F.expr(f"{exact[0]} * {exact[0]} * 1000000 div ({exact[1]} * {exact[2]})"))
    best = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("b")).select("lang", "phrase", "a", "b.l", "b.r", "b.score")
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    # ranks within a slice first: a language's last window then sees no more than top rows of each slice
    ranked = best.withColumn("slice", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "slice").orderBy(*order))).where(F.col("rank") <= top)
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    totals = freq.where("phrase = ''").select("lang", F.col("f").alias("n"))
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
