"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

A window is ten consecutive words of a benchmark item (all words of a shorter item). Windows of
one length form a table: for each block of two words, how far a search may shift when its window
ends with that block; for blocks that end a window, a bucket of the windows by their suffix and
prefix blocks. The search looks at the last block of its position only, skips as far as the table lets it, and compares
directly in the bucket.

Documents are never shuffled: the benchmark comes to them, in blocks of at most ``BLOCK_BYTES`` of item
text or so. With more than one block, each passes over the documents and writes its hits only, which are
then joined to the documents.
"""

from __future__ import annotations

import hashlib
import uuid
import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.llm.common import cut, fresh

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WINDOW = 10
BLOCK_BYTES = 1 << 20

HITS = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
    T.StructField("items", T.ArrayType(T.StringType())),
])


def words_of(text: bytes | None) -> list[bytes]:
    return WORD.findall((text or b"").lower())  # bytes.lower knows A-Z only


class WindowTable:
    """Shift table and buckets of windows of one length."""

    def __init__(self, length: int) -> None:
        self.length, self.block = length, min(2, length)
        self.far = length - self.block + 1
        self.shift: dict[tuple, int] = {}
        self.bucket: dict[tuple, dict[tuple, dict[tuple, list[str]]]] = {}  # by suffix, then prefix: windows and their items

    def add(self, window: list[bytes], item: str | None) -> None:
        b = self.block
        for end in range(b, self.length + 1):
            key = tuple(window[end - b : end])
            self.shift[key] = min(self.shift.get(key, self.far), self.length - end)
        same_prefix = self.bucket.setdefault(tuple(window[-b:]), {}).setdefault(tuple(window[:b]), {})
        items = same_prefix.setdefault(tuple(window), [])
        if not items or items[-1] != item:  # an item's windows come together
            items.append(item)

    def search(self, words: list[bytes]) -> Iterable[tuple[int, list[str]]]:
        """(start, items) of every occurrence."""
        length, b, far, shift = self.length, self.block, self.far, self.shift.get
        at, n = length, len(words)
        while at <= n:
            suffix = tuple(words[at - b : at])
            step = shift(suffix, far)
            if step:
                at += step
                continue
            start = at - length
            # direct comparison of the words with the bucket's windows
            if (same := self.bucket[suffix].get(tuple(words[start : start + b]))) and (items := same.get(tuple(words[start:at]))):
                yield start, items
            at += 1


def build_tables(items: Iterable[tuple[str | None, bytes | None]], width: int) -> list[WindowTable]:
    tables: dict[int, WindowTable] = {}
    for item, text in items:
        words = words_of(text)
        length = min(width, len(words))
        for i in range(len(words) - length + 1 if words else 0):
            tables.setdefault(length, WindowTable(length)).add(words[i : i + length], item)
    return list(tables.values())


def find_hits(text: bytes | None, tables: list[WindowTable]) -> tuple[int, list[tuple[int, int]], list[str]]:
    """(number of words, hit spans of words, ids of items with windows in the text)."""
    words = words_of(text)
    found, ids = [], set()
    for table in tables:
        for start, items in table.search(words):
            found.append((start, start + table.length))
            ids.update(items)
    return len(words), merge_spans(found), sorted(i for i in ids if i is not None)


def merge_spans(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


_BUILT: dict = {}  # of a Python worker, which outlives its tasks: the tables of the block that it searched last


def _tables_of(tag: str, build):
    if tag not in _BUILT:
        _BUILT.clear()
        _BUILT[tag] = build()
    return _BUILT[tag]


def _hits_of(block: DataFrame, width: int):
    items = [(r["item"], bytes(r["body"]) if r["body"] is not None else None) for r in block.collect()]
    shared, tag = block.sparkSession.sparkContext.broadcast(items), uuid.uuid4().hex

    @F.pandas_udf(HITS)
    def hits(texts: pd.Series) -> pd.DataFrame:
        tables = _tables_of(tag, lambda: build_tables(shared.value, width))
        rows = [find_hits(t, tables) for t in texts]
        as_rows = [[{"start": a, "end": b} for a, b in spans] for _, spans, _ in rows]
        return pd.DataFrame({"n_words": [r[0] for r in rows], "spans": as_rows, "items": [r[2] for r in rows]})

    return hits


@F.pandas_udf(HITS)
def _join_hits(texts: pd.Series, spans: pd.Series, items: pd.Series) -> pd.DataFrame:
    n = [len(words_of(t)) for t in texts]
    merged = [merge_spans((s["start"], s["end"]) for s in (x if x is not None else ())) for x in spans]
    ids = [sorted(set(x)) if x is not None else [] for x in items]
    return pd.DataFrame({"n_words": n, "spans": [[{"start": a, "end": b} for a, b in m] for m in merged], "items": ids})


def mark_hits(docs: DataFrame, benchmark: DataFrame, out: str = "hits", width: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with one more column, out (it replaces one so named): struct(n_words, spans, items).

    spans are the merged [start, end) word ranges inside any occurrence of a window; items the
    ids, as sorted different strings, of the items with occurring windows. A null or empty text has no words. Items
    without words have no window; an item whose id is null marks words but isn't listed. Repeated rows are marked alike,
    very long texts are searched whole, and an empty table on either side gives no hits.
    """
    body = F.col("text").cast("binary")
    bench = benchmark.select(F.col("item_id").cast("string").alias("item"), body.alias("body"))
    total = bench.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    n_blocks = -(-total // block_bytes) or 1
    if n_blocks == 1:
        return docs.withColumn(out, _hits_of(bench, width)(body))
    key = [F.col("doc_id").alias("doc"), F.xxhash64("text").alias("text_hash")]
    part = F.pmod(F.xxhash64("item", "body"), F.lit(n_blocks))
    found = None
    for b in range(n_blocks):
        hits = docs.select(*key, _hits_of(bench.where(part == b), width)(body).alias("h")).where(F.size("h.spans") > 0)
        hits = cut(hits.dropDuplicates(["doc", "text_hash"]), "hits")
        found = hits if found is None else found.union(hits)
    of, text_hash, spans, items = fresh(docs, "of", "hash", "spans", "items")
    found = found.groupBy(F.col("doc").alias(of), F.col("text_hash").alias(text_hash)).agg(F.flatten(F.collect_list("h.spans")).alias(spans), F.flatten(F.collect_list("h.items")).alias(items))
    same = docs["doc_id"].eqNullSafe(found[of]) & (F.xxhash64(docs["text"]) == found[text_hash])
    return docs.join(found, same, "left").withColumn(out, _join_hits(body, spans, items)).drop(of, text_hash, spans, items)


def n_hit(hits: str) -> Column:
    return F.aggregate(f"{hits}.spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()
