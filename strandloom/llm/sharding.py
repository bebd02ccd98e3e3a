"""Reproducible shuffle into shards: a Feistel permutation of global row numbers.

Row r goes to place p = permutation(r), shard p mod n and slot p div n, so the shards' counts differ by one at
most and slots have no gaps. The place is computed from the row number, the number of rows and a seed;
``row_at`` computes the way back.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.llm.common import fresh, number_rows

ROUNDS = 6
SEED = 20_240_607


def _mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finalizer."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _round(half: np.ndarray, seed: int, k: int, mask: np.uint64) -> np.ndarray:
    return _mix(half + np.uint64((seed * ROUNDS + k + 1) * 0x9E3779B97F4A7C15 % 2**64)) & mask


def permute(x: np.ndarray, n: int, seed: int = SEED, back: bool = False) -> np.ndarray:
    """A permutation of 0..n-1, or its inverse.

    The network permutes the numbers of an even count of bits, of which fewer than three in four are
    n or more; those walk on along their cycle until they fall below n.
    """
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    bits, mask = np.uint64(half), np.uint64((1 << half) - 1)
    out = x.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        a, b = out[todo] >> bits, out[todo] & mask
        for k in reversed(range(ROUNDS)) if back else range(ROUNDS):
            a, b = (b ^ _round(a, seed, k, mask), a) if back else (b, a ^ _round(b, seed, k, mask))
        out[todo] = (a << bits) | b
        todo = todo[out[todo] >= np.uint64(n)]
    return out.astype(np.int64)


def row_at(shard: np.ndarray, slot: np.ndarray, n: int, n_shards: int, seed: int = SEED) -> np.ndarray:
    """The row number that lies at a shard's slot."""
    return permute(slot * n_shards + shard, n, seed, back=True)


def place(row_no: Column, n: int, seed: int = SEED) -> Column:
    @F.pandas_udf(T.LongType())
    def placed(rows: pd.Series) -> pd.Series:
        return pd.Series(permute(rows.to_numpy(), n, seed))

    return placed(row_no)


def assign(docs: DataFrame, n_shards: int = 8, seed: int = SEED, by: list[str] | None = None) -> DataFrame:
    """docs with three more columns: row_no, shard and slot; they replace columns so named.

    Rows are numbered by doc_id (null last) and the text's hashes, or by the columns named in by, so neither files nor partitions matter; rows
    equal in these take each other's places. Null, empty and very long texts are rows like others, repeated rows are rows of their own, and an
    empty table gives an empty one. All columns of docs travel, so leave out texts that aren't wanted and name what orders the rows.
    """
    docs = docs.drop("row_no", "shard", "slot")
    text_hash, crc, at = fresh(docs, "hash", "crc", "at")
    if by is None:
        docs = docs.withColumns({text_hash: F.xxhash64("text"), crc: F.crc32(F.col("text").cast("binary"))})
    order = [F.col(f"`{c}`").asc_nulls_last() for c in by or ["doc_id", text_hash, crc]]
    numbered = number_rows(docs, order, "numbered").drop(text_hash, crc)
    n = numbered.count()
    placed = numbered.withColumn(at, place(F.col("row_no"), n, seed))
    return placed.withColumns({"shard": F.pmod(at, F.lit(n_shards)).cast("int"), "slot": F.expr(f"`{at}` div {n_shards}")}).drop(at)
