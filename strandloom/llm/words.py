"""Words of many texts at once: where they are, a hash of each, and numbers that are equal for equal words only."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
PIECE = 4 << 20  # bytes of text looked at together
LONG = 512  # bytes of a word beyond which it is hashed by itself
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pieces(batches: Iterator[pa.RecordBatch], text: str, size: int = PIECE) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with their texts, a null one empty; each holds about size bytes, or one row."""
    for batch in batches:
        texts = [t or b"" for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
        at, held = 0, 0
        for i, t in enumerate(texts):
            if held and held + len(t) > size:
                yield batch.slice(at, i - at), texts[at:i]
                at, held = i, 0
            held += len(t) + 1
        if at < len(texts):
            yield batch.slice(at), texts[at:]


def joined(texts: list[bytes], lower: bool = True, by: bytes = b"\n") -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts with one byte between any two, each text's start and, last, the end)."""
    data = np.frombuffer(by.join(texts), np.uint8)
    starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return (LOWER[data] if lower else data), starts


def spans(data: np.ndarray, blank: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of every run of bytes that aren't blank."""
    solid = np.zeros(len(data) + 2, np.int8)
    solid[1:-1] = ~blank[data]
    edges = np.flatnonzero(np.diff(solid))
    return edges[::2], edges[1::2]


def _eights(data: np.ndarray) -> np.ndarray:
    """At each byte, it and the seven behind it as one number; zeros behind the end."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, the same in every batch."""
    eights, size = _eights(data), ends - starts
    out = mix64((eights[starts] & _MASK[np.minimum(size, 8)]) + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    rest = np.flatnonzero((size > 8) & (size <= LONG))
    at = 8
    while len(rest):
        out[rest] = mix64(out[rest] ^ mix64((eights[starts[rest] + at] & _MASK[np.minimum(size[rest] - at, 8)]) + np.uint64(at)))
        at += 8
        rest = rest[size[rest] > at]
    for i in np.flatnonzero(size > LONG):
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def numbered(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of each word, first word of each number, hash of each number): equal numbers for equal words, and only for those.

    Words are grouped by hash and then held against the first of their group, byte by byte.
    """
    h = hashes(data, starts, ends)
    ids, _ = pd.factorize(h)
    first = np.zeros(ids.max() + 1 if len(ids) else 0, np.int64)
    first[ids[::-1]] = np.arange(len(ids))[::-1]
    if not _same(data, starts, ends, first[ids]):
        known: dict[bytes, int] = {}
        ids = np.array([known.setdefault(data[a:b].tobytes(), len(known)) for a, b in zip(starts, ends)], np.int64)
        first = np.zeros(len(known), np.int64)
        first[ids[::-1]] = np.arange(len(ids))[::-1]
    return ids, first, h[first]


def _same(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, head: np.ndarray) -> bool:
    eights, size = _eights(data), ends - starts
    if (size != size[head]).any():
        return False
    rest, at = np.flatnonzero(head != np.arange(len(head))), 0
    while len(rest):
        mask = _MASK[np.minimum(size[rest] - at, 8)]
        if ((eights[starts[rest] + at] ^ eights[starts[head[rest]] + at]) & mask).any():
            return False
        at += 8
        rest = rest[(size[rest] > at) & (size[rest] <= LONG)]
    return all(data[starts[i] : ends[i]].tobytes() == data[starts[head[i]] : ends[head[i]]].tobytes() for i in np.flatnonzero((size > LONG) & (head != np.arange(len(head)))))
