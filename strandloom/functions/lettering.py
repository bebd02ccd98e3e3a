"""Words of ASCII and Latin-1 letters and digits in UTF-8 bytes, and their two- and three-letter pieces, as numbers."""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa

#: Bytes of text whose letters are held at a time, few enough for a processor's cache; a longer text is on its own.
BLOCK = 1 << 16

#: Letters of a word beyond which what is left of it is hashed at once.
LONG = 256

#: How words, two-letter pieces and three-letter pieces are held.
KINDS = np.int64, np.uint16, np.uint32

_ONE, _TWO = np.zeros(256, np.uint8), np.zeros(256, np.uint8)  # a letter's code point by its byte, and by the byte after C3
for _byte in range(256):
    if _byte < 128 and chr(_byte).isalnum():
        _ONE[_byte] = _byte
    elif 128 <= _byte < 192 and _byte + 64 not in (0xD7, 0xF7):  # × and ÷
        _TWO[_byte] = _byte + 64


def mixed(x: np.ndarray) -> np.ndarray:
    """Numbers of 64 bits, each bit of which depends on all bits of x (the finalizer of SplitMix64, one to one)."""
    x = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def _first(x: np.ndarray) -> np.ndarray:
    """Whether a sorted value is the first of its kind."""
    first = np.empty(len(x), bool)
    first[:1] = True
    np.not_equal(x[1:], x[:-1], out=first[1:])
    return first


def different(x: np.ndarray) -> np.ndarray:
    """The different values of x, sorted."""
    x = np.sort(x)
    return x[_first(x)]


def _hashes(letter: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Negative hashes of words: eight letters at a time are one number, and the numbers of longer words are mixed one after the other."""
    padded = np.concatenate((letter, np.zeros(8, np.uint8)))
    eight = np.ndarray(len(letter), "<u8", padded, strides=(1,))
    out, words = np.zeros(len(start), np.uint64), np.arange(len(start))
    while len(words):
        left = np.minimum(n, 8).astype(np.uint64)
        out[words] = mixed(out[words] ^ eight[start] & np.uint64(0xFFFFFFFFFFFFFFFF) >> np.uint64(64) - left * np.uint64(8))
        longer = n > 8
        words, start, n = words[longer], start[longer] + 8, n[longer] - 8
        if len(words) and n.max() > LONG:
            for w, at, rest in zip(*(x[n > LONG].tolist() for x in (words, start, n)), strict=True):
                out[w] ^= np.uint64(int.from_bytes(hashlib.blake2b(letter[at : at + rest].tobytes(), digest_size=8).digest(), "little"))
            words, start, n = (x[n <= LONG] for x in (words, start, n))
    return (out | np.uint64(1 << 63)).view(np.int64)


def _within(x: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different values of each part of x, sorted, and the new bounds of the parts."""
    for a, b in itertools.pairwise(bounds.tolist()):
        x[a:b].sort()
    first = np.append(_first(x), True)
    first[bounds] = True
    kept = np.flatnonzero(first[:-1])
    return x[kept], np.searchsorted(kept, bounds)


def _block(text: np.ndarray, ends: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """What features tells, of texts that end at ends."""
    code = _ONE[text]
    second = np.flatnonzero(text[:-1] == 0xC3) + 1
    second = second[text[second] >> 6 == 2]
    code[second] = _TWO[text[second]]
    at = np.flatnonzero(code != 0)
    letter = code[at]
    bounds = np.concatenate(([0], np.searchsorted(at, ends)))
    new = np.ones(len(at) + 1, bool)
    new[1:-1] = at[1:] - (letter[1:] >= 0xC0) != at[:-1] + 1  # a letter of two bytes begins at the byte before
    new[bounds] = True
    start = np.flatnonzero(new)
    start, n = start[:-1], np.diff(start)
    words = _within(_hashes(letter, start, n), np.searchsorted(start, bounds))
    wide = letter.astype(np.uint32)
    pairs = wide[:-1] << 8 | wide[1:]
    three = np.flatnonzero(~(new[1:-2] | new[2:-1]))
    triples, parts = _within((pairs[:-1] << 8 | wide[2:])[three], np.searchsorted(three, bounds))
    two = start[n == 2]  # the pairs of all longer words are in their triples
    of = np.repeat(np.arange(len(ends), dtype=np.uint64) << np.uint64(16), np.diff(parts))
    short = np.repeat(np.arange(len(ends), dtype=np.uint64) << np.uint64(16), np.diff(np.searchsorted(two, bounds)))
    both = different(np.concatenate((of | triples >> np.uint32(8), of | triples & np.uint32(0xFFFF), short | pairs[two])))
    return [words, ((both & np.uint64(0xFFFF)).astype(np.uint16), np.searchsorted(both, np.arange(len(ends) + 1, dtype=np.uint64) << np.uint64(16))), (triples, parts)]


def features(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Hashes of each text's different words (int64, negative), its different two-letter pieces (uint16, 8 bits a letter) and three-letter pieces (uint32), each with the bounds of the texts, which may be null."""
    texts = texts.cast(pa.large_string()).fill_null("")
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    blocks, i = [], 0
    while i < len(texts):
        j = max(int(np.searchsorted(ends, ends[i] + BLOCK, "right")) - 1, i + 1)
        blocks.append(_block(data[ends[i] : ends[j]], ends[i + 1 : j + 1] - ends[i]))
        i = j
    out = []
    for k, kind in enumerate(KINDS):
        sizes = [np.diff(x[k][1]) for x in blocks]
        out.append((np.concatenate([np.zeros(0, kind), *(x[k][0] for x in blocks)]), np.concatenate(([0], np.cumsum(np.concatenate([np.zeros(0, np.int64), *sizes]))))))
    return out


def counted(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different keys, sorted, and the sum of each one's counts."""
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(_first(keys))
    return keys[first], np.add.reduceat(counts[order], first) if len(first) else counts
