"""Near-duplicate passages by compact windows over min-hashed tokens.

Tokens are 5-word shingles. For each of ``FUNCTIONS`` hash functions a text's subsequences of at least ``LEAST`` tokens
are grouped by the token of least hash: a compact window (l, c, r) holds every subsequence that starts in l..c and
ends in c..r-1, all of which have token c's hash as their min-hash. The windows are the nodes of the hashes'
Cartesian tree, cut where fewer than LEAST tokens are left; there are about 2 n / LEAST of them.

1. Windows whose min-hash no other text has are dropped, then those whose starts don't overlap shared windows of ``ENOUGH`` functions.
2. Each window left takes the words around its anchor c along (``AROUND`` tokens to each side at most, within l..r), so that windows of
   one min-hash are compared where they meet, on the subsequences of LEAST tokens that both hold.
3. Equal subsequences: equality is transitive, so all that have a hash in common are one class, however many they are; nothing is lost.
4. Similar ones (Jaccard of ``SIMILAR`` or more): up to ``ALL_PAIRS`` different windows of a min-hash are all compared. Of more, first those
   that share a token which few of them have, and neighbours by what follows and by what precedes the anchor; then all pairs that
   share enough tokens, but for those that are one class already and whose subsequences all have a partner. No pair is left out.

Min-hashes of more than ``FEW`` windows never meet in one task: the windows, sorted by
what follows and by what precedes, are compared in blocks. Equal subsequences of different blocks are joined by hash; only windows take part that
share enough tokens with their neighbours in both orders, as in a sorted order no other window shares more. Similar ones of different blocks
meet in two steps: all that share the run of ``SHARED`` tokens at one place are similar and become one class by its hash; the others meet by the tokens that fewest windows of the min-hash have: two subsequences that are similar share one of the first ``PREFIX`` tokens of each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.llm.common import cut, discard
from strandloom.llm.graph import connected_components

WORDS = 5  # of a token
PASSAGE = 50  # words
LEAST = PASSAGE - WORDS + 1  # tokens
FUNCTIONS = 4
ENOUGH = 2  # functions whose shared windows must overlap
SIMILAR = 0.8
AROUND = LEAST - 1  # tokens to each side of an anchor
SPAN = 2 * AROUND + 1
OVERLAP = int(np.ceil(SIMILAR * LEAST - 1e-9))  # tokens that a passage of different tokens shares with a similar one, at least
PREFIX = LEAST - OVERLAP + 1
SHARED = int(np.ceil(SIMILAR * 2 * LEAST / (1 + SIMILAR) - 1e-9))  # tokens that similar passages of different tokens share
FEW = 1024
ALL_PAIRS = 64
RARE = 16  # windows that share a token, at most, for it to make pairs
NEIGHBOURS = 8
PIECE = 1 << 21  # bytes of text hashed at once
ROWS = 4096  # windows compared at once
PAIRS = 2048  # pairs compared at once

_RANDOM = np.random.default_rng(20_240_607)
_BYTE = _RANDOM.integers(1, 1 << 63, 256, np.uint64)
_BYTE[65:91] = _BYTE[97:123]
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_BYTE[_SPACE] = 0
_PLACE = _RANDOM.integers(1, 1 << 63, 1 << 16, np.uint64) | np.uint64(1)


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, place) of each word of a text's bytes, A-Z lower-cased: a sum over its bytes, weighed by their places."""
    hashes, places, at = [], [], 0
    while at < len(text):
        end = at + PIECE
        if end < len(text):  # a piece ends where a word does
            blank = np.flatnonzero(_SPACE[text[at:end]])
            if len(blank):
                end = at + int(blank[-1]) + 1
            else:
                more = np.flatnonzero(_SPACE[text[end:]])
                end = end + int(more[0]) if len(more) else len(text)
        piece = text[at:end]
        solid = ~_SPACE[piece]
        first = np.flatnonzero(solid & np.concatenate(([True], ~solid[:-1])))
        if len(first):
            place = np.arange(first[0], len(piece)) - np.repeat(first, np.diff(np.append(first, len(piece))))
            hashes.append(mix64(np.add.reduceat(_BYTE[piece[first[0] :]] * _PLACE[place & 0xFFFF], first - first[0])))
            places.append(first + at)
        at = end
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(places)


def tokens_of(words: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every run of five words (along the last axis)."""
    n = words.shape[-1] - WORDS + 1
    if n < 1:
        return np.zeros((*words.shape[:-1], 0), np.uint64)
    out = np.zeros((*words.shape[:-1], n), np.uint64)
    for i in range(WORDS):
        out = mix64(out ^ words[..., i : i + n]) + np.uint64(i + 1)
    return out


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of batches whose column body holds about PIECE bytes, with all words' hashes and each text's first word and end."""
    for batch in batches:
        body = batch.column(batch.schema.get_field_index("body"))
        size = np.concatenate(([0], np.cumsum([len(x) if x is not None else 0 for x in body.to_pylist()])))
        at = 0
        while at < len(batch):
            to = max(at + 1, int(np.searchsorted(size, size[at] + PIECE, "right")) - 1)
            part = batch.slice(at, to - at)
            texts = [x or b"" for x in part.column(batch.schema.get_field_index("body")).to_pylist()]
            starts = np.cumsum([0] + [len(x) + 1 for x in texts])
            words, places = word_hashes(np.frombuffer(b" ".join(texts), np.uint8))
            yield part, words, np.searchsorted(places, starts)
            at = to


def compact_windows(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(l, c, r) of every window in the texts [start, end) of one array of hashes.

    The Cartesian trees grow level by level for all texts together. Of equal least hashes the middle one
    becomes the node, so repetitive texts give shallow trees.
    """
    ls, cs, rs = [], [], []
    keep = ends - starts >= least
    left, right = starts[keep].astype(np.int64), ends[keep].astype(np.int64)
    while len(left):
        size = right - left
        at = np.cumsum(size) - size
        where = np.repeat(left - at, size) + np.arange(int(size.sum()))
        h = hashes[where]
        lowest = np.flatnonzero(h == np.repeat(np.minimum.reduceat(h, at), size))
        first = np.searchsorted(lowest, at)
        count = np.diff(np.append(first, len(lowest)))
        c = where[lowest[first + count // 2]]
        ls.append(left), cs.append(c), rs.append(right)
        left, right = np.concatenate((left, c + 1)), np.concatenate((c, right))
        keep = right - left >= least
        left, right = left[keep], right[keep]
    if not ls:
        none = np.zeros(0, np.int64)
        return none, none, none
    return np.concatenate(ls), np.concatenate(cs), np.concatenate(rs)


def function(f: int, tokens: np.ndarray) -> np.ndarray:
    return mix64(tokens ^ np.uint64((f + 1) * 0x9E3779B97F4A7C15 % 2**64))


# a window in one number: anchor, tokens before it and from it on that the window holds (of those that matter), function
def pack(l: np.ndarray, c: np.ndarray, r: np.ndarray, f: int) -> np.ndarray:
    return c << 16 | np.minimum(c - l, AROUND) << 10 | np.minimum(r - c, AROUND + 1) << 4 | f


def unpack(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, before, on, function)."""
    return at >> 16, at >> 10 & 63, at >> 4 & 63, at & 15


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, words, bounds in _texts(batches):
        tokens = tokens_of(words)
        starts, ends = bounds[:-1], bounds[1:] - WORDS + 1
        for f in range(FUNCTIONS):
            h = function(f, tokens)
            l, c, r = compact_windows(h, starts, ends)
            if not len(c):
                continue
            text = np.searchsorted(bounds, c, "right") - 1
            who = pa.array(text)
            base = bounds[text]
            columns = [pa.array(h[c].view(np.int64)), part.column(0).take(who), part.column(1).take(who), pa.array(pack(l - base, c - base, r - base, f))]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "uid", "doc_id", "at"])


def windows(texts: DataFrame) -> DataFrame:
    """(key, uid, doc_id, at) for each window of texts (uid, doc_id, body)."""
    return texts.select("uid", "doc_id", "body").mapInArrow(_windows, "key long, uid long, doc_id long, at long")


def _surroundings(hot: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(key, uid, at, words): the 16-bit hashes of the words around the anchors of windows that enough functions share.

    For hot min-hashes (key, uid, at, fore, aft): the words from the anchor on, and those up to the anchor's last one backwards.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, words, bounds in _texts(batches):
            short = (words >> np.uint64(48)).astype(np.uint16)
            lists = part.column(2)
            each = np.diff(lists.offsets.to_numpy())
            key, at, n = (x.to_numpy(zero_copy_only=False) for x in lists.flatten().flatten())
            text = np.repeat(np.arange(len(each)), each)
            c, before, on, f = unpack(at)
            first, last = c - before + bounds[text], c + np.minimum(on - LEAST, 0) + bounds[text]  # starts of passages
            many = np.zeros(len(words) + 1, np.int8)
            for k in range(FUNCTIONS):
                mine = f == k
                change = np.bincount(first[mine], minlength=len(many) + 1) - np.bincount(last[mine] + 1, minlength=len(many) + 1)
                many += np.cumsum(change)[:-1] > 0
            reached = np.concatenate(([0], np.cumsum(many >= ENOUGH)))
            keep = np.flatnonzero((reached[last + 1] > reached[first]) & ((n > FEW) == hot))
            if not len(keep):
                continue
            lo, size = first[keep], (before + on)[keep] + WORDS - 1
            start = np.cumsum(size) - size
            taken = short[np.repeat(lo - start, size) + np.arange(int(size.sum()))]
            offsets = pa.py_buffer(np.append(start, start[-1] + size[-1]).astype(np.int32) * 2)
            held = pa.Array.from_buffers(pa.binary(), len(keep), [None, offsets, pa.py_buffer(taken.tobytes())])
            columns = {"key": pa.array(key[keep]), "uid": part.column(0).take(pa.array(text[keep])), "at": pa.array(at[keep]), "words": held}
            if hot:
                columns["fore"], columns["aft"] = (pa.array(x, pa.binary()) for x in zip(*_sides(before[keep], columns.pop("words").to_pylist())))
            for i in range(0, len(keep), 10_000):
                yield pa.RecordBatch.from_arrays([x.slice(i, 10_000) for x in columns.values()], names=list(columns))

    return run


def _sides(before: np.ndarray, words: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
    for b, w in zip(before.tolist(), words):
        x = np.frombuffer(w, np.uint16)
        yield x[b:].tobytes(), x[: b + WORDS][::-1].tobytes()


def _joined(before: np.ndarray, fore: list[bytes], aft: list[bytes]) -> list[bytes]:
    """The words of windows from both sides."""
    return [np.frombuffer(a, np.uint16)[::-1][:b].tobytes() + f for b, f, a in zip(before.tolist(), fore, aft)]


class Block:
    """Windows of whole min-hashes (or of parts of hot ones) as arrays: key, uid, anchor and an aligned matrix of tokens."""

    def __init__(self, key: np.ndarray, uid: np.ndarray, at: np.ndarray, words: list[bytes]) -> None:
        self.key, self.uid = key, uid
        self.c, self.before, self.on, self.f = unpack(at)
        size = self.before + self.on + WORDS - 1
        row = np.repeat(np.arange(len(key)), size)
        column = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size - AROUND + self.before, size)
        wide = np.zeros((len(key), SPAN + WORDS - 1), np.uint64)
        wide[row, column] = np.frombuffer(b"".join(words), np.uint16)
        place = np.arange(SPAN)
        self.held = (place >= AROUND - self.before[:, None]) & (place < AROUND + self.on[:, None])
        filler = np.arange(self.held.size, dtype=np.uint64).reshape(self.held.shape) | np.uint64(1 << 63)
        self.tokens = np.where(self.held, tokens_of(wide) >> np.uint64(1), filler)  # fillers equal nothing
        self.first, self.last = AROUND - self.before, AROUND + self.on - LEAST  # starts of passages

    def valid(self) -> np.ndarray:
        start = np.arange(LEAST)
        return (start >= self.first[:, None]) & (start <= self.last[:, None])

    def runs(self) -> np.ndarray:
        """A hash of each passage of LEAST tokens: a polynomial of the tokens, modulo 2**64."""
        base = 0x9E3779B97F4A7C15
        powers = np.array([pow(base, i, 2**64) for i in range(SPAN)], np.uint64)
        inverse = np.array([pow(base, -i, 2**64) for i in range(LEAST)], np.uint64)
        sums = np.concatenate((np.zeros((len(self.key), 1), np.uint64), np.cumsum(self.tokens * powers, axis=1, dtype=np.uint64)), axis=1)
        hashes = mix64((sums[:, LEAST:] - sums[:, :-LEAST]) * inverse)
        return mix64(hashes ^ mix64(self.key.view(np.uint64)[:, None] + np.arange(LEAST, dtype=np.uint64)))


def _classes(hashes: np.ndarray, uid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the first row of its hash in order of uid, and whether other uids have the hash."""
    if not len(hashes):
        return np.zeros(0, np.int64), np.zeros(0, bool)
    order = np.lexsort((uid, hashes))
    h, u = hashes[order], uid[order]
    new = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
    last = np.append(new[1:], len(h)) - 1
    group = np.cumsum(np.concatenate(([0], h[1:] != h[:-1])))
    leader, shared = np.empty(len(h), np.int64), np.empty(len(h), bool)
    leader[order], shared[order] = order[new][group], (u[new] != u[last])[group]
    return leader, shared


def equal_passages(b: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, row, mark): rows that hold an equal passage, and for each row which starts another text has."""
    row, start = np.nonzero(b.valid())
    leader, shared = _classes(b.runs()[row, start], b.uid[row])
    mark = np.zeros((len(b.key), LEAST), bool)
    mark[row[shared], start[shared]] = True
    return row[leader[shared]], row[shared], mark


def candidates(b: Block) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one key to be compared; rows are sorted by key."""
    n = len(b.key)
    new = np.concatenate(([True], b.key[1:] != b.key[:-1]))
    group = np.cumsum(new) - 1
    size = np.bincount(group)[group]
    pairs = []

    def near(order: np.ndarray, same: np.ndarray, most: int) -> None:
        for s in range(1, most):
            k = np.flatnonzero(same[order][s:] == same[order][:-s])
            if not len(k):
                break
            x, y = order[k], order[k + s]
            pairs.append(np.minimum(x, y) * n + np.maximum(x, y))

    small, large = np.flatnonzero(size <= ALL_PAIRS), np.flatnonzero(size > ALL_PAIRS)
    near(small, group, ALL_PAIRS)
    if len(large):
        for side in (b.tokens[large, AROUND:], b.tokens[large, AROUND::-1]):
            near(large[np.lexsort((*side.T[::-1], group[large]))], group, NEIGHBOURS + 1)
        row, column = np.nonzero(b.held[large])
        row = large[row]
        both = mix64(b.tokens[large][b.held[large]] + mix64(group[row].astype(np.uint64)))
        kinds, which, count = np.unique(both, return_inverse=True, return_counts=True)
        rare = np.flatnonzero((count[which] > 1) & (count[which] <= RARE))
        rare = rare[np.argsort(which[rare], kind="stable")]
        for s in range(1, RARE):
            k = np.flatnonzero(which[rare][s:] == which[rare][:-s])
            if not len(k):
                break
            x, y = row[rare[k]], row[rare[k + s]]
            pairs.append(np.minimum(x, y)[x != y] * n + np.maximum(x, y)[x != y])
    if not pairs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    found = np.unique(np.concatenate(pairs))
    return found // n, found % n


def remaining(b: Block, label: np.ndarray, settled: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of keys of more than ALL_PAIRS rows all pairs of rows that share enough tokens, key by key, but for settled rows of one label; rows are sorted by key.

    A row whose tokens repeat has fewer different ones to share, by as many as repeat in it at most.
    """
    bounds = np.flatnonzero(np.concatenate(([True], b.key[1:] != b.key[:-1], [True])))
    for lo, hi in zip(bounds[:-1], bounds[1:]):
        if hi - lo <= ALL_PAIRS or (settled[lo:hi].all() and (label[lo:hi] == label[lo]).all()):
            continue
        n, held = hi - lo, b.held[lo:hi]
        row = np.nonzero(held)[0]
        kinds, which, count = np.unique(b.tokens[lo:hi][held], return_inverse=True, return_counts=True)
        both = np.unique(row * len(kinds) + which)
        more = held.sum(axis=1) - np.bincount(both // len(kinds), minlength=n)
        need = np.ceil(SIMILAR * np.maximum(LEAST - more, 1) - 1e-9)
        some = count[both % len(kinds)] > 1
        place = np.cumsum(count > 1) - 1
        row, column = both[some] // len(kinds), place[both[some] % len(kinds)]
        shared = np.zeros((n, n), np.float32)
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        for at in range(0, int(column[-1]) + 1 if len(column) else 0, ROWS):
            i, j = np.searchsorted(column, (at, at + ROWS))
            holds = np.zeros((n, ROWS), np.float32)
            holds[row[i:j], column[i:j] - at] = 1
            shared += holds @ holds.T
        open_ = ~settled[lo:hi]
        apart = open_[:, None] | open_ | (label[lo:hi, None] != label[lo:hi])
        plain = (more == 0)[:, None] & (more == 0)
        x, y = np.nonzero(np.triu(apart & (shared >= np.where(plain, SHARED, np.maximum(need[:, None], need))), 1))
        yield x + lo, y + lo


def shared_tokens(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many tokens the passages at each start of rows x and y share; no token, as a number below the bound, repeats within a row."""
    m, bound = len(x), int(max(x.max(), y.max())) + 1
    order = np.argsort(y, axis=1)
    base = np.arange(m, dtype=np.int64)[:, None] * bound
    flat = (np.take_along_axis(y, order, 1) + base).ravel()
    want = (x + base).ravel()
    at = np.minimum(np.searchsorted(flat, want), len(flat) - 1)
    k = np.flatnonzero(flat[at] == want)
    i, j, row = k % SPAN, order.ravel()[at[k]], k // SPAN
    first, last = np.maximum(np.maximum(i, j) - LEAST + 1, 0), np.minimum(np.minimum(i, j), LEAST - 1)
    ok = first <= last
    wide = LEAST + 1
    change = np.bincount(row[ok] * wide + first[ok], minlength=m * wide) - np.bincount(row[ok] * wide + last[ok] + 1, minlength=m * wide)
    return np.cumsum(change.reshape(m, wide), axis=1)[:, :LEAST]


def _by_sets(x: np.ndarray, y: np.ndarray, ok: np.ndarray) -> np.ndarray:
    """Which starts have similar passages, where tokens repeat."""
    out = np.zeros(LEAST, bool)
    for s in np.flatnonzero(ok):
        p, q = set(x[s : s + LEAST].tolist()), set(y[s : s + LEAST].tolist())
        both = len(p & q)
        out[s] = both >= SIMILAR * (len(p) + len(q) - both)
    return out


def similar_starts(b: Block, i: np.ndarray, j: np.ndarray, unequal: bool = False) -> np.ndarray:
    """For each pair of rows, at which starts their passages are similar enough; unequal: none for pairs that hold an equal passage."""
    if not len(i):
        return np.zeros((0, LEAST), bool)
    ranks = np.unique(b.tokens, return_inverse=True)[1].reshape(b.tokens.shape).astype(np.int64)
    ordered = np.sort(ranks, axis=1)
    repeats = (ordered[:, 1:] == ordered[:, :-1]).any(axis=1)
    valid = b.valid()
    out = np.zeros((len(i), LEAST), bool)
    for at in range(0, len(i), PAIRS):
        p, q = i[at : at + PAIRS], j[at : at + PAIRS]
        x, y, ok = ranks[p], ranks[q], valid[p] & valid[q]
        same = np.concatenate((np.zeros((len(p), 1), np.int64), np.cumsum(x == y, axis=1)), axis=1)
        aligned = same[:, LEAST:] - same[:, :-LEAST]
        plain = ~(repeats[p] | repeats[q])
        good = ok & np.where(plain[:, None], aligned >= SHARED, aligned == LEAST)
        rest = np.flatnonzero(plain & ~good.any(axis=1) & ok.any(axis=1))
        if len(rest):
            good[rest] = ok[rest] & (shared_tokens(x[rest], y[rest]) >= SHARED)
        for k in np.flatnonzero(~plain & ~good.any(axis=1) & ok.any(axis=1)):
            if len(set(x[k].tolist()) & set(y[k].tolist())) > 1:
                good[k] = _by_sets(x[k], y[k], ok[k])
        if unequal:
            good[(ok & (aligned == LEAST)).any(axis=1)] = False
        out[at : at + PAIRS] = good
    return out


def _labels(n: int, links: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each of n rows the first row that it is joined with."""
    a, z = (np.concatenate(x) for x in zip(*links)) if links else (np.zeros(0, np.int64),) * 2
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[z])
        told = label.copy()
        np.minimum.at(told, a, low)
        np.minimum.at(told, z, low)
        told = told[told]
        if (told == label).all():
            return label
        label = told


def compare(b: Block, exact: bool = True, unequal: bool = False, similar: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Links (uid, uid) that join all that belong together, and the word spans (uid, start, end) that others repeat; rows are sorted by key.

    unequal: only what pairs without an equal passage add. Without similar, equal passages only.
    """
    n = len(b.key)
    mark, links = np.zeros((n, LEAST), bool), []
    if exact:
        x, y, mark = equal_passages(b)
        links.append((x, y))
    # windows that are equal as a whole are compared once
    place = mix64(np.arange(SPAN, dtype=np.uint64) + np.uint64(7)) | np.uint64(1)
    whole = mix64((np.where(b.held, b.tokens, np.uint64(0)) * place).sum(axis=1, dtype=np.uint64) ^ mix64(b.key.view(np.uint64)))
    leader, shared = _classes(whole, b.uid)
    if not unequal:
        links.append((leader[shared], np.flatnonzero(shared)))
        mark |= shared[:, None] & b.valid()
    kinds = np.unique(leader)
    once = Block.__new__(Block)
    for name in ("key", "uid", "tokens", "held", "first", "last"):
        setattr(once, name, getattr(b, name)[kinds])
    seen = np.zeros((len(kinds), LEAST), bool)

    def meet(i: np.ndarray, j: np.ndarray) -> None:
        other = (once.uid[i] != once.uid[j]) | shared[kinds[i]] | shared[kinds[j]]
        i, j = i[other], j[other]
        good = similar_starts(once, i, j, unequal)
        hit = good.any(axis=1)
        i, j, good = i[hit], j[hit], good[hit]
        np.logical_or.at(seen, i, good)
        np.logical_or.at(seen, j, good)
        links.append((kinds[i], kinds[j]))

    if similar:
        meet(*candidates(once))
    if similar and not unequal:  # of min-hashes in several blocks all blocks' windows meet later
        label = _labels(n, links)[kinds]
        settled = (mark[kinds] | seen | ~once.valid()).all(axis=1)
        for i, j in remaining(once, label, settled):
            for at in range(0, len(i), PAIRS):
                x, y = i[at : at + PAIRS], j[at : at + PAIRS]
                settled = (mark[kinds] | seen | ~once.valid()).all(axis=1) if at else settled
                label = _labels(n, links)[kinds] if at else label
                k = ~(settled[x] & settled[y] & (label[x] == label[y]))
                meet(x[k], y[k])
    mark |= seen[np.searchsorted(kinds, leader)]
    label = _labels(n, links)
    edges = np.unique(np.stack((b.uid[label], b.uid), axis=1)[b.uid[label] != b.uid], axis=0)
    row, start = np.nonzero(mark)
    new = np.concatenate(([True], (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1))) if len(row) else np.zeros(0, bool)
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(row)) - 1 if len(head) else head
    begin = b.c[row[head]] - AROUND + start[head]
    return edges[:, 0], edges[:, 1], b.uid[row[head]], begin, begin + (start[tail] - start[head]) + PASSAGE


FOUND = "uid long, other long, start long, end long"  # a link or a span
HOT = FOUND + ", key long, at long, common int"  # or how many tokens a hot window shares with another on one side
RUNS = FOUND + ", hash long"  # one text's subsequence


def _rows(schema: str, **columns: np.ndarray | pa.Array) -> pa.RecordBatch:
    names = [f.split()[0] for f in schema.split(", ")]
    n = len(next(iter(columns.values())))
    kinds = {"common": pa.int32()}
    arrays = [pa.nulls(n, kinds.get(k, pa.int64())) if (x := columns.get(k)) is None else x if isinstance(x, pa.Array) else pa.array(x, kinds.get(k, pa.int64())) for k in names]
    return pa.RecordBatch.from_arrays(arrays, names=names)


def _emit(b: Block, exact: bool, schema: str = FOUND, unequal: bool = False) -> Iterator[pa.RecordBatch]:
    x, y, uid, start, end = compare(b, exact, unequal)
    yield _rows(schema, uid=y, other=x)
    yield _rows(schema, uid=uid, start=start, end=end)


def _common(b: Block, at: np.ndarray, right: bool) -> pa.RecordBatch:
    """For windows of the first function, in order of their tokens from the anchor on (or backwards from it): how many the longer-sharing neighbour has in common.

    In sorted order no other window of the min-hash shares more. At the ends of a block, where neighbours aren't known, all may be shared.
    """
    side = b.tokens[:, AROUND:] if right else b.tokens[:, AROUND::-1]
    same = np.cumprod((side[1:] == side[:-1]) & (b.key[1:] == b.key[:-1])[:, None], axis=1).sum(axis=1)
    most = np.maximum(np.append(LEAST, same), np.append(same, LEAST))
    pick = b.f == 0
    return _rows(HOT, uid=b.uid[pick], key=b.key[pick], at=at[pick], common=most[pick].astype(np.int32))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans and links of equal subsequences in each block of windows (key, uid, at, fore, aft), and the subsequences for other blocks: one row of those told here, without an end."""
    for batch in batches:
        for k in range(0, len(batch), ROWS):
            key, uid, at, fore, aft = (x.to_numpy(zero_copy_only=False) for x in batch.slice(k, ROWS).columns)
            b = Block(key, uid, at, _joined(unpack(at)[1], list(fore), list(aft)))
            x, y, of, begin, end = compare(b, exact=True, similar=False)
            yield _rows(RUNS, uid=y, other=x)
            yield _rows(RUNS, uid=of, start=begin, end=end)
            row, start = np.nonzero(b.valid())
            hashes = b.runs()[row, start]
            leader, shared = _classes(hashes, b.uid[row])
            once = np.flatnonzero(~shared | (leader == np.arange(len(leader))))
            place = b.c[row[once]] - AROUND + start[once]
            yield _rows(RUNS, uid=b.uid[row[once]], start=place, end=pa.array(place + PASSAGE, mask=shared[once]), hash=hashes[once].view(np.int64))


def _groups(whole: bool, right: bool = False) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Compares the windows of sorted rows (key, uid, at, words) or, if not whole, (key, uid, at, fore, aft); whole: min-hashes stay together; right: rows are sorted by fore, else by aft."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def blocks(table: pa.Table, to: int) -> Iterator[pa.RecordBatch]:
            part = table.slice(0, to).combine_chunks()
            key, uid, at = (part.column(k).to_numpy() for k in range(3))
            _, before, _, f = unpack(at)
            words = part.column(3).to_pylist() if whole else _joined(before, part.column(3).to_pylist(), part.column(4).to_pylist())
            first = f == 0
            for mine in (first, ~first):
                k = np.flatnonzero(mine)
                if len(k) > 1:
                    b = Block(key[k], uid[k], at[k], [words[x] for x in k])
                    # equal passages show in windows of the first function; hot ones are told apart from these blocks
                    yield from _emit(b, bool(first[k[0]])) if whole else _emit(b, False, HOT, True)
                if len(k) and not whole and first[k[0]]:
                    yield _common(Block(key[k], uid[k], at[k], [words[x] for x in k]), at[k], right)

        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            while len(held) > (ROWS if whole else FEW):
                to = FEW
                if whole:
                    key = held.column(0).to_numpy()
                    ends = np.flatnonzero(key[1:] != key[:-1]) + 1
                    ends = ends[: max(1, int(np.searchsorted(ends, ROWS)))]
                    if not len(ends):
                        break
                    to = int(ends[-1])
                yield from blocks(held, to)
                held = held.slice(to)
        if held is not None and len(held):
            yield from blocks(held, len(held))

    return run


def _split(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, Block]]:
    """Parts of rows (key, uid, at, fore, aft, ...) with their windows."""
    for k in range(0, len(batch), FEW):
        part = batch.slice(k, FEW)
        key, uid, at, fore, aft = (x.to_numpy(zero_copy_only=False) for x in part.columns[:5])
        yield part, Block(key, uid, at, _joined(unpack(at)[1], list(fore), list(aft)))


def _near_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, hash, uid, start, mask) for each run of SHARED tokens in rows (key, uid, at, fore, aft) whose tokens don't repeat.

    The hash is of the tokens and their place beside the anchor. start is the first word of the subsequence that begins with the run; bit k of the mask: the row holds that which begins k tokens before.
    """
    base = 0x9E3779B97F4A7C15
    powers, inverse = (np.array([pow(base, sign * i, 2**64) for i in range(SPAN)], np.uint64) for sign in (1, -1))
    for batch in batches:
        for _, b in _split(batch):
            ordered = np.sort(b.tokens, axis=1)
            plain = (ordered[:, 1:] != ordered[:, :-1]).all(axis=1)
            n = SPAN - SHARED + 1
            sums = np.concatenate((np.zeros((len(b.key), 1), np.uint64), np.cumsum(b.tokens * powers, axis=1, dtype=np.uint64)), axis=1)
            hashes = mix64((sums[:, SHARED:] - sums[:, :-SHARED]) * inverse[:n]) ^ mix64(np.arange(n, dtype=np.uint64))
            mask = np.zeros((len(b.key), n), np.int64)
            for k in range(LEAST - SHARED + 1):
                s = np.arange(n) - k
                mask |= ((s >= b.first[:, None]) & (s <= b.last[:, None])).astype(np.int64) << k
            row, place = np.nonzero((mask > 0) & plain[:, None])
            columns = b.key[row], hashes[row, place].view(np.int64), b.uid[row], b.c[row] - AROUND + place, mask[row, place].astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["key", "hash", "uid", "start", "mask"])


def nearly_equal(hot: DataFrame) -> DataFrame:
    """Links and spans of hot windows (key, uid, at, fore, aft) whose subsequences share a run of SHARED tokens at one place: all that do are similar, so each is linked with one of them."""
    runs = cut(hot.select("key", "uid", "at", "fore", "aft").mapInArrow(_near_runs, "key long, hash long, uid long, start long, mask int"), "hot-near-runs")
    each = range(LEAST - SHARED + 1)
    has = lambda k: F.col("mask").bitwiseAND(1 << k) > 0
    many = runs.groupBy("key", "hash").agg(F.count("*").alias("n"), *[F.count_if(has(k)).alias(f"n{k}") for k in each], *[F.min(F.when(has(k), F.col("uid"))).alias(f"u{k}") for k in each]).where("n > 1")
    told = F.array_compact(F.array(*[F.when(has(k) & (F.col(f"n{k}") > 1), F.struct(F.col(f"u{k}").alias("other"), (F.col("start") - k).alias("start"))) for k in each]))
    found = runs.join(many, ["key", "hash"]).select("uid", F.explode(told).alias("t")).select("uid", "t.other", "t.start").distinct()
    return cut(found.select("uid", "other", "start", (F.col("start") + PASSAGE).alias("end")), "hot-near")


def _held_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, token, wid, place) for each token of rows (key, uid, at, fore, aft, wid)."""
    for batch in batches:
        for part, b in _split(batch):
            row, place = np.nonzero(b.held)
            wid = part.column(5).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (b.key[row], b.tokens[row, place].view(np.int64), wid[row], place.astype(np.int32))], names=["key", "token", "wid", "place"])


def _ranks(count: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """The place of each token among all different ones in order of count, then token."""
    order = np.lexsort((tokens.ravel(), count.ravel()))
    c, t = count.ravel()[order], tokens.ravel()[order]
    rank = np.empty(len(order), np.int32)
    rank[order] = np.cumsum(np.concatenate(([0], (c[1:] != c[:-1]) | (t[1:] != t[:-1])))) if len(order) else 0
    return rank.reshape(tokens.shape)


def _leading(ranks: np.ndarray) -> np.ndarray:
    """Which places of each row hold one of the least m - SIMILAR * m + 1 of its m different ranks: rows similar as sets have one of these in common."""
    ordered = np.sort(ranks, axis=1)
    nth = np.cumsum(np.diff(ordered, axis=1, prepend=-1) > 0, axis=1)
    kinds = nth[:, -1]
    most = kinds - np.ceil(SIMILAR * kinds - 1e-9).astype(np.int64) + 1
    return ranks <= np.where(nth <= most[:, None], ordered, -1).max(axis=1, keepdims=True)


def _first_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, token, wid, open, wide, repeats) for the first tokens, by number of windows, of the subsequences of rows (key, uid, at, fore, aft, wid, shared, spans); open: one of those subsequences has no partner yet.

    shared are the (place, n) of tokens that n windows have, spans the word spans that have partners. Of a subsequence of m different tokens, those that it may lack of
    a similar one and one more count as first, in rows whose tokens repeat too; rows without repeats meet these by PREFIX tokens (wide), but one another by fewer,
    as they have more to share. A token that repeats in a window is told once.
    """
    for batch in batches:
        for part, b in _split(batch):
            count = np.ones(b.tokens.shape, np.int64)
            row, (place, n) = _flat(part.column(6))
            count[row, place] = n
            valid, start = b.valid(), b.c[:, None] - AROUND + np.arange(LEAST)
            done = np.zeros(valid.shape, bool)
            row, (begin, end) = _flat(part.column(7))
            low = np.clip(begin - start[row, 0], 0, LEAST)
            high = np.clip(end - PASSAGE + 1 - start[row, 0], low, LEAST)
            change = np.zeros((len(b.key), LEAST + 1), np.int64)
            np.add.at(change, (row, low), 1)
            np.add.at(change, (row, high), -1)
            done = np.cumsum(change, axis=1)[:, :LEAST] > 0
            rank = _ranks(count, b.tokens)
            ordered = np.sort(rank, axis=1)
            repeats = (ordered[:, 1:] == ordered[:, :-1]).any(axis=1)
            first, open_ = np.zeros((2, *b.held.shape), bool), np.zeros((2, *b.held.shape), bool)
            for s in range(LEAST):
                k = np.flatnonzero(valid[:, s])
                again = repeats[k]
                once, more = k[~again], k[again]
                mine = rank[once, s : s + LEAST]
                least = np.partition(mine, (LEAST - SHARED, PREFIX - 1), axis=1)
                told = [(0, once, mine <= least[:, LEAST - SHARED, None]), (1, once, mine <= least[:, PREFIX - 1, None])]
                if len(more):
                    told.append((0, more, _leading(rank[more, s : s + LEAST])))
                for wide, k, into in told:
                    first[wide, k, s : s + LEAST] |= into
                    open_[wide, k, s : s + LEAST] |= into & ~done[k, s, None]
            first[1] &= ~first[0] | (open_[1] & ~open_[0])
            wide, row, place = np.nonzero(first & (count > 1))
            _, head, same = np.unique((wide * len(rank) + row) * rank.size + rank[row, place], return_index=True, return_inverse=True)
            open_ = np.bincount(same, open_[wide, row, place], len(head)) > 0
            wide, row, place = wide[head], row[head], place[head]
            columns = b.key[row], b.tokens[row, place].view(np.int64), part.column(5).to_numpy()[row], open_, wide == 1, repeats[row]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["key", "token", "wid", "open", "wide", "repeats"])


def _flat(lists: pa.ListArray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Rows and fields of the structs in a column of lists."""
    row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    return row, [x.to_numpy(zero_copy_only=False) for x in lists.flatten().flatten()]


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links and spans of pairs of windows (key, uid, at, fore, aft of both)."""
    for batch in batches:
        for k in range(0, len(batch), FEW):
            part = batch.slice(k, FEW)
            left, right = ([x.to_numpy(zero_copy_only=False) for x in part.columns[i : i + 5]] for i in (0, 5))
            key, uid, at, fore, aft = (np.concatenate(x) for x in zip(left, right))
            b = Block(key, uid, at, _joined(unpack(at)[1], list(fore), list(aft)))
            n = len(part)
            good = similar_starts(b, np.arange(n), np.arange(n, 2 * n))
            hit = np.flatnonzero(good.any(axis=1))
            yield _rows(FOUND, uid=b.uid[n + hit], other=b.uid[hit])
            row, start = np.nonzero(np.concatenate((good, good)))
            if len(row):
                place = b.c[row] - AROUND + start
                head = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1))))
                tail = np.append(head[1:], len(row)) - 1
                yield _rows(FOUND, uid=b.uid[row[head]], start=place[head], end=place[tail] + PASSAGE)


def similar_across(hot: DataFrame, found: DataFrame) -> DataFrame:
    """What pairs of hot windows (key, uid, at, fore, aft) add to what was found: links and spans of all that are similar, whatever block they are in.

    Windows that are equal as a whole hold equal passages, so one of them is compared. Pairs that meet by a frequent token are dealt in a grid of blocks. No pair
    is compared where both belong together already and all that the token stands for has a partner.
    """
    before, held = F.shiftright("at", 10).bitwiseAND(63), F.shiftright("at", 4).bitwiseAND(63)
    one = hot.groupBy("key", before.alias("before"), held.alias("on"), "fore", "aft").agg(F.min(F.struct("uid", "at")).alias("w"), (F.min("uid") != F.max("uid")).alias("many"))
    one = cut(one.select("key", "w.uid", "w.at", "fore", "aft", "many").withColumn("wid", F.monotonically_increasing_id()), "hot-kinds")
    near = nearly_equal(one)
    found = found.union(near)
    tokens = cut(one.select("key", "uid", "at", "fore", "aft", "wid").mapInArrow(_held_tokens, "key long, token long, wid long, place int"), "hot-tokens")
    counts = tokens.groupBy("key", "token").agg(F.count_distinct("wid").alias("n")).where("n > 1")
    shared = tokens.join(counts, ["key", "token"]).groupBy("wid").agg(F.collect_list(F.struct("place", F.col("n").cast("int").alias("n"))).alias("shared"))
    edges = found.where("other IS NOT NULL AND other <> uid").select(F.col("other").alias("a"), F.col("uid").alias("b")).distinct()
    labels = connected_components(edges, "hot").select(F.col("node").alias("uid"), "label")
    spans = found.where("start IS NOT NULL").join(one.select("uid").distinct(), "uid", "left_semi").groupBy("uid").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    ready = one.join(shared, "wid").join(spans, "uid", "left")
    ready = ready.select("key", "uid", "at", "fore", "aft", "wid", "shared", F.coalesce("spans", F.array().cast("array<struct<start:bigint,end:bigint>>")).alias("spans"))
    label = one.select("wid", "uid").join(labels, "uid", "left").select("wid", F.coalesce("label", "uid").alias("label"))
    first = cut(ready.mapInArrow(_first_tokens, "key long, token long, wid long, open boolean, wide boolean, repeats boolean").join(label, "wid"), "hot-first")
    narrow = lambda c: F.when(~F.col("wide"), F.col(c))
    some = first.groupBy("key", "token").agg(F.max("repeats").alias("r"), *[f(of(c)).alias(n + k) for k, of in (("", F.col), ("0", narrow)) for n, f, c in (("n", F.count, "wid"), ("any", F.max, "open"), ("a", F.min, "label"), ("z", F.max, "label"))])
    some = some.where("IF(r, n > 1 AND (any OR a <> z), n0 > 1 AND (any0 OR a0 <> z0))")
    blocks = F.ceil(F.col("n") / FEW).cast("int")
    dealt = first.join(some.select("key", "token", "r", blocks.alias("blocks")), ["key", "token"]).where("r OR NOT wide").withColumn("mine", F.pmod(F.xxhash64("wid"), "blocks").cast("int"))
    dealt = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = lambda n: dealt.select("key", "token", F.least("mine", "with").alias("i"), F.greatest("mine", "with").alias("j"), *[F.col(c).alias(c + n) for c in ("wid", "open", "label", "mine", "wide", "repeats")])
    met = side("1").join(side("2"), ["key", "token", "i", "j"]).where("wid1 < wid2 AND (open1 OR open2 OR label1 <> label2) AND (mine1 <> mine2 OR i = j) AND (NOT wide1 OR repeats2) AND (NOT wide2 OR repeats1)")
    pairs = cut(met.select("wid1", "wid2").distinct(), "hot-pairs")
    window = lambda n: one.select(F.col("wid").alias(f"wid{n}"), *[F.col(c).alias(c + n) for c in ("key", "uid", "at", "fore", "aft", "many")])
    both = pairs.join(window("1"), "wid1").join(window("2"), "wid2").where("uid1 <> uid2 OR many1 OR many2")
    return cut(both.select(*[c + n for n in "12" for c in ("key", "uid", "at", "fore", "aft")]).mapInArrow(_met, FOUND), "hot-similar").union(near)


def shared_windows(texts: DataFrame) -> DataFrame:
    """(uid, least, at): each text's windows whose min-hash another text has, as (key, at, n); n counts the min-hash's windows.

    least is the smallest doc_id of the rows with this text.
    """
    every = cut(windows(texts), "windows")
    keys = every.groupBy("key").agg(F.min("uid").alias("a"), F.max("uid").alias("z"), F.count("*").alias("n")).where("a <> z").select("key", "n")
    mine = every.join(keys, "key")
    found = cut(mine.groupBy("uid").agg(F.min("doc_id").alias("least"), F.collect_set(F.struct("key", "at", "n")).alias("at")), "shared-windows")
    discard(every)
    return found


def repeated_passages(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) of texts that share passages, enough of them to join all that do, and word spans (uid, start, end) that others repeat.

    texts are (uid, doc_id, body); rows of one uid have equal bodies.
    """
    shared = shared_windows(texts)
    def around(found: DataFrame, hot: bool) -> DataFrame:
        found = found.withColumnRenamed("uid", "of")
        of = (F.col("uid") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("least"))
        return texts.join(found, of).select("uid", "body", "at").mapInArrow(_surroundings(hot), "key long, uid long, at long, " + ("fore binary, aft binary" if hot else "words binary"))

    normal = around(shared, False).repartition("key").sortWithinPartitions("key", "uid")
    found = [cut(normal.mapInArrow(_groups(True), FOUND), "passages")]
    hot = shared.where(F.exists("at", lambda w: w["n"] > FEW))
    if not hot.isEmpty():
        hot = cut(around(hot, True), "hot-windows")
        shares = []
        for side in ("fore", "aft"):
            order = ["key", side, "uid"]
            placed = hot.repartitionByRange(*order).sortWithinPartitions(*order)
            told = cut(placed.mapInArrow(_groups(False, side == "fore"), HOT), "hot-passages")
            found.append(told.where("common IS NULL").select(*found[0].columns))
            shares.append(told.where("common IS NOT NULL").groupBy("key", "uid", "at").agg(F.max("common").alias(side)))
        # windows of equal passages in other blocks: those that share enough tokens on both sides, the anchor counting twice
        both = shares[0].join(shares[1].withColumnsRenamed({"aft": "back"}), ["key", "uid", "at"]).where(F.col("fore") + F.col("back") > LEAST)
        some = hot.join(both.select("key", "uid", "at"), ["key", "uid", "at"], "left_semi")
        order = ["key", "fore", "uid"]
        runs = cut(some.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_runs, RUNS), "hot-runs")
        found.append(runs.where("hash IS NULL").select(*found[0].columns))
        runs = runs.where("hash IS NOT NULL")
        same = runs.groupBy("hash").agg(F.min("uid").alias("a"), F.max("uid").alias("z")).where("a <> z").select("hash", "a")
        told = F.col("end").isNotNull()
        found.append(cut(runs.join(same, "hash").select("uid", F.col("a").alias("other"), F.when(told, F.col("start")).alias("start"), "end"), "hot-equal"))
        found.append(similar_across(hot, reduce(DataFrame.union, found[1:])))
    joined = reduce(DataFrame.union, found)
    edges = joined.where("other IS NOT NULL AND other <> uid").select(F.col("other").alias("a"), F.col("uid").alias("b")).distinct()
    return edges, joined.where("start IS NOT NULL").select("uid", "start", "end")


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])))
def merged_udf(spans: pd.Series) -> pd.Series:
    out = []
    for s in spans:
        joined: list[list[int]] = []
        for a, b in sorted((x["start"], x["end"]) for x in s):
            if joined and a <= joined[-1][1]:
                joined[-1][1] = max(b, joined[-1][1])
            else:
                joined.append([a, b])
        out.append([{"start": a, "end": b} for a, b in joined])
    return pd.Series(out)


def passage_classes(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_words, class_id, spans.

    spans are the word ranges that other texts repeat, near-duplicates included, from PASSAGE words up. Texts that share
    passages, and equal texts of PASSAGE words or more, form classes. class_id is a class's smallest doc_id, or null for a document that shares
    nothing. A copied text's spans are the whole text. Null, empty and short texts share nothing; null doc_ids are carried but name no class
    unless all of a class's are null; repeated rows are copies; a passage repeated within one text only doesn't count. Other columns aren't
    looked at, whatever their names.
    """
    text = F.coalesce("text", F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("uid"))
    n_words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    facts = cut(base.select("doc_id", "uid", n_words.alias("n_words")), "texts")
    kinds = cut(facts.groupBy("uid").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"), F.max("n_words").alias("n_words")), "kinds")
    edges, side = repeated_passages(base.select("uid", "doc_id", F.col("text").cast("binary").alias("body")))
    labels = connected_components(edges, "passages")
    spans = side.groupBy("uid").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    known = labels.withColumnRenamed("node", "uid").join(spans, "uid")
    long_copy = (F.col("copies") > 1) & (F.col("n_words") >= PASSAGE)
    joined = kinds.join(known, "uid", "left").where(long_copy | F.col("label").isNotNull())
    joined = cut(joined.withColumn("label", F.coalesce("label", "uid")), "classes")
    least = cut(joined.groupBy("label").agg(F.min("least").alias("class_id")), "class-ids")
    none = F.array().cast("array<struct<start:int,end:int>>")
    whole = F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").cast("int").alias("end")))
    result = joined.join(least, "label").select("uid", "class_id", F.when(long_copy, whole).otherwise(merged_udf(F.coalesce("spans", none.cast("array<struct<start:bigint,end:bigint>>")))).alias("spans"))
    result = cut(result, "class-rows")
    return facts.join(result, "uid", "left").select("doc_id", "n_words", "class_id", F.coalesce("spans", none).alias("spans"))
