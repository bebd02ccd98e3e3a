"""Lossless WebP: a decoder of the whole format and an encoder of grey samples.

The decoder reads prefix codes (simple and canonical, by meta groups), literals, back-references and the colour
cache, and inverts the predictor, cross-colour, subtract-green and palette transforms. Where an image has
one group of codes and no cache, which is what the encoder writes, symbols are looked up for all bit positions of a ``SEGMENT`` at once and
only the chain of positions is followed one by one; other images take the plain loop.

The encoder takes, for each image, the palette or the predictor (none, left or above) whose samples have the least entropy, and
writes back-references, short ones for distances in the two-dimensional map. It has no use for cross-colour, the colour cache and meta groups,
as grey samples have one channel; the decoder knows them.
"""

from __future__ import annotations

import functools
import heapq
import struct
from collections import Counter

import numpy as np

# Fixed values of the format.
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
DISTANCE_MAP = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3),
    (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3),
    (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5),
    (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7),
    (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1), (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7),
    (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6),
    (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
LENGTH_CODES, DISTANCE_CODES = 24, 40
CACHE_FACTOR = 0x1E35A7BD
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = 0, 1, 2, 3
LEFT, ABOVE = 1, 2  # modes of the predictor


class Bits:
    """Reads bits from the lowest of each byte up."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at = data + bytes(8), 0

    def read(self, n: int) -> int:
        at = self.at
        self.at = at + n
        return int.from_bytes(self.data[at >> 3 : (at >> 3) + 8], "little") >> (at & 7) & ((1 << n) - 1)

    def peek(self, n: int) -> int:
        at = self.at
        return int.from_bytes(self.data[at >> 3 : (at >> 3) + 8], "little") >> (at & 7) & ((1 << n) - 1)


_LONGEST_CODE = 15
_BACKWARDS = [0]  # each number of _LONGEST_CODE bits with its bits in the other order
for _k in range(_LONGEST_CODE):
    _BACKWARDS += [x | 1 << (_LONGEST_CODE - 1 - _k) for x in _BACKWARDS]


def canonical(lengths: dict[int, int]) -> dict[int, tuple[int, int]]:
    """symbol: (code with its first bit lowest, length) for symbols' lengths."""
    out, code, last = {}, 0, 0
    for n, s in sorted((n, s) for s, n in lengths.items() if n):
        code <<= n - last
        out[s] = (_BACKWARDS[code] >> (_LONGEST_CODE - n), n)
        code, last = code + 1, n
    return out


class PrefixCode:
    """Lookup tables of a prefix code: the symbol and the length for each value of the next bits."""

    def __init__(self, lengths: dict[int, int]) -> None:
        if len(lengths) == 1:  # takes no bits
            self.bits, self.symbols, self.lengths = 0, np.array(list(lengths), np.int32), np.zeros(1, np.int32)
            return
        codes = canonical(lengths)
        self.bits = max((n for _, n in codes.values()), default=0)
        self.symbols, self.lengths = np.zeros(1 << self.bits, np.int32), np.zeros(1 << self.bits, np.int32)
        for s, (code, n) in codes.items():
            self.symbols[code :: 1 << n] = s
            self.lengths[code :: 1 << n] = n

    def read(self, bits: Bits) -> int:
        i = bits.peek(self.bits)
        bits.at += int(self.lengths[i])
        return int(self.symbols[i])


def read_prefix_code(bits: Bits, alphabet: int) -> PrefixCode:
    if bits.read(1):
        two = bits.read(1)
        symbols = [bits.read(8 if bits.read(1) else 1)]
        if two:
            symbols.append(bits.read(8))
        return PrefixCode(dict.fromkeys(symbols, 1))
    given = bits.read(4) + 4
    lengths = {s: n for s in CODE_LENGTH_ORDER[:given] if (n := bits.read(3))}
    code = PrefixCode(lengths)
    left = alphabet if not bits.read(1) else 2 + bits.read(2 + 2 * bits.read(3))
    out: dict[int, int] = {}
    at, previous = 0, 8
    symbols, sizes, width = code.symbols.tolist(), code.lengths.tolist(), code.bits
    while at < alphabet and left:
        left -= 1
        i = bits.peek(width)
        s = symbols[i]
        bits.at += sizes[i]
        if s < 16:
            if s:
                out[at] = previous = s
            at += 1
        elif s == 16:
            for _ in range(3 + bits.read(2)):
                out[at] = previous
                at += 1
        else:
            at += 3 + bits.read(3) if s == 17 else 11 + bits.read(7)
    return PrefixCode({s: n for s, n in out.items() if s < alphabet})


def _prefixed(symbol: int, bits: Bits) -> int:
    """A length or distance value from its prefix symbol."""
    if symbol < 4:
        return symbol + 1
    extra = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << extra) + bits.read(extra) + 1


def _distance(code: int, width: int) -> int:
    if code > len(DISTANCE_MAP):
        return code - len(DISTANCE_MAP)
    x, y = DISTANCE_MAP[code - 1]
    return max(1, x + y * width)


def _copy(out: np.ndarray, at: int, distance: int, length: int) -> None:
    if distance >= length:
        out[at : at + length] = out[at - distance : at - distance + length]
    else:
        out[at : at + length] = np.resize(out[at - distance : at], length)


SEGMENT, MARGIN = 1 << 16, 128  # bytes looked up at once, and beyond: eight pixels' codes fit in


def _one_group(bits: Bits, width: int, n: int, codes: list[PrefixCode]) -> np.ndarray:
    """ARGB of n pixels coded by one group without a cache."""
    out, done = np.zeros(n, np.uint32), 0
    while done < n:
        done = _one_segment(bits, width, out, done, codes)
    return out


def _one_segment(bits: Bits, width: int, out: np.ndarray, done: int, codes: list[PrefixCode]) -> int:
    """Decodes pixels from done on while their codes begin within a segment; returns where it stopped."""
    green, *others, distances = codes
    start, n = done, len(out)
    data = np.frombuffer(bits.data, np.uint8)[bits.at >> 3 :]
    limit = SEGMENT * 8 if len(data) > SEGMENT + MARGIN else len(data) * 8
    data = data[: SEGMENT + MARGIN].astype(np.uint32)
    words = data[:-3] | data[1:-2] << 8 | data[2:-1] << 16 | data[3:] << 24
    base = bits.at & ~7
    windows = (words[:, None] >> np.arange(8, dtype=np.uint32)).reshape(-1)
    last = len(windows) - 1
    at_green = windows & np.uint32((1 << green.bits) - 1)
    here = np.arange(len(windows), dtype=np.int32)
    literal_code = green.symbols < 256
    literal = literal_code.take(at_green)
    # what isn't a literal stays where it is
    follow = here + np.where(literal_code, green.lengths, 0).astype(np.int32).take(at_green)
    np.minimum(follow, last, out=follow)
    starts = []  # where each pixel's red, blue and alpha code begins
    for code in others:
        starts.append(follow if code.bits else None)
        if code.bits:
            follow = np.minimum(follow + code.lengths[windows[follow] & ((1 << code.bits) - 1)], last).astype(np.int32)
    # where the next 1, 2, 4 and 8 literals lead; what isn't a literal leads to itself
    chain = np.where(literal, follow, here) if any(code.bits for code in others) else follow
    literal[limit:] = False
    two = chain.take(chain)
    four = two.take(two)
    eight = memoryview(four.take(four))
    whole = memoryview(literal.take(eight))  # eight literals begin here, and another one follows
    single, is_literal = memoryview(chain), memoryview(literal)
    octets, octets_at, singles, singles_at = [], [], [], []  # bit positions of literal pixels, and which pixels
    copies, at = [], bits.at - base
    while done < n and at < limit:
        while done + 8 <= n and whole[at]:
            octets.append(at)
            octets_at.append(done)
            at = eight[at]
            done += 8
        while done < n and is_literal[at]:
            singles.append(at)
            singles_at.append(done)
            at = single[at]
            done += 1
        if done >= n or at >= limit:
            break
        bits.at = base + at + int(green.lengths[at_green[at]])
        length = _prefixed(int(green.symbols[at_green[at]]) - 256, bits)
        distance = _distance(_prefixed(distances.read(bits), bits), width)
        length = min(length, n - done)
        copies.append((done, distance, length))
        done += length
        at = bits.at - base
    bits.at = base + at
    places = np.full(done - start, -1, np.int64)  # of each pixel; -1 where copied
    places[np.array(singles_at, np.int64) - start] = singles
    first, to = np.array(octets, np.int64), np.array(octets_at, np.int64) - start
    for k in range(8):
        places[to + k] = first
        first = chain[first]
    known = places >= 0
    pos = places[known]
    argb = green.symbols[at_green[pos]].astype(np.uint32) << 8
    for code, begin, shift in zip(others, starts, (16, 0, 24)):
        s = code.symbols[windows[begin[pos]] & ((1 << code.bits) - 1)].astype(np.uint32) if begin is not None else np.uint32(code.symbols[0])
        argb |= s << np.uint32(shift)
    out[start:done][known] = argb
    for begin, distance, length in copies:
        _copy(out, begin, distance, length)
    return done


def _plain(bits: Bits, width: int, n: int, groups: list[list[PrefixCode]], meta: np.ndarray | None, meta_bits: int, cache_bits: int) -> np.ndarray:
    """ARGB of n pixels by the plain loop."""
    out = np.zeros(n, np.uint32)
    cache = np.zeros(1 << cache_bits, np.uint32) if cache_bits else None
    kept = at = 0  # pixels in the cache so far, pixels so far
    while at < n:
        x, y = at % width, at // width
        green, red, blue, alpha, distances = groups[int(meta[y >> meta_bits, x >> meta_bits])] if meta is not None else groups[0]
        s = green.read(bits)
        if s < 256:
            r = red.read(bits)
            b = blue.read(bits)
            out[at] = alpha.read(bits) << 24 | r << 16 | s << 8 | b
            at += 1
        elif s < 256 + LENGTH_CODES:
            length = _prefixed(s - 256, bits)
            distance = _distance(_prefixed(distances.read(bits), bits), width)
            _copy(out, at, distance, min(length, n - at))
            at += length
        else:
            if cache is not None:
                for v in out[kept:at].tolist():
                    cache[(CACHE_FACTOR * v & 0xFFFFFFFF) >> (32 - cache_bits)] = v
                kept = at
            out[at] = cache[s - 256 - LENGTH_CODES]
            at += 1
    return out


def read_image(bits: Bits, width: int, height: int, top: bool = False) -> np.ndarray:
    """height x width ARGB of an entropy-coded image; only the main image (top) may have meta groups."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    meta, meta_bits, n_groups = None, 0, 1
    if top and bits.read(1):
        meta_bits = bits.read(3) + 2
        meta = read_image(bits, (width + (1 << meta_bits) - 1) >> meta_bits, (height + (1 << meta_bits) - 1) >> meta_bits) >> 8 & 0xFFFF
        n_groups = int(meta.max()) + 1
    alphabets = (256 + LENGTH_CODES + ((1 << cache_bits) if cache_bits else 0), 256, 256, 256, DISTANCE_CODES)
    groups = [[read_prefix_code(bits, a) for a in alphabets] for _ in range(n_groups)]
    n = width * height
    if meta is None and not cache_bits:
        return _one_group(bits, width, n, groups[0]).reshape(height, width)
    return _plain(bits, width, n, groups, meta, meta_bits, cache_bits).reshape(height, width)


def _spread(blocks: np.ndarray, size_bits: int, height: int, width: int) -> np.ndarray:
    return blocks.repeat(1 << size_bits, 0)[:height].repeat(1 << size_bits, 1)[:, :width]


def _channels(argb: np.ndarray) -> np.ndarray:
    return argb.astype("<u4").reshape(*argb.shape, 1).view(np.uint8)  # blue, green, red, alpha


def _predict(mode: int, left: list[int], top: list[int], top_right: list[int], top_left: list[int]) -> list[int]:
    """The prediction of a pixel's four channels."""
    average = lambda a, b: [(x + y) // 2 for x, y in zip(a, b)]
    clamp = lambda v: min(255, max(0, v))
    match mode:
        case 0:
            return [0, 0, 0, 255]
        case 1:
            return left
        case 2:
            return top
        case 3:
            return top_right
        case 4:
            return top_left
        case 5:
            return average(average(left, top_right), top)
        case 6:
            return average(left, top_left)
        case 7:
            return average(left, top)
        case 8:
            return average(top_left, top)
        case 9:
            return average(top, top_right)
        case 10:
            return average(average(left, top_left), average(top, top_right))
        case 11:
            to_left = sum(abs(t - tl) for t, tl in zip(top, top_left))
            to_top = sum(abs(x - tl) for x, tl in zip(left, top_left))
            return left if to_left < to_top else top
        case 12:
            return [clamp(x + t - tl) for x, t, tl in zip(left, top, top_left)]
        case 13:
            return [clamp(a + int((a - tl) / 2)) for a, tl in zip(average(left, top), top_left)]
    return [0, 0, 0, 255]


def invert_predictor(argb: np.ndarray, modes: np.ndarray) -> np.ndarray:
    """modes holds each pixel's mode; the first pixel is predicted black, the first row from the left, the first column from above."""
    height, width = argb.shape
    inner = modes[1:, 1:]
    if not inner.size or (inner == inner.flat[0]).all() and inner.flat[0] in (LEFT, ABOVE):  # sums along rows and columns
        out = _channels(argb).copy()
        out[0, 0, 3] = int(out[0, 0, 3]) + 255 & 255  # black is opaque
        out[0] = np.cumsum(out[0], axis=0, dtype=np.uint8)
        if inner.size and inner.flat[0] == ABOVE:
            out = np.cumsum(out, axis=0, dtype=np.uint8)
        else:
            out[:, 0] = np.cumsum(out[:, 0], axis=0, dtype=np.uint8)
            out[1:] = np.cumsum(out[1:], axis=1, dtype=np.uint8)
        return np.ascontiguousarray(out).view("<u4")[..., 0].astype(np.uint32)
    rest = _channels(argb).tolist()
    for y in range(height):
        row, above = rest[y], rest[y - 1] if y else None
        for x in range(width):
            if not y:
                guess = row[x - 1] if x else [0, 0, 0, 255]
            elif not x:
                guess = above[0]
            else:
                right = above[x + 1] if x + 1 < width else row[0]
                guess = _predict(int(modes[y, x]), row[x - 1], above[x], right, above[x - 1])
            row[x] = [(a + b) & 255 for a, b in zip(row[x], guess)]
    return np.array(rest, np.uint8).view("<u4").reshape(height, width).astype(np.uint32)


def invert_cross_colour(argb: np.ndarray, elements: np.ndarray) -> np.ndarray:
    out = _channels(argb).copy()
    e = _channels(np.ascontiguousarray(elements)).view(np.int8).astype(np.int32)
    green = out[..., 1].view(np.int8).astype(np.int32)
    red = (out[..., 2] + (e[..., 0] * green >> 5)).astype(np.uint8)
    blue = out[..., 0] + (e[..., 1] * green >> 5) + (e[..., 2] * red.view(np.int8).astype(np.int32) >> 5)
    out[..., 2], out[..., 0] = red, blue.astype(np.uint8)
    return out.view("<u4")[..., 0].astype(np.uint32)


def add_green(argb: np.ndarray) -> np.ndarray:
    out = _channels(argb).copy()
    out[..., 0] += out[..., 1]
    out[..., 2] += out[..., 1]
    return out.view("<u4")[..., 0].astype(np.uint32)


def invert_palette(argb: np.ndarray, palette: np.ndarray, pack_bits: int, width: int) -> np.ndarray:
    index = (argb >> 8 & 255).astype(np.uint8)
    if pack_bits:
        per = 1 << pack_bits
        bits = 8 // per
        index = (index[:, :, None] >> (np.arange(per, dtype=np.uint8) * bits) & ((1 << bits) - 1)).reshape(len(index), -1)[:, :width]
    table = np.zeros(256, np.uint32)
    table[: len(palette)] = palette
    return table[index]


def decode(data: bytes) -> np.ndarray:
    """height x width ARGB of a lossless WebP file."""
    if data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L":
        raise ValueError("not a lossless WebP file")
    (size,) = struct.unpack("<I", data[16:20])
    bits = Bits(data[20 : 20 + size])
    if bits.read(8) != 0x2F:
        raise ValueError("no VP8L signature")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("unknown version")
    undo, coded = [], width
    while bits.read(1):
        kind = bits.read(2)
        if kind in (PREDICTOR, CROSS_COLOUR):
            size_bits = bits.read(3) + 2
            blocks = read_image(bits, (coded + (1 << size_bits) - 1) >> size_bits, (height + (1 << size_bits) - 1) >> size_bits)
            undo.append((kind, _spread(blocks, size_bits, height, coded), 0, coded))
        elif kind == PALETTE:
            n = bits.read(8) + 1
            deltas = _channels(read_image(bits, n, 1))[0]
            palette = np.cumsum(deltas, axis=0, dtype=np.uint8).view("<u4")[:, 0].astype(np.uint32)
            pack = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            undo.append((kind, palette, pack, coded))
            coded = (coded + (1 << pack) - 1) >> pack
        else:
            undo.append((kind, None, 0, coded))
    argb = read_image(bits, coded, height, top=True)
    for kind, values, pack, wide in reversed(undo):
        if kind == PREDICTOR:
            argb = invert_predictor(argb, values >> 8 & 15)
        elif kind == CROSS_COLOUR:
            argb = invert_cross_colour(argb, values)
        elif kind == SUBTRACT_GREEN:
            argb = add_green(argb)
        else:
            argb = invert_palette(argb, values, pack, wide)
    return argb


# ---- encoder of grey samples


class Writer:
    """Collects (value, bits) and packs them from the lowest bit of each byte up."""

    def __init__(self) -> None:
        self.values: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []
        self.few: list[tuple[int, int]] = []

    def put(self, value: int, n: int) -> None:
        self.few.append((value, n))

    def put_all(self, values: np.ndarray, sizes: np.ndarray) -> None:
        self._flush()
        self.values.append(values.astype(np.uint32))
        self.sizes.append(sizes.astype(np.int64))

    def _flush(self) -> None:
        if self.few:
            v, n = zip(*self.few)
            self.few = []
            self.put_all(np.array(v), np.array(n))

    def pack(self) -> bytes:
        self._flush()
        values, sizes = np.concatenate(self.values), np.concatenate(self.sizes)
        pieces = []
        for at in range(0, len(values), 1 << 16):
            v, n = values[at : at + (1 << 16)], sizes[at : at + (1 << 16)]
            ends = np.cumsum(n)
            within = np.arange(ends[-1]) - np.repeat(ends - n, n)
            pieces.append((np.repeat(v, n) >> within.astype(np.uint32) & 1).astype(np.uint8))
        return np.packbits(np.concatenate(pieces), bitorder="little").tobytes()


def code_lengths(counts: dict[int, int], longest: int) -> dict[int, int]:
    """Huffman code lengths of at most `longest` bits; counts are flattened until they fit."""
    if len(counts) == 1:
        return dict.fromkeys(counts, 1)
    while True:
        heap = [(c, s, None) for s, c in counts.items()]
        heapq.heapify(heap)
        n = len(heap) + max(counts) + 1
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            n += 1
            heapq.heappush(heap, (a[0] + b[0], n, (a, b)))
        out: dict[int, int] = {}
        stack = [(heap[0], 0)]
        while stack:
            (_, s, parts), depth = stack.pop()
            if parts is None:
                out[s] = depth
            else:
                stack += [(parts[0], depth + 1), (parts[1], depth + 1)]
        if max(out.values()) <= longest:
            return out
        counts = {s: (c + 1) // 2 for s, c in counts.items()}


def write_code(w: Writer, counts: dict[int, int], alphabet: int) -> dict[int, tuple[int, int]]:
    """Writes the prefix code for symbols' counts; returns symbol: (code, length)."""
    if len(counts) <= 1 and max(counts, default=0) < 256:
        s = max(counts, default=0)
        w.put(1, 1), w.put(0, 1), w.put(int(s > 1), 1), w.put(s, 8 if s > 1 else 1)
        return {s: (0, 0)}
    if len(counts) == 1:  # a symbol too large for a simple code shares a code with one that isn't used
        counts = counts | {0: 1}
    lengths = code_lengths(counts, 15)
    tokens: list[tuple[int, int, int]] = []  # symbol, extra value, extra bits
    at = 0
    for s in sorted(lengths):
        gap = s - at
        while gap:
            if gap < 3:
                tokens.append((0, 0, 0))
                gap -= 1
            elif gap < 11:
                tokens.append((17, gap - 3, 3))
                gap = 0
            else:
                k = min(gap, 138)
                tokens.append((18, k - 11, 7))
                gap -= k
        tokens.append((lengths[s], 0, 0))
        at = s + 1
    used = Counter(t[0] for t in tokens)
    if len(used) == 1:
        used[0 if 0 not in used else 1] = 1
    sizes = code_lengths(used, 7)
    codes = canonical(sizes)
    given = max(4, max(i for i, s in enumerate(CODE_LENGTH_ORDER) if s in sizes) + 1)
    w.put(0, 1)
    w.put(given - 4, 4)
    for s in CODE_LENGTH_ORDER[:given]:
        w.put(sizes.get(s, 0), 3)
    # the count of tokens, so that zeros at the end needn't be written
    bits = max(2, (max(0, len(tokens) - 2)).bit_length() + 1 & ~1)
    w.put(1, 1)
    w.put((bits - 2) // 2, 3)
    if len(tokens) < 2:
        tokens.append((0, 0, 0)) if 0 in codes else None
    w.put(len(tokens) - 2, bits)
    for s, value, extra in tokens:
        code, n = codes[s]
        w.put(code | value << n, n + extra)
    return canonical(lengths)


SHORTEST_COPY = 16
LONGEST_COPY = 4096
SEED_BYTES = 8  # that a copy must begin with
FARTHEST = (1 << 20) - len(DISTANCE_MAP)


def _tokens(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, copy lengths, distances); length 0 marks a literal.

    Where SEED_BYTES samples stood before, the nearest such place is their source; places in a row with one distance are a copy.
    """
    n = len(samples)
    symbols, none = samples.astype(np.int64), np.zeros(n, np.int64)
    if n < 2 * SEED_BYTES:
        return symbols, none, none
    seeds = np.zeros(n - SEED_BYTES + 1, np.uint64)
    for k in range(SEED_BYTES):
        seeds |= samples[k : n - SEED_BYTES + 1 + k].astype(np.uint64) << np.uint64(8 * k)
    order = np.argsort(seeds, kind="stable")
    same = np.flatnonzero(seeds[order[1:]] == seeds[order[:-1]])
    distance = np.zeros(len(seeds), np.int64)
    distance[order[same + 1]] = order[same + 1] - order[same]
    distance[distance > FARTHEST] = 0
    starts = np.concatenate(([0], np.flatnonzero(distance[1:] != distance[:-1]) + 1))
    sizes = np.diff(np.append(starts, len(distance)))
    long = np.flatnonzero((distance[starts] > 0) & (sizes + SEED_BYTES - 1 >= SHORTEST_COPY))
    if not len(long):
        return symbols, none, none
    keep, lengths, distances = np.ones(n, bool), none.copy(), none.copy()
    done = 0
    for a, size in zip(starts[long].tolist(), sizes[long].tolist()):
        end, at = a + size + SEED_BYTES - 1, max(a, done)
        if end - at < SHORTEST_COPY:
            continue
        keep[at:end] = False
        d = distance[a]
        while at < end:
            k = min(end - at, LONGEST_COPY)
            keep[at], lengths[at], distances[at] = True, k, d
            at += k
        done = end
    return symbols[keep], lengths[keep], distances[keep]


def _prefix_of(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbol, extra value, extra bits) of lengths from 1."""
    v = values - 1
    top = np.zeros(len(v), np.int64)
    big = v >= 4
    top[big] = np.floor(np.log2(v[big])).astype(np.int64)
    extra = np.where(big, top - 1, 0)
    symbol = np.where(big, 2 * top + (v >> extra & 1), v)
    return symbol, np.where(big, v & ((1 << extra) - 1), 0), extra


@functools.cache
def _distance_codes(width: int) -> dict[int, int]:
    """distance: code, for the distances in the two-dimensional map."""
    near: dict[int, int] = {}
    for code, (x, y) in enumerate(DISTANCE_MAP, 1):
        near.setdefault(max(1, x + y * width), code)
    return near


def _write_symbols(w: Writer, symbols: np.ndarray, alphabet: int) -> tuple[np.ndarray, np.ndarray]:
    """Writes the prefix code of symbols; returns each one's code and length."""
    counts = np.bincount(symbols) if len(symbols) else np.zeros(1, np.int64)
    used = np.flatnonzero(counts)
    code, size = np.zeros(len(counts), np.int64), np.zeros(len(counts), np.int64)
    for s, (c, n) in write_code(w, dict(zip(used.tolist(), counts[used].tolist())), alphabet).items():
        if s < len(counts):
            code[s], size[s] = c, n
    return code[symbols], size[symbols]


def _write_samples(w: Writer, samples: np.ndarray, width: int, alpha: int) -> None:
    """An image stream whose green channel holds the samples; red and blue are zero."""
    symbols, lengths, distances = _tokens(samples)
    copied = lengths > 0
    if not copied.any():
        code, size = _write_symbols(w, symbols, 256 + LENGTH_CODES)
        for value, alphabet in ((0, 256), (0, 256), (alpha, 256), (0, DISTANCE_CODES)):
            write_code(w, {value: 1}, alphabet)
        w.put_all(code, size)
        return
    symbol, extra, extra_bits = _prefix_of(lengths[copied])
    symbols[copied] = 256 + symbol
    kinds, which = np.unique(distances[copied], return_inverse=True)
    near = _distance_codes(width)
    coded = np.array([near.get(d, d + len(DISTANCE_MAP)) for d in kinds.tolist()], np.int64)
    far, far_extra, far_bits = _prefix_of(coded[which])
    code, size = _write_symbols(w, symbols, 256 + LENGTH_CODES)
    for value in (0, 0, alpha):
        write_code(w, {value: 1}, 256)
    far_code, far_size = _write_symbols(w, far, DISTANCE_CODES)
    code[copied] |= extra << size[copied]
    size[copied] += extra_bits
    # after each copied symbol its distance's code and extra bits
    at = np.flatnonzero(copied) + 1
    both = np.repeat(at, 2)
    w.put_all(np.insert(code, both, np.stack((far_code, far_extra), 1).reshape(-1)), np.insert(size, both, np.stack((far_size, far_bits), 1).reshape(-1)))


def _constant_image(w: Writer, green: int) -> None:
    """An image stream of one colour."""
    w.put(0, 1)
    for value, alphabet in ((green, 256 + LENGTH_CODES), (0, 256), (0, 256), (0, 256), (0, DISTANCE_CODES)):
        write_code(w, {value: 1}, alphabet)


def residuals(samples: np.ndarray, mode: int) -> np.ndarray:
    """Samples less what the predictor's mode foresees."""
    out = samples.copy()
    out[0, 1:] -= samples[0, :-1]
    if mode == ABOVE:
        out[1:] -= samples[:-1]
    else:
        out[1:, 0] -= samples[:-1, 0]
        out[1:, 1:] -= samples[1:, :-1]
    return out


def entropy(samples: np.ndarray) -> float:
    counts = np.bincount(samples.reshape(-1), minlength=256)
    p = counts[counts > 0] / samples.size
    return float(-(p * np.log2(p)).sum())


def encode_grey(samples: np.ndarray) -> bytes:
    """A lossless WebP file of height x width 8-bit grey samples, alpha opaque.

    Up to 16 different samples become a palette, whose indices share bytes; others are green with
    red and blue subtracted, and predicted from the left or from above where that lowers their entropy.
    """
    height, width = samples.shape
    w = Writer()
    w.put(0x2F, 8), w.put(width - 1, 14), w.put(height - 1, 14), w.put(0, 1), w.put(0, 3)
    values = np.flatnonzero(np.bincount(samples.reshape(-1), minlength=256)).astype(np.uint8)
    w.put(1, 1)
    if len(values) <= 16:
        w.put(PALETTE, 2), w.put(len(values) - 1, 8)
        # the palette, as differences, is an image of its own: grey, and opaque in its first entry only
        steps = np.diff(values, prepend=np.uint8(0)).astype(np.int64)
        w.put(0, 1)
        alphas = np.array([255] + [0] * (len(steps) - 1))
        by_channel = [write_code(w, dict(Counter(c.tolist())), a) for c, a in ((steps, 256 + LENGTH_CODES), (steps, 256), (steps, 256), (alphas, 256))]
        write_code(w, {}, DISTANCE_CODES)
        for s, a in zip(steps.tolist(), alphas.tolist()):
            for codes, v in zip(by_channel, (s, s, s, a)):
                w.put(*codes[v])
        pack = 3 if len(values) <= 2 else 2 if len(values) <= 4 else 1
        per, bits = 1 << pack, 8 >> pack
        index = np.searchsorted(values, samples).astype(np.uint8)
        index = np.pad(index, ((0, 0), (0, -width % per))).reshape(height, -1, per)
        plane = (index << (np.arange(per, dtype=np.uint8) * bits)).sum(2, dtype=np.int64).astype(np.uint8)
        alpha = 255
    else:
        w.put(SUBTRACT_GREEN, 2)
        planes = {0: samples} | {mode: residuals(samples, mode) for mode in (LEFT, ABOVE)}
        mode = min(planes, key=lambda m: entropy(planes[m]))
        plane, alpha = planes[mode], 255
        if mode:
            w.put(1, 1), w.put(PREDICTOR, 2), w.put(7, 3)  # blocks of 512 x 512
            _constant_image(w, mode)
            alpha = 0
    w.put(0, 1), w.put(0, 1), w.put(0, 1)  # no more transforms, no cache, no meta groups
    _write_samples(w, plane.reshape(-1), plane.shape[1], alpha)
    body = w.pack()
    odd = bytes(len(body) & 1)
    return b"RIFF" + struct.pack("<I", 12 + len(body) + len(odd)) + b"WEBPVP8L" + struct.pack("<I", len(body)) + body + odd
