import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.llm import media, webp


def texts():
    rnd = random.Random(8)
    yield from (None, b"", b"a", b"ab" * 5000, b"x" * 5000, bytes(range(256)) * 20, bytes(range(16)) * 100, bytes(range(17)) * 100)
    for n in (575, 576, 577, 20_000):
        yield bytes(rnd.randrange(256) for _ in range(n))
        yield " ".join(rnd.choice(["lorem", "ipsum", "dolor", "été"]) for _ in range(n // 4)).encode()
    yield b"row " * 200_000
    yield bytes(rnd.randrange(97, 123) for _ in range(300_000))  # several segments of the decoder
    yield bytes((i * i // 700) % 200 for i in range(40_000))  # smooth: predicted from the left
    yield b"".join(bytes(rnd.randrange(256) for _ in range(576)) * 9 for _ in range(4))  # rows repeat: predicted from above


def test_payloads_come_back_whole():
    for t in texts():
        stored = media.encode_payload(media.padded(t))
        samples = (media.decode_pixels(stored) & 255).astype(np.uint8).tobytes()
        assert samples == media.padded(t) and samples[: len(t or b"")] == (t or b"")
        assert stored[:4] == b"RIFF" and stored[8:16] == b"WEBPVP8L"


def test_the_encoder_chooses():
    kinds = lambda t: (f := media.encode_payload(media.padded(t)), len(f))[1]
    assert kinds(b"row " * 200_000) < 2000
    rnd = random.Random(1)
    phrase = bytes(rnd.randrange(40, 120) for _ in range(300))
    far = phrase + bytes(rnd.randrange(40, 120) for _ in range(5000)) + phrase
    assert kinds(far) < kinds(far[:-300] + bytes(rnd.randrange(40, 120) for _ in range(300))) - 150  # a back-reference
    image = np.frombuffer(media.padded(bytes((i * i // 700) % 200 for i in range(40_000))), np.uint8).reshape(-1, 576)
    assert webp.entropy(webp.residuals(image, webp.LEFT)) < webp.entropy(image)


def test_payloads_beyond_one_image(monkeypatch):
    monkeypatch.setattr(media, "ROWS", 3)
    payload = media.padded(bytes(range(250)) * 20)
    stored = media.encode_payload(payload)
    assert len(media.split_files(stored)) == -(-len(payload) // (3 * 576))
    assert media.pixel_array(media.decode_pixels(stored)).tobytes() == payload


def coded(w, values, alphabet):
    return webp.write_code(w, dict(zip(*(x.tolist() for x in np.unique(np.array(values), return_counts=True)))), alphabet)


def test_colour_cache():
    """Literals, copies that fill the cache too, and cache symbols, against a cache kept by definition."""
    rnd, cache_bits = random.Random(4), 5
    colours = [rnd.randrange(1 << 32) for _ in range(60)]
    slot = lambda v: (0x1E35A7BD * v & 0xFFFFFFFF) >> (32 - cache_bits)
    pixels, tokens, cache = [], [], {}
    while len(pixels) < 400:
        v = rnd.choice(colours)
        if cache.get(slot(v)) == v:
            tokens.append(("cache", slot(v)))
            new = [v]
        elif len(pixels) > 10 and rnd.random() < 0.2:
            d, k = rnd.randint(1, 9), 4
            new = []
            for _ in range(k):
                new.append((pixels + new)[-d])
            tokens.append(("copy", k, d))
        else:
            tokens.append(("pixel", v))
            new = [v]
        for x in new:
            cache[slot(x)] = x
        pixels += new
    w = webp.Writer()
    w.put(1, 1), w.put(cache_bits, 4)
    green = [280 + t[1] if t[0] == "cache" else 256 + 3 if t[0] == "copy" else t[1] >> 8 & 255 for t in tokens]
    literal = [t[1] for t in tokens if t[0] == "pixel"]
    # a distance beyond the map is coded as itself and 120 more
    far = [webp._prefix_of(np.array([t[2] + 120])) for t in tokens if t[0] == "copy"]
    codes = [coded(w, green, 280 + (1 << cache_bits))] + [coded(w, [v >> s & 255 for v in literal], 256) for s in (16, 0, 24)] + [coded(w, [int(f[0][0]) for f in far], 40)]
    at = 0
    for t, g in zip(tokens, green):
        w.put(*codes[0][g])
        if t[0] == "pixel":
            for code, s in zip(codes[1:4], (16, 0, 24)):
                w.put(*code[t[1] >> s & 255])
        elif t[0] == "copy":
            f = far[at]
            w.put(*codes[4][int(f[0][0])]), w.put(int(f[1][0]), int(f[2][0]))
            at += 1
    n = len(pixels)
    assert webp.read_image(webp.Bits(w.pack()), n, 1)[0].tolist() == pixels


def test_meta_groups():
    """Blocks of 4 x 4 pixels with codes of their own."""
    rnd = np.random.default_rng(6)
    group = rnd.integers(0, 3, (3, 5))
    image = rnd.integers(0, 1 << 32, (10, 18), np.uint64).astype(np.uint32)
    of = group.repeat(4, 0)[:10].repeat(4, 1)[:, :18]
    w = webp.Writer()
    w.put(0, 1), w.put(1, 1), w.put(0, 3), w.put(0, 1)
    codes = [coded(w, group.reshape(-1).tolist(), 280)] + [coded(w, [0], 256) for _ in range(3)] + [coded(w, [0], 40)]
    for g in group.reshape(-1).tolist():
        w.put(*codes[0][g])
    per = {}
    for g in range(int(group.max()) + 1):
        mine = image[of == g].tolist() or [0]
        per[g] = [coded(w, [v >> s & 255 for v in mine], a) for s, a in ((8, 280), (16, 256), (0, 256), (24, 256))] + [coded(w, [0], 40)]
    for g, v in zip(of.reshape(-1).tolist(), image.reshape(-1).tolist()):
        for code, s in zip(per[g], (8, 16, 0, 24)):
            w.put(*code[v >> s & 255])
    assert (webp.read_image(webp.Bits(w.pack()), 18, 10, top=True) == image).all()


def test_cross_colour_is_undone():
    rnd = np.random.default_rng(9)
    argb = rnd.integers(0, 1 << 32, (6, 7), np.uint64).astype(np.uint32)
    elements = rnd.integers(0, 1 << 32, (6, 7), np.uint64).astype(np.uint32)
    signed = lambda v: v - 256 if v > 127 else v
    coded = np.zeros_like(argb)
    for y in range(6):
        for x in range(7):
            v, e = int(argb[y, x]), int(elements[y, x])
            red, green, blue = v >> 16 & 255, v >> 8 & 255, v & 255
            to_red, to_blue, red_to_blue = signed(e & 255), signed(e >> 8 & 255), signed(e >> 16 & 255)
            new_red = (red - (to_red * signed(green) >> 5)) & 255
            new_blue = (blue - (to_blue * signed(green) >> 5) - (red_to_blue * signed(red) >> 5)) & 255
            coded[y, x] = v & 0xFF00FF00 | new_red << 16 | new_blue
    assert (webp.invert_cross_colour(coded, elements) == argb).all()


@pytest.mark.parametrize("mode", [1, 2])
@pytest.mark.parametrize("shape", [(1, 1), (1, 9), (9, 1), (6, 8)])
def test_sums_undo_residuals(mode, shape):
    image = np.random.default_rng(mode).integers(0, 256, shape).astype(np.uint8)
    rest = webp.residuals(image, mode).astype(np.uint32) << 8
    got = webp.invert_predictor(rest, np.full(shape, mode))
    assert ((got >> 8 & 255) == image).all() and (got >> 24 == 255).all()


def test_pixel_arrays_of_colour():
    argb = np.array([[0xFF010203, 0x80FFFFFF]], np.uint32)
    assert media.pixel_array(argb).tolist() == [[[1, 2, 3, 255], [255, 255, 255, 128]]]
    assert media.pixel_array(np.array([[0xFF070707]], np.uint32)).tolist() == [[[7]]]


def test_all_channels_coded_by_a_plain_stream():
    """Four channels with codes of their own, without and with back-references: the fast loop against the plain one."""
    rnd = np.random.default_rng(3)
    for kinds in (2, 40):
        values = [rnd.integers(0, kinds, 300) for _ in range(4)]
        w = webp.Writer()
        w.put(0, 1)  # no cache
        codes = [webp.write_code(w, dict(zip(*(x.tolist() for x in np.unique(v, return_counts=True)))), 256 + (webp.LENGTH_CODES if k == 0 else 0)) for k, v in enumerate(values)]
        webp.write_code(w, {}, webp.DISTANCE_CODES)
        for row in zip(*(v.tolist() for v in values)):
            for code, v in zip(codes, row):
                w.put(*code[v])
        data = w.pack()
        got = webp.read_image(webp.Bits(data), 30, 10)
        green, red, blue, alpha = (v.astype(np.uint32) for v in values)
        assert (got.reshape(-1) == (alpha << 24 | red << 16 | green << 8 | blue)).all()
        bits = webp.Bits(data)
        bits.read(1)
        groups = [[webp.read_prefix_code(bits, a) for a in (256 + webp.LENGTH_CODES, 256, 256, 256, webp.DISTANCE_CODES)]]
        assert (webp._plain(bits, 30, 300, groups, None, 0, 0) == got.reshape(-1)).all()


@pytest.mark.parametrize("mode", range(14))
def test_predictors_are_undone(mode):
    rnd = np.random.default_rng(mode)
    h, w = 5, 7
    image = rnd.integers(0, 256, (h, w, 4))  # in the order of _channels

    def average(a, b):
        return (a + b) // 2

    def clamp(v):
        return np.clip(v, 0, 255)

    def predicted(y, x):
        if y == 0 and x == 0:
            return np.array([255 if c == black_alpha else 0 for c in range(4)])
        if y == 0:
            return image[0, x - 1]
        if x == 0:
            return image[y - 1, 0]
        left, top, corner = image[y, x - 1], image[y - 1, x], image[y - 1, x - 1]
        right = image[y - 1, x + 1] if x + 1 < w else image[y, 0]
        distance = abs(top - corner).sum(), abs(left - corner).sum()
        return [
            np.array([255 if c == black_alpha else 0 for c in range(4)]), left, top, right, corner,
            average(average(left, right), top), average(left, corner), average(left, top), average(corner, top), average(top, right),
            average(average(left, corner), average(top, right)), left if distance[0] < distance[1] else top,
            clamp(left + top - corner), clamp(average(left, top) + np.trunc((average(left, top) - corner) / 2).astype(int)),
        ][mode]

    shifts = (24, 16, 8, 0)
    black_alpha = 0
    rest = np.array([[(image[y, x] - predicted(y, x)) & 255 for x in range(w)] for y in range(h)], np.uint32)
    pack = lambda a: sum(a[..., c].astype(np.uint32) << np.uint32(s) for c, s in enumerate(shifts)).astype(np.uint32)
    got = webp.invert_predictor(pack(rest), np.full((h, w), mode))
    assert (got == pack(image)).all()


def test_table(spark):
    rows = [(i, None if t is None else t.decode("latin-1"), "x") for i, t in enumerate(texts())] + [(None, "a", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, media string").withColumn("image", F.lit(1))
    stored = media.store(df)
    facts = media.read_back(stored).select("doc_id", "n_bytes", F.col("facts").alias("f")).collect()
    assert len(facts) == len(rows)
    known = {i: (t or "").encode() for i, t, _ in rows}
    for r in facts:
        payload = media.padded(known[r["doc_id"]])
        assert (r["n_bytes"], r["f"]["payload_bytes"]) == (len(known[r["doc_id"]]), len(payload))
        assert r["f"]["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["f"]["tail_crc32"] == zlib.crc32(payload[-32:])
    assert media.store(df.limit(0)).count() == 0
