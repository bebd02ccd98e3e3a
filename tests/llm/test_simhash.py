import random

import numpy as np
import xxhash

from strandloom.llm import simhash


def slow_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def brute(rows):
    """(fingerprint, component) of each (doc_id, text)."""
    prints = [slow_print(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 4:
                up[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted((str(d), f"{prints[i]:016x}", str(least.get(find(i)))) for i, (d, _) in enumerate(rows))


def texts():
    rnd = random.Random(5)
    base = [" ".join(rnd.choice("abcdefghij") * rnd.randint(1, 4) for _ in range(rnd.randint(0, 120))) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(base)]
    for i in range(40, 120):
        words = rnd.choice(base).split(" ")
        words[rnd.randrange(len(words))] = rnd.choice("xyz")
        rows.append((i, "\t".join(words).upper()))
    return [*rows, (500, None), (501, ""), (502, " \n"), (None, base[3]), (3, base[3]), (7, "é A b"), (7, "É a b"), (600, "w " * 40_000)]


def test_groups_match_brute_force(spark):
    rows = texts()
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, fp int")
    got = simhash.near_duplicates(docs).collect()
    assert sorted((str(r[0]), r[1], str(r[2])) for r in got) == brute(rows)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).collect() == []


def components(pairs, fps):
    up = {f: f for f in fps}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        up[find(a)] = find(b)
    groups = {}
    for f in fps:
        groups.setdefault(find(f), set()).add(f)
    return sorted(sorted(g) for g in groups.values())


def test_large_shards_lose_no_link(spark):
    """Dense groups with a tiny bound, so that shards are dealt anew and end in grids."""
    rnd = random.Random(7)
    fps = set()
    for _ in range(3):
        centre = rnd.getrandbits(64)
        for _ in range(150):
            f = centre
            for _ in range(rnd.randint(0, 5)):
                f ^= 1 << rnd.randrange(64)
            fps.add(f)
    fps = [int(np.uint64(f).view(np.int64)) for f in fps]
    got = [tuple(r) for r in simhash.near_links(spark.createDataFrame([(f,) for f in fps], "fp long"), most=40).collect()]
    as_bits = lambda f: f & (2**64 - 1)
    pairs = [(a, b) for i, a in enumerate(fps) for b in fps[:i] if bin(as_bits(a) ^ as_bits(b)).count("1") <= 4]
    assert components(got, fps) == components(pairs, fps)
