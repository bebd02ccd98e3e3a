import hashlib
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from strandloom.llm import queries, runs

SPACE = " \t\n\x0b\x0c\r"


def words_of(text):
    return "".join(" " if c in SPACE else c for c in text or "").split(" ") if text else []


def split(text):
    return [w for w in words_of(text) if w]


def brute(x):
    """Every run, by comparing the words at every lag."""
    n, found = len(x), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i < n - q:
            if x[i] != x[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and x[j] == x[j + q]:
                j += 1
            if j - i + q >= max(24, 3 * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def collapsed(x, found):
    return " ".join(w for i, w in enumerate(x) if not any(s + q <= i < s + n for s, n, q in found))


def test_sequences_match_brute_force():
    rnd, total = random.Random(5), 0
    for _ in range(150):
        texts = []
        for _ in range(rnd.randint(1, 12)):
            n, k = rnd.choice([0, 1, 23, 24, 25, 60, 200, 500]), rnd.choice([1, 2, 3, 50])
            x = [rnd.randrange(k) for _ in range(n)]
            for _ in range(rnd.randint(0, 3) if n else 0):
                a = rnd.randrange(n)
                p = rnd.randint(1, max(1, (n - a) // rnd.choice([2, 3, 4, 7])))
                e = min(n, a + int(p * rnd.uniform(2.5, 8)))
                for i in range(a, e):
                    x[i] = x[a + (i - a) % p]
                if e > a and rnd.random() < 0.3:
                    x[rnd.randrange(a, e)] = 99
            texts.append(np.array(x, np.int64))
        for x, got in zip(texts, runs.runs_of(texts)):
            want = brute(x.tolist())
            total += len(want)
            assert [tuple(r) for r in got.tolist()] == want
    assert total > 100


def test_unlike_stretches_of_one_hash_are_compared_word_by_word(monkeypatch):
    exact = runs._Prefixes.common
    monkeypatch.setattr(runs._Prefixes, "common", lambda self, i, j, most, right: np.minimum(exact(self, i, j, most, right) + 3, most))
    x = np.array([0, 1, 2, 3, 4, 5, 6, 7, 8, 9] * 4 + list(range(10, 60)))
    assert [tuple(r) for r in runs.runs_of([x])[0].tolist()] == brute(x.tolist()) == [(0, 40, 10)]


def test_texts_with_nulls_odd_spaces_and_clashing_columns(spark):
    block = [f"w{i}" for i in range(30)]
    long = [f"x{i % 4001}" for i in range(60_000)]
    texts = [
        (1, None), (2, ""), (3, " \n\t "), (4, "a " * 24), (5, "a " * 23), (6, "a A " * 20), (7, "\x0b".join(block * 3)), (8, "  ".join(block * 3)[:-4]),
        (None, "no id " * 12), (9, "é  ü " * 12), (9, "é  ü " * 12), (10, "\n".join(long)), (11, "z" * 2_000_000 + " y" * 30), (12, " ".join(["x y y x y x x y"] * 12)),
    ]
    df = spark.createDataFrame([(d, t, 7, "r", b"") for d, t in texts], "doc_id long, text string, _c0 int, RUNS string, collapsed binary")
    got = runs.periodic_runs(df)
    assert got.columns == ["doc_id", "text", "_c0", "runs", "collapsed"]
    rows = got.collect()
    assert len(rows) == len(texts) and {r["_c0"] for r in rows} == {7}
    for r in rows:
        x = split(r["text"])
        found = [tuple(f) for f in r["runs"]]
        if r["doc_id"] == 10:
            assert found == [(0, 60_000, 4001)] and r["collapsed"] == " ".join(long[:4001])
        else:
            assert found == brute(x) and r["collapsed"] == collapsed(x, found)
    assert runs.periodic_runs(df.limit(0)).count() == 0


def test_query_matches_brute_force_on_whole_documents(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) < 2500").select("doc_id", "text")
    docs.union(spark.sql("SELECT 1000 + id, repeat(concat('so it goes ', id, ' '), 20) FROM range(60)")).union(spark.sql("SELECT NULL, 'a b'")).union(spark.sql("SELECT 5000, NULL")).write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for d, t in spark.read.parquet(f"{tmp_path}/documents.parquet").collect():
        x = split(t)
        h, n = (zlib.crc32(str(d).encode()) if d is not None else 1), len(x)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            x = [w if i < a else x[a + (i - a) % p] for i, w in enumerate(x)]
        found = brute(x)
        best = max(found, key=lambda r: (r[1] * 10**9 // r[2], -r[0], -r[2]), default=(None, None, None))
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in found)
        milli = 1000 * best[1] // best[2] if found else None
        want.append((str(d), len(found), *best, milli, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(collapsed(x, found).encode()).hexdigest()))
    got = queries.op13_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted((str(r[0]), *r[1:]) for r in got.collect()) == sorted(want)
    assert sum(r[1] for r in want) > 20


def test_strongest_run_by_exact_ratio(spark):
    df = spark.createDataFrame([([(5, 30, 10), (9, 90, 30), (2, 100, 33), (7, 100, 33)],)], f"runs {runs.RUN}")
    assert df.select(runs.strongest("runs").alias("b")).select("b.*").first() == (2, 100, 33)
    assert df.select(F.filter("runs", lambda r: r["period"] < 0).alias("runs")).select(runs.strongest("runs").alias("b")).first()["b"] is None
