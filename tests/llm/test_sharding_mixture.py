import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.llm import mixture, queries, sharding


@pytest.mark.parametrize("n", [1, 2, 3, 7, 8, 64, 65, 1000, 4097])
def test_permutation_and_its_inverse(n):
    rows = np.arange(n)
    placed = sharding.permute(rows, n)
    assert sorted(placed.tolist()) == rows.tolist()
    assert (sharding.permute(placed, n, back=True) == rows).all()
    assert (sharding.row_at(placed % 8, placed // 8, n, 8) == rows).all()


def test_shards(spark):
    docs = [(i, f"text {i % 40}", "x") for i in range(203)] + [(None, None, "x"), (5, "", "x"), (5, "", "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, slot string").withColumn("_hash", F.lit(1)).withColumn("_place", F.lit("p")).withColumn("row_no", F.lit(1))
    rows = sharding.assign(df).collect()
    counts = {}
    for r in rows:
        counts.setdefault(r["shard"], []).append(r["slot"])
    assert len(rows) == len(docs) and set(counts) == set(range(8))
    assert all(sorted(s) == list(range(len(s))) for s in counts.values())
    assert max(map(len, counts.values())) - min(map(len, counts.values())) <= 1
    again = sharding.assign(df.repartition(5, "text")).collect()
    key = lambda r: (str(r["doc_id"]), r["text"] or "", r["shard"], r["slot"])
    assert sorted(map(key, rows)) == sorted(map(key, again))
    assert sharding.assign(df.limit(0)).collect() == []


def filled(sizes):
    """Targets by repeated sharing, in plain Python."""
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    target, left, open_ = dict.fromkeys(sizes, 0.0), 1.5 * sum(sizes.values()), set(sizes)
    while open_ and left > 1e-9:
        share = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if target[s] + share * weight[s] >= 2 * sizes[s]}
        for s in full or open_:
            add = 2 * sizes[s] - target[s] if full else share * weight[s]
            target[s] += add
            left -= add
        open_ -= full or open_
    return target


def chances(sizes, rest):
    """Inclusion probabilities in proportion to the root of each size's class, certain ones set aside, in plain Python."""
    root = [2 ** (int(math.log2(max(s, 1))) / 2) for s in sizes]
    certain = set()
    while True:
        left = rest - sum(sizes[i] for i in certain)
        weight = sum(r * s for i, (r, s) in enumerate(zip(root, sizes)) if i not in certain)
        scale = max(left, 0) / weight if weight else 0.0
        over = [i for i, r in enumerate(root) if i not in certain and scale * r > 1 + 1e-12]
        if not over:
            return [1.0 if i in certain else scale * r for i, r in enumerate(root)]
        top = max(root[i] for i in over)  # the largest class first
        certain |= {i for i in over if root[i] == top}


def brute_copies(rows, target):
    """Copies of a source's rows (draw, size): whole ones, and the head of the ranking by odds ratios."""
    total = sum(n for _, n in rows)
    whole = int(target // total) if total else 0
    rest = target - whole * total if total else 0.0
    p = chances([n for _, n in rows], rest)
    order = []
    for i, (draw, _) in enumerate(rows):
        u = ((draw % 2**64 >> 11) + 0.5) / 2**53
        if p[i] > 0:
            order.append((0.0 if p[i] >= 1 else u / (1 - u) / (p[i] / (1 - p[i])), draw, i))
    copies, words, k = [whole] * len(rows), 0, 0
    order.sort()
    while k < len(order):
        same = [i for _, d, i in order[k:] if d == order[k][1]]  # rows equal in all are drawn together
        if words + sum(rows[i][1] for i in same) / 2 > rest:
            break
        for i in same:
            copies[i] += 1
            words += rows[i][1]
        k += len(same)
    return copies


def test_mixture(spark):
    docs = [(i, f"s{i % 5}" if i % 11 else None, "w " * (1 + i * 7 % 50 + 900 * (i % 97 == 0))) for i in range(700)]
    docs += [(1000, "tiny", "one"), (1001, "empty", None), (1002, "empty", ""), (None, "s1", "a b"), (7, "s2", "c d"), (7, "s2", "c d"), (8, "s1", "x " * 60_000)]
    df = spark.createDataFrame([(*d, 5, 6, "k", 1.5) for d in docs], "doc_id long, source string, text string, copies int, _plan int, _key string, target double")
    rows = mixture.mix(df).collect()
    assert len(rows) == len(docs) and {"_plan", "_key"} < set(rows[0].asDict())
    draws = df.select("doc_id", "source", "text", F.xxhash64(F.lit(mixture.SEED), "doc_id", "source", "text").alias("draw")).collect()
    sizes, target = {}, {}
    for r in rows:
        assert r["size"] == len((r["text"] or "").split()) and 0 <= r["copies"] <= 2
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
        target[r["source"]] = r["target"]
    expected = filled(sizes)
    for s in sizes:
        assert target[s] == pytest.approx(expected[s])
        mine = [(r["draw"], len((r["text"] or "").split())) for r in draws if r["source"] == s]
        key = lambda x: (x[0], x[1])
        told = sorted(((d, n, c) for (d, n), c in zip(mine, brute_copies(mine, target[s]))), key=key)
        of = {(r["doc_id"], r["text"]): r["draw"] for r in draws if r["source"] == s}
        got = sorted(((of[r["doc_id"], r["text"]], r["size"], r["copies"]) for r in rows if r["source"] == s), key=key)
        assert got == told, s
        assert all(r["source_size"] == sizes[s] for r in rows if r["source"] == s)
    again = mixture.mix(df.repartition(3)).collect()
    key = lambda r: (str(r["doc_id"]), str(r["source"]), r["copies"])
    assert sorted(map(key, rows)) == sorted(map(key, again))
    assert mixture.mix(df.limit(0)).collect() == []


def test_long_documents_are_likelier(spark):
    df = spark.range(3000).selectExpr("id AS doc_id", "'a' AS source", "repeat('w ', if(id % 2 = 0, 4, 64)) AS text").union(spark.range(9000, 12000).selectExpr("id", "'b'", "repeat('v ', 100)"))
    n = {r["size"]: r["n"] for r in mixture.mix(df).where("source = 'b' OR copies % 2 = 1").groupBy("size").agg(F.sum("copies").alias("n")).collect()}
    assert n.get(64, 0) >= n.get(4, 0)


def test_shards_query(spark, tmp_path):
    docs = [(i, f"text é {i % 40}") for i in range(101)] + [(None, None), (5, ""), (5, ""), (6, "x" * 1_000_000)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.op6_shards(spark, str(tmp_path)).collect()
    told = sorted((str(d), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in docs)
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in rows) == told
    assert all(r["law"] == "rows" and r["grown_shard"] is None for r in rows)
    assert sorted((r["shard"], r["slot"]) for r in rows) == sorted((k % 8, k // 8) for k in range(len(docs)))


def test_many_rows_in_one_interval(spark):
    """More rows than FEW in an interval: it is split again."""
    df = spark.range(40_000).selectExpr("id AS doc_id", "if(id % 3 = 0, 'a', 'b') AS source", "'x y' AS text")
    out = mixture.mix(df).groupBy("source").agg({"copies": "sum", "target": "max"}).collect()
    for r in out:
        assert abs(2 * r["sum(copies)"] - r["max(target)"]) <= 1
