import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.llm import hmm, queries

UPPER = {c: c + 32 for c in range(65, 91)}


def tokens(text):
    t = (text or "").translate(UPPER)
    return [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in t).split(" ") if w] + [""]


def counts(docs):
    c = Counter(w for _, t, learn in docs if learn for w in tokens(t))
    return c, sum(c.values()), len(c)


def chain(states, seed=1):
    rnd = np.random.default_rng(seed)
    move, emit = rnd.random((states, states)), rnd.random((states, 6))
    return hmm.Chain(np.full(states, 1 / states), move / move.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))


def test_forward_and_backward_match_a_sum_over_all_paths():
    c = chain(3)
    lengths = np.array([4, 1, 6, 4])
    tokens_ = np.array([0, 3, 2, 5, 1, 4, 4, 0, 2, 1, 3, 0, 3, 2, 5])
    total, moves = 0.0, np.zeros((3, 3))
    for b in hmm.blocks(lengths, tokens_, np.arange(4)):
        share, moved, ll = hmm.expected(c, c.emit.T[b.tokens], b.at)
        exact = hmm.log10_likelihood(c.start, c.move, c.emit, b)
        total, moves = total + ll, moves + moved
        assert np.allclose(share.sum(1), 1)
    want, wanted_moves = [], np.zeros((3, 3))
    for d in range(4):
        seen = tokens_[lengths[:d].sum() : lengths[: d + 1].sum()]
        paths = {}
        for path in itertools.product(range(3), repeat=len(seen)):
            p = c.start[path[0]] * c.emit[path[0], seen[0]]
            for (i, j), x in zip(itertools.pairwise(path), seen[1:]):
                p *= c.move[i, j] * c.emit[j, x]
            paths[path] = p
        want.append(sum(paths.values()))
        for path, p in paths.items():
            for i, j in itertools.pairwise(path):
                wanted_moves[i, j] += p / want[-1]
    assert np.isclose(total, np.log(want).sum()) and np.allclose(moves, wanted_moves)
    assert np.allclose(sorted(exact), sorted(np.log10(want)))


def test_wide_steps_give_the_same_bits(monkeypatch):
    c, rnd = chain(8), np.random.default_rng(6)
    lengths = rnd.integers(1, 40, 900)
    b = next(hmm.blocks(lengths, rnd.integers(0, 6, lengths.sum()), np.arange(900)))
    wide = hmm.log10_likelihood(c.start, c.move, c.emit, b)
    monkeypatch.setattr(hmm, "WIDE", 10**9)
    assert (wide == hmm.log10_likelihood(c.start, c.move, c.emit, b)).all()


def texts():
    rnd = np.random.default_rng(2)
    out = []
    for i in range(300):
        words = [f"{'ab'[i % 2]}{rnd.integers(40)}" for _ in range(rnd.integers(0, 60))]
        out.append((i, " ".join(words), i % 5 != 0))
    return out + [(900, None, True), (901, "", True), (902, " \n ", False), (None, "A1 a1 unseené B2", False), (903, "a1 " * 40_000, True), (903, "a1 " * 40_000, True), (904, "x" * 100_000, None)]


def frame(spark, docs):
    return spark.createDataFrame([(d, t, x, 1, b"") for d, t, x in docs], "doc_id long, text string, learn boolean, SCORE int, piece binary")


@pytest.fixture(scope="module")
def scored(spark):
    docs = texts()
    return docs, hmm.likelihoods(frame(spark, docs), F.col("learn"), states=3, rounds=5).collect()


def test_counts_and_base_match_brute_force(scored):
    docs, rows = scored
    c, n, v = counts(docs)
    want = []
    for d, t, learn in docs:
        w = tokens(t)
        base = sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)
        want.append((str(d), bool(learn), len(w), sum(c[x] > 0 for x in w), n, pytest.approx(base, rel=1e-9)))
    got = sorted((r[:6] for r in rows), key=lambda r: (str(r[0]), r[1], r[2]))
    assert [(str(r[0]), *r[1:]) for r in got] == sorted(want, key=lambda r: r[:3])


def test_the_chain_learns_and_equal_texts_get_equal_scores(scored):
    _, rows = scored
    own = [r for r in rows if not r["learned"] and r["doc_id"] is not None and r["doc_id"] < 900]
    assert sum(r["score"] for r in own) > sum(r["base_score"] for r in own) + 0.2 * sum(r["n_tokens"] for r in own)
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] == 903}) == 1
    assert len({r["score"] for r in rows if r["n_tokens"] == 1}) == 1


def test_score_is_the_sum_over_paths_under_the_trained_emissions(spark):
    docs = [(0, "a b a c", True), (1, "c c d", True), (2, "a d z", False)]
    table = hmm.tokenised(frame(spark, docs), F.col("learn"))
    c, likely = hmm.fit(table, 2, 4)
    assert len(likely) == 4 and likely[-1] > likely[0]
    answers, totals = hmm.word_counts(table, c, 2)
    words = {r["piece"]: r["words"] for r in table.select("piece", "words").collect()}
    found = {}
    for r in answers.collect():
        for p, n, s in zip(np.cumsum(np.frombuffer(r["pos"], "<i4")), np.frombuffer(r["n"], np.int64), np.frombuffer(r["share"], np.uint8).reshape(-1, 8)):
            found[words[r["piece"]][p]] = (n, s)
    known = sorted(found)
    assert {w: n for w, (n, _) in found.items()} == dict(counts(docs)[0]) and (totals.tokens, totals.words) == (9, 5)
    emit = hmm.emissions(np.array([found[w][0] for w in known] + [0]), np.array([found[w][1] for w in known] + [np.zeros(8, np.uint8)]), totals)
    assert np.allclose(emit.sum(1), 1)  # over the known words and one for all unknown ones
    for r in hmm.likelihoods(frame(spark, docs), F.col("learn"), 2, 4).collect():
        seen = [known.index(w) if w in found else len(known) for w in tokens(docs[r["doc_id"]][1])]
        p = 0.0
        for path in itertools.product(range(2), repeat=len(seen)):
            q = c.start[path[0]] * emit[path[0], seen[0]]
            for (i, j), x in zip(itertools.pairwise(path), seen[1:]):
                q *= c.move[i, j] * emit[j, x]
            p += q
        assert r["score"] == pytest.approx(math.log10(p), rel=1e-9)


def test_likelihood_rises_by_rounds(spark):
    table = hmm.tokenised(frame(spark, texts()), F.col("learn"))
    _, likely = hmm.fit(table, 3, 6)
    assert all(b > a - 1 for a, b in itertools.pairwise(likely)) and likely[-1] > 0.9 * likely[0]


def test_scores_dont_depend_on_pieces(spark, scored, monkeypatch):
    docs, rows = scored
    again = hmm.likelihoods(frame(spark, docs).repartition(1), F.col("learn"), states=3, rounds=5).collect()
    assert {str(r["doc_id"]): r["base_score"] for r in again} == {str(r["doc_id"]): r["base_score"] for r in rows}


def test_empty_table_and_nothing_learned(spark):
    assert hmm.likelihoods(frame(spark, []), F.col("learn")).count() == 0
    r = hmm.likelihoods(frame(spark, [(1, "a b", False), (2, None, False)]), F.col("learn"), rounds=2).collect()
    assert sorted((x["n_tokens"], x["n_known"], x["train_tokens"], x["base_score"]) for x in r) == [(1, 0, 0, 0.0), (3, 0, 0, 0.0)]
    assert all(math.isfinite(x["score"]) for x in r)


def test_query_learns_from_its_fold_only(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").union(spark.sql("SELECT NULL, 'no id'")).write.parquet(f"{tmp_path}/documents.parquet")
    docs = [(d, t, d is None or zlib.crc32(str(d).encode()) % 7 != 2) for d, t in spark.read.parquet(f"{tmp_path}/documents.parquet").collect()]
    c, n, v = counts(docs)
    rows = queries.op12_likelihood(spark, str(tmp_path))
    assert rows.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    got = {(r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) for r in rows.collect()}
    assert got == {(d, not learn, len(w := tokens(t)), sum(c[x] > 0 for x in w), n) for d, t, learn in docs}
    held = rows.where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert held["s"] > held["b"]


def test_large_rows_come_in_small_row_groups(spark, tmp_path):
    import pyarrow.parquet as pq

    from strandloom.llm.common import cut

    rows = spark.range(40).coalesce(1).select("id", F.expr("cast(array_join(transform(sequence(1, 16384), i -> sha2(cast(id * 100000 + i as string), 512)), '') as binary)").alias("body"))
    table = cut(rows, "large", large_rows=True)
    assert table.count() == 40
    for f in table.inputFiles():
        parts = pq.ParquetFile(f.removeprefix("file:").replace("//", "/")).metadata
        assert all(parts.row_group(i).total_byte_size <= 24 << 20 for i in range(parts.num_row_groups))  # 2 MB a row
