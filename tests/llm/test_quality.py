import pathlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.llm import quality, queries

SF_DIR = "/root/testdata/sf0.01"


def test_fit_orders_pairs():
    rnd = np.random.default_rng(1)
    x = np.zeros((400, quality.N_FEATURES))
    x[:, :15] = rnd.normal(size=(400, 15))
    good = x[:, 3] - x[:, 5] + rnd.normal(scale=0.3, size=400) > 0
    ranker = quality.fit(x[:300], good[:300], pairs=20_000)
    s = ranker.score(x[300:])
    assert ((s >= quality.ACCEPT) == good[300:]).mean() > 0.85
    assert 0 <= s.min() and s.max() <= 1


def by_definition(text):
    """A text's features one by one."""
    out = np.zeros(quality.N_FEATURES)
    data = text or b""
    for b in data:
        out[quality._CLASS[b]] += 1
    caps = out[2] / max(out[1] + out[2], 1)
    out[: quality.N_CLASSES] = np.sqrt(out[: quality.N_CLASSES] / max(len(data), 1))
    out[1] = np.sqrt(caps)
    words = data.lower().split()
    m, at = len(words), quality.N_CLASSES
    if m:
        out[at : at + 5] = [np.sqrt(sum(a == b for a, b in zip(words, words[1:])) / m), np.log1p(m), np.log1p(m) - np.log1p(len(set(words))), np.log(len(data) / m), np.sqrt(sum(len(w) < 2 for w in words) / m)]
    return out


def test_features_by_definition(monkeypatch):
    texts = [b"", b"Two words, two words two\ntwo x", None, b"   ", b"a", b"word " * 50 + b"\xc3\xa9\xc3\xa9 END 12"]
    for piece in (1, 30, 1 << 20):
        monkeypatch.setattr(quality, "PIECE", piece)
        got = quality.features(texts)
        shapes = quality.N_CLASSES + quality.N_SHAPES
        assert np.allclose(got[:, :shapes], [by_definition(t)[:shapes] for t in texts])
        hashed = (got[:, shapes:] ** 2).reshape(len(texts), 2, -1).sum(2)
        assert np.allclose(hashed[:, 0], [bool((t or b"").split()) for t in texts])
        assert np.allclose(hashed[:, 1], [max(len(t or b"") - 2, 0) / max(len(t or b""), 1) for t in texts])


def test_one_label_only_passes_all():
    ranker = quality.fit(np.ones((5, quality.N_FEATURES)), np.ones(5, bool))
    assert (ranker.score(np.zeros((2, quality.N_FEATURES))) >= quality.ACCEPT).all()
    assert (quality.fit(np.zeros((0, quality.N_FEATURES)), np.zeros(0, bool)).score(np.zeros((1, quality.N_FEATURES))) >= quality.ACCEPT).all()


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, "Some words here."), (2, None), (3, ""), (None, "zz " * 50_000), (1, "Some words here."), (5, "!!!!|||| 11")], "doc_id long, text string").withColumn("quality", F.lit("x")).withColumn("h", F.lit(1))
    labels = spark.createDataFrame([(1, 1), (5, 0), (7, None), (None, 1)], "doc_id long, quality int")
    ranker = quality.train(docs, labels)
    rows = docs.select("doc_id", quality.held_out(F.col("doc_id")).alias("h"), quality.score(F.col("text"), ranker).alias("s")).collect()
    assert len(rows) == 6 and all(0 <= r["s"] <= 1 for r in rows)
    assert docs.limit(0).select(quality.score(F.col("text"), ranker)).collect() == []


@pytest.mark.skipif(not pathlib.Path(SF_DIR).exists(), reason="test tables aren't here")
def test_held_out_accuracy(spark):
    rows = queries.op5_quality(spark, SF_DIR).where("held_out").join(spark.read.parquet(f"{SF_DIR}/labels.parquet"), "doc_id").collect()
    good = [r["predicted"] for r in rows if r["quality"] == 1]
    bad = [r["predicted"] for r in rows if r["quality"] == 0]
    assert np.mean(good) >= 0.95 and np.mean(bad) <= 0.2


def test_equal_rows_get_equal_scores_in_any_batch():
    rnd = np.random.default_rng(0)
    x = rnd.random((700, quality.N_FEATURES))
    x[::7] = x[0]
    ranker = quality.Ranker(rnd.random(quality.N_FEATURES), rnd.random(quality.N_FEATURES) + 0.1, rnd.normal(size=quality.N_FEATURES), 0.2)
    whole = ranker.score(x)
    assert len(set(whole[::7])) == 1
    for size in (1, 3, 64):
        assert np.array_equal(np.concatenate([ranker.score(x[i : i + size]) for i in range(0, 700, size)]), whole)
