"""Words and pieces as numbers, and documents' features counted without a row for each."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from strandloom.functions import lettering
from strandloom.plans import aggregated, catalogue

TEXTS = [None, "", "a", "é", "Ã", "÷", "ab", "漢字ab Café-x", "a" * 50, "ab" * 200, "b" * 1000 + " " + "b" * 999 + "c " + "b" * 1000]


def number(piece):
    return int.from_bytes(piece.encode("latin-1"), "big")


@pytest.mark.parametrize(("block", "long"), [(1, 256), (100, 20), (1 << 16, 256)])
def test_features_are_those_of_the_pattern(monkeypatch, block, long):
    rnd = random.Random(1)
    texts = ["".join(rnd.choice("abcé÷×Ãß 한🙂zZ09ÿ_-\x00") for _ in range(rnd.randint(0, 60))) for _ in range(500)] + TEXTS
    monkeypatch.setattr(lettering, "BLOCK", block)
    monkeypatch.setattr(lettering, "LONG", long)
    told = lettering.features(pa.array([None, "x", *texts]).slice(2))
    assert [x.dtype for x, _ in told] == list(lettering.KINDS) and {len(ends) for _, ends in told} == {len(texts) + 1}
    hashes = {}
    for i, text in enumerate(texts):
        words, pairs, triples = (x[ends[i] : ends[i + 1]].tolist() for x, ends in told)
        expected = set(re.findall(aggregated.WORD, text or ""))
        for held, k in ((pairs, 2), (triples, 3)):
            assert held == sorted({number(w[j : j + k]) for w in expected for j in range(len(w) - k + 1)})
        assert len(words) == len(expected) and all(w < 0 for w in words)
        if len(expected) == 1:
            hashes[expected.pop()] = words[0]
        else:
            assert {hashes[w] for w in expected & set(hashes)} <= set(words)
    assert len(set(hashes.values())) == len(hashes) > 10


def documents(n):
    return [(f"s{i % 3}", i, f"common é{i % 7} x{i // 4} 12") for i in range(n)]


@pytest.mark.parametrize("held", [1, 1 << 21])
def test_a_task_adds_up_counts_before_any_shuffle(monkeypatch, held):
    """One count for each feature of a source, not one for each document and feature, as long as they fit."""
    monkeypatch.setattr(aggregated, "HELD", held)
    monkeypatch.setattr(aggregated, "ROWS", 100)
    batch = pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*documents(400), strict=True)], names=["source", "doc_id", "text"])
    told = list(aggregated._counts(7)(aggregated._features(iter([batch]))))
    blobs = [r for b in told for r in b.to_pylist()]
    assert len(blobs) <= 7 * 3 or held == 1
    counts = [{"part": r["part"], "source": r["source"], "f": f, "df": n} for r in blobs for f, n in zip(np.frombuffer(r["fs"], np.int64).tolist(), np.frombuffer(r["dfs"], np.int64).tolist(), strict=True)]
    expected = Counter((s, p) for s, _, t in documents(400) for p in {w[j : j + k] for w in t.split() for k in (2, 3) for j in range(len(w) - k + 1)})
    told = Counter()
    for r in counts:
        if r["f"] > 0:
            told[r["source"], r["f"]] += r["df"]
    assert told == {(s, number(p)): n for (s, p), n in expected.items()}
    assert len({(r["part"], r["f"]) for r in counts}) == len({r["f"] for r in counts})
    if held > 1:
        assert len(counts) == len({(r["source"], r["f"]) for r in counts})


@pytest.mark.parametrize("common", [0, 40, 1 << 20])
def test_only_features_that_are_not_common_leave_their_document(spark, tmp_path, monkeypatch, common):
    """However many features are common, results are one and the same; and the rest that is shuffled lacks them."""
    rows, saved = {}, aggregated.members.saved
    monkeypatch.setattr(aggregated.members, "saved", lambda df, name: rows.setdefault(name, out := saved(df, name)) and out)
    monkeypatch.setattr(aggregated, "COMMON", common)
    spark.createDataFrame(documents(60), "source string, doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    told = sorted(map(tuple, catalogue.QUERIES["representative_unit"](spark, str(tmp_path)).collect()))
    features = [{f for w in t.split() for f in [("w", w)] + [w[j : j + k] for k in (2, 3) for j in range(len(w) - k + 1)]} for _, _, t in documents(60)]
    df = Counter((s, f) for (s, _, _), fs in zip(documents(60), features, strict=True) for f in fs)
    central = {i: sum(df[s, f] - 1 for f in fs) / (len(fs) * 19) for (s, i, _), fs in zip(documents(60), features, strict=True)}
    expected = []
    for s in ("s0", "s1", "s2"):
        ids = [i for t, i, _ in documents(60) if t == s]
        best = sorted(ids, key=lambda i: (-round(central[i], 9), abs(ids.index(i) - 9.5), ids.index(i)))[:5]
        expected += [(s, i, pytest.approx(central[i], abs=1e-6), k + 1) for k, i in enumerate(best)]
    assert sorted(told, key=lambda r: (r[0], r[3])) == expected
    rest = rows["sums"].selectExpr("sum(size(rest))").first()[0]
    alone = sum(1 for n in df.values() if n == 1)
    assert rest == sum(df.values()) if common == 0 else rest == alone if common > 40 else alone < rest < sum(df.values())


def test_tables_without_a_word_or_without_a_shared_one(spark, tmp_path):
    for name, text in (("none", "÷ --"), ("alone", "x")):
        path = str(tmp_path / name)
        spark.createDataFrame([("s", 1, text), (None, 2, text)], "source string, doc_id long, text string").write.parquet(f"{path}/documents.parquet")
        assert list(map(tuple, catalogue.QUERIES["diverse_top3"](spark, path).collect())) == ([] if name == "none" else [("s", 1, None, None)])


def test_counts_that_come_once_are_left_out_and_the_largest_are_common(spark):
    rows = [(0, "s", [3, 5, -1], [1, 2, 1]), (0, "t", [3], [1]), (0, "s", [3, 7], [1, 30])]
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows]), *(pa.array([np.array(r[k], np.int64).tobytes() for r in rows], pa.binary()) for k in (2, 3))], names=["part", "source", "fs", "dfs"])
    told = list(aggregated._repeated(iter([batch])))
    assert [r for b in aggregated._rows(2, 31)(iter(told)) for r in b.to_pylist()] == [{"source": "s", "f": f, "df": n} for f, n in ((3, 2), (5, 2), (7, 30))]
    assert [r for b in aggregated._rows(2, 30)(iter(told)) for r in b.to_pylist()] == [{"source": "s", "f": f, "df": 2} for f in (3, 5)]
    assert [r for b in aggregated._edges(iter(told)) for r in b.to_pylist() if r["size"]] == [{"edge": 2, "size": 2}, {"edge": 30, "size": 1}]


def test_counts_of_equal_keys_are_added():
    keys, n = lettering.counted(np.array([5, -3, 5, 7]), np.array([1, 2, 3, 4]))
    assert keys.tolist() == [-3, 5, 7] and n.tolist() == [2, 4, 4]


def test_a_large_source_meets_its_choices_in_many_tasks(spark):
    plan = catalogue.QUERIES["diverse_top3"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Join" in x and "deal#" in x for x in plan.splitlines()) >= 2
