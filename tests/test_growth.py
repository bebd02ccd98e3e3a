"""What shows in larger tables only: work that must not grow faster than its input, and values that small tables lack."""

import difflib
import random

import duckdb

from strandloom.functions import similarity
from strandloom.operators import align, folds
from strandloom.plans import catalogue


def word(rnd, letters, most):
    return "".join(rnd.choice(letters) for _ in range(rnd.randint(0, most)))


def test_ratio_is_the_standard_library_s(monkeypatch):
    rnd = random.Random(5)
    pairs = [(word(rnd, "ab", 30), word(rnd, "ab", 30)) for _ in range(300)] + [(word(rnd, "ab한🙂 ", 300), word(rnd, "ab한🙂 ", 300)) for _ in range(20)]
    for short in (similarity.SHORT, 0):  # 0: no rest is left to the standard library
        monkeypatch.setattr(similarity, "SHORT", short)
        for a, b in pairs:
            told = difflib.SequenceMatcher(None, a, b, autojunk=False).ratio()
            assert similarity.ratio(a, b) == told <= similarity.ratio_bounds([a], [b])[0, 0]


def test_edited_texts_are_compared_without_quadratic_work(monkeypatch):
    rnd = random.Random(6)
    text = ", ".join(word(rnd, "abcdefgh", 60) for _ in range(400))
    monkeypatch.setattr(similarity.difflib, "SequenceMatcher", lambda _, a, b, **more: QuickOnly(None, a, b, **more))
    assert 0.9 < similarity.ratio(text, text.replace(",", "")) < 1


class QuickOnly(difflib.SequenceMatcher):
    def __init__(self, _, a, b, **more):
        assert len(a) * len(b) <= similarity.SHORT
        super().__init__(None, a, b, **more)


def test_a_long_conversation_compares_few_pairs(monkeypatch):
    rnd, calls = random.Random(7), []
    monkeypatch.setattr(align, "ratio", lambda a, b: calls.append(1) or similarity.ratio(a, b))
    left = [(i * 10.0, " the ".join(word(rnd, "abcdefghijkl ", 20) for _ in range(6))) for i in range(150)]
    right = [(t + 2, x.replace(" the ", " ")) for i, (t, x) in enumerate(left) if i % 5 != 3]
    told = align.monotone(left, right)
    assert [(s, i) for s, i, _, _ in told] == [("current_only" if i % 5 == 3 else "matched", i) for i in range(150)]
    assert len(calls) < 4 * len(left)  # all pairs: 18,000


def test_labels_beyond_ten_thousand_match_their_sql(spark, tmp_path):
    keys = [999, 1000, 1234, 9999, 10_000, 19_999, 100_000, 1_234_567]
    spark.createDataFrame([(k, k % 50 + 1) for k in keys], "p_partkey long, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    told = sorted(con.execute(catalogue.ORACLES["durations_and_labels"]).fetchall())
    assert sorted(map(tuple, catalogue.QUERIES["durations_and_labels"](spark, str(tmp_path)).collect())) == told


def dealt(spark, name):
    """How often a query deals rows into parts whose number Spark doesn't lessen."""
    return catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression")


def test_references_are_joined_in_parts_that_grow_in_number(spark):
    assert dealt(spark, "integrity_semi_anti") >= 4


def test_positions_are_covered_in_parts_that_grow_in_number(spark):
    assert dealt(spark, "exact_cover_violations") >= 4


def test_a_fold_gets_narrow_rows_a_few_at_a_time(spark):
    """Texts don't pass through the fold's Python, and its values come in parts that cross no border of a key."""
    plan = catalogue.QUERIES["lookback_groups"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    (line,) = [x for x in plan.splitlines() if "MapInArrow" in x]
    assert "text#" not in line and "ko#" not in line
    rows = spark.range(5000).selectExpr("id div 2500 AS k", "id", "repeat('x', 100) AS wide")
    told = folds.fold(rows, ["k"], ["id"], ["id"], lambda: (lambda seen: lambda _: seen.append(1) or len(seen))([]))
    assert told.where("grp <> id % 2500 + 1 OR length(wide) <> 100").isEmpty() and told.count() == 5000


def test_a_video_s_metadata_comes_with_its_first_row_only(spark):
    plan = catalogue.QUERIES["editorial_changes"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "MapInPandas" not in plan and any("THEN about" in x for x in plan.splitlines())


def test_features_of_documents_stay_in_one_row(spark, tmp_path, monkeypatch):
    """Not a row for each word and piece of a document: only rare ones meet their counts by a shuffle. A doc_id's rows are one document; results are SQL's whichever counts are common."""
    from strandloom.operators import members
    from strandloom.plans import aggregated

    path, text = str(tmp_path), "select i % 10 as doc_id, chr((97 + i % 2)::int) as source, case i when 3 then null when 4 then '' else 'Café ' || chr((97 + i % 5)::int) || 'bc deaf ab ' || i || ' common, word' end as text from range(12) t(i)"
    duckdb.sql(f"copy (select * from ({text}) union all select 20, null, 'deaf common') to '{path}/documents.parquet'")
    expected = duckdb.connect()
    expected.sql(f"create view documents as from '{path}/documents.parquet'")
    rows, saved = {}, members.saved
    monkeypatch.setattr(members, "saved", lambda df, name: rows.setdefault(name, []).append(out := saved(df, name)) or out)
    for name in ("representative_unit", "diverse_top3"):
        for common in (3, 1 << 17):
            monkeypatch.setattr(aggregated, "COMMON", common)
            got = sorted(map(tuple, catalogue.QUERIES[name](spark, path).collect()), key=str)
            assert got == sorted(expected.sql(catalogue.ORACLES[name]).fetchall(), key=str)
    assert all(f.count() <= 12 for f in rows["features"])
