"""Operators that SQL can't express, and edges that the tables don't have, on small fixtures."""

import difflib
import json
import random

import pytest
from pyspark.sql import functions as F

from strandloom.functions import clock, repairs, similarity, text
from strandloom.operators import align, folds, islands, joins, members, rules
from strandloom.plans import aligned
from strandloom.sources import documents
from strandloom.streaming import islands as stream


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_ratio_is_that_of_matching_blocks():
    rnd = random.Random(1)
    for _ in range(50):
        a, b = ("".join(rnd.choice("ab c") for _ in range(rnd.randint(0, 30))) for _ in range(2))
        assert similarity.ratio(a, b) == difflib.SequenceMatcher(None, a, b, autojunk=False).ratio()
    assert similarity.ratio(None, "a") is None and similarity.ratio("", "") == 1.0


def test_edit_classes():
    assert similarity.edit_class("a b", "a b") == "none"
    assert similarity.edit_class("a, b.", "a b") == "punctuation"
    assert similarity.edit_class("um a b", "a b") == "filler"
    assert similarity.edit_class("the quick brown fox", "xyz") == "substantive"


def test_source_spans():
    status, coverage, spans = align.source_spans("b c d x", [(1, "a b"), (2, "c d")])
    assert (status, coverage) == ("partial", 0.75)
    assert spans == [(1, "b"), (2, "c d")]
    assert align.source_spans("", []) == ("weak", 0.0, [])


def test_monotone_alignment_keeps_order_and_every_row():
    left = [(0.0, "one two"), (10.0, "three four"), (20.0, "five six")]
    right = [(1.0, "one two"), (21.0, "five six"), (30.0, "zzzz")]
    out = align.monotone(left, right)
    assert [x[0] for x in out] == ["matched", "current_only", "matched", "gold_only"]
    assert [i for _, i, _, _ in out if i is not None] == [0, 1, 2]
    assert [j for _, _, j, _ in out if j is not None] == [0, 1, 2]
    assert align.monotone([], right)[0][0] == "gold_only" and align.monotone([], []) == []


def test_support_prefers_few_neighbours():
    rows = [(1, "a", {"a"}), (2, "b", {"b"}), (3, "a b", {"a", "b"}), (4, "c", {"c"})]
    assert align.support(["a", "b", "x", "y"], rows) == [1]  # a quarter is enough
    assert align.support(["a", "b"], rows, ratio=1.0) == [3]
    assert align.support(["b", "c"], rows, ratio=1.0) == [3, 4]
    assert align.support(["a", "c"], rows[:1] + [(k, "-", set()) for k in range(10, 20)] + rows[3:], ratio=1.0) == [1, 4]
    assert align.support(["zz"], rows) == [] and align.support([], rows) == []


def test_names_are_variants_but_not_extensions():
    alike = similarity.similar_names
    assert alike("Cloud Code", "Claude Code") and not alike("Claude", "Claude Code") and not alike("Agent IDE", "Agent Lab")
    assert alike("Midjourny", "Midjourney") and not alike("Sandy", "Sandy Lee") and alike("Kloud Code", "Cloud Code")


def test_edit_candidates_hold_every_pair(spark):
    rnd = random.Random(6)
    names = {"".join(rnd.choice("ab") for _ in range(rnd.randint(0, 9))) for _ in range(120)}
    df = spark.createDataFrame([(n,) for n in names], "name string")
    c = members.edit_candidates(df, "name", 2)
    got = {tuple(r) for r in c.where(F.levenshtein("a", "b") <= 2).collect()}
    every = df.select(F.col("name").alias("a")).crossJoin(df.select(F.col("name").alias("b"))).where((F.col("a") < F.col("b")) & (F.levenshtein("a", "b") <= 2))
    assert got == {tuple(r) for r in every.collect()} and got


def test_chunks_by_definition():
    rnd = random.Random(2)
    for _ in range(40):
        text = " ".join("x" * rnd.randint(1, 60) + rnd.choice(["", "", "", "."]) for _ in range(rnd.randint(0, 40))) + "y" * rnd.choice([0, 900])
        got = folds.chunks(text, 100)
        assert all(0 < len(c) <= 100 for c in got) and "".join("".join(got).split()) == "".join(text.split())
    assert folds.chunks("a. b. c.", 5) == ["a. b.", "c."] and folds.chunks(None) == []


def test_clock(spark):
    got = [one(spark, clock.clock_to_seconds(F.lit(t))) for t in ("1:02", "1:02:03", "0:00")]
    assert got == [62, 3723, 0]
    assert one(spark, clock.clock_to_seconds(F.lit("x"))) is None


def test_glossary(spark):
    parsed = one(spark, rules.parse_glossary(F.lit("# note\n a => b \n\n c => d => high\n e =>\n f => g => odd")))
    assert [tuple(r) for r in parsed] == [("a", "b", "medium"), ("c", "d", "high"), ("f", "g", "medium")]


def test_korean_particles(spark):
    words = ["학교에서", "책을", "책"]
    assert [one(spark, text.strip_particle(F.lit(w))) for w in words][2] == "책"


def test_asof_takes_the_last_mark_before(spark):
    rows = spark.createDataFrame([("u", 5.0, 7), ("u", 10.0, 7), ("u", 1.0, 7), ("v", 3.0, 7)], "k string, at double, pos int")
    marks = spark.createDataFrame([("u", 4.0, 1, 1), ("u", 10.0, 2, 2)], "k string, at double, pos int, mark int")
    got = {(r["k"], r["at"]): r["mark"] for r in joins.asof(rows, marks, "k", "at", "pos", ["mark"]).collect()}
    assert got == {("u", 5.0): 1, ("u", 10.0): 2, ("u", 1.0): None, ("v", 3.0): None}


def test_runs_count_changes_and_nulls(spark):
    rows = spark.createDataFrame([("d", i, v) for i, v in enumerate(["a", "a", None, None, "b", "a"])], "d string, pos int, v string")
    got = islands.runs(rows, ["d"], ["pos"], F.col("v")).orderBy("pos").collect()
    assert [r["run"] for r in got] == [1, 1, 2, 2, 3, 4]


def test_components(spark):
    edges = spark.createDataFrame([("b", "a"), ("b", "c"), ("x", "y"), ("z", "z")], "a string, b string")
    got = {tuple(r) for r in members.components(edges).collect()}
    groups = {}
    for row in got:
        groups.setdefault(row[1], set()).add(row[0])
    assert {"a", "b", "c"} in groups.values() and {"x", "y"} in groups.values()


def test_batches_never_split_a_row_and_keep_bounds(spark):
    sizes = [3, 4, 9, 1, 1, 1, 20, 2]
    rows = spark.createDataFrame([("d", i, n) for i, n in enumerate(sizes)], "d string, pos int, chars int")
    grouped = folds.fold(rows, ["d"], ["pos"], ["chars"], folds.batches(3, 10)).orderBy("pos").collect()
    by = {}
    for r in grouped:
        by.setdefault(r["grp"], []).append(r["chars"])
    assert [n for g in sorted(by) for n in by[g]] == sizes
    assert all(len(g) <= 3 and (sum(g) <= 10 or len(g) == 1) for g in by.values())


def test_documents_are_read_with_corrupt_ones_marked(spark, tmp_path):
    good = {"metadata": {"video_id": "v1", "duration_seconds": 60.0}, "creator_chapters": [{"start_seconds": 0.0, "label": "a"}, {"start_seconds": 20.0, "label": "b"}], "transcript": {"items": [{"segment_id": "s0", "text": " hi ", "start_seconds": 0.0, "duration_seconds": 4.0}, {"segment_id": "s1", "text": " ", "start_seconds": 5.0, "duration_seconds": 4.0}]}}
    (tmp_path / "a.json").write_text(json.dumps(good))
    (tmp_path / "b.json").write_text("{broken")
    docs = documents.read_documents(spark, str(tmp_path)).orderBy("file")
    rows = docs.select("file", "_corrupt", documents.document_kind().alias("kind")).collect()
    assert [(r["file"], r["_corrupt"] is None, r["kind"]) for r in rows] == [("a.json", True, "acquisition"), ("b.json", False, "unknown")]
    assert [tuple(r) for r in documents.segments_of(docs).select("segment_id", "text", "end_s").collect()] == [("s0", "hi", 4.0)]
    chapters = documents.chapters_of(docs).orderBy("idx").collect()
    assert [(r["label"], r["start_s"], r["end_s"]) for r in chapters] == [("a", 0.0, 20.0), ("b", 20.0, 60.0)]


def test_publish_refuses_to_overwrite(spark, tmp_path):
    from pyspark.errors import AnalysisException

    rows = spark.range(2)
    documents.publish(rows, str(tmp_path / "out"))
    with pytest.raises(AnalysisException):
        documents.publish(rows, str(tmp_path / "out"))
    documents.publish(spark.range(3), str(tmp_path / "out"), force=True)
    assert spark.read.json(str(tmp_path / "out")).count() == 3


def test_cleanup_by_hand(spark):
    texts = ["[음악] 어 좀 어 좀 그냥 음 그 그 그 말", "어떤 A/B 시험 A 음", "요런 것 끝나는게 좋다 .", "감나  뽑는 무드을"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    out, n = repairs.cleaned_up(F.col("t"))
    got = [(r["o"], r["n"]) for r in df.orderBy("i").select(out.alias("o"), n.alias("n")).collect()]
    assert got == [("그냥 그 말", 4), ("어떤 A/B 시험", 2), ("이런 것 끝나는 게 좋다.", 2), ("누구나 뽑는 무드를", 2)]


def test_anchors_by_hand(spark):
    said = F.lit('See https://x.org/a, read notes.md, take 3.5 GB or $20 of "two words" in ChatGPT and Figma. Because AI2 wins. 7.')
    assert one(spark, repairs.exact_values(said)) == ["https://x.org/a", "notes.md", "3.5 GB", "$20", "7", "two words"]
    assert sorted(one(spark, repairs.latin_names(said))) == ["AI2", "ChatGPT", "Figma", "GB"]
    assert one(spark, repairs.fidelity_warnings(said, F.lit("https://x.org/a notes.md 3.5 GB $20 two words ChatGPT AI2"))) == ["possible_missing_exact_value:7", "possible_missing_latin_name:Figma"]


def test_literal_targets_by_hand(spark):
    said = F.lit("Please click Save As and then say go, ok say Go. I say it, it. {slash} command launch preview and edit")
    assert one(spark, repairs.literal_targets(said)) == ["launch preview", "Save As", "go", "Go"]
    assert one(spark, repairs.ownership(F.lit("Code by Acme"))) == "Acme's Code"


def test_gap_sessions_on_a_stream(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    events = [("u", "2024-01-01 00:00:00"), ("u", "2024-01-01 00:03:00"), ("u", "2024-01-01 01:00:00"), ("v", "2024-01-01 00:01:00")]
    spark.createDataFrame(events, "k string, at string").select("k", F.to_timestamp("at").alias("at")).write.mode("append").parquet(str(source))
    read = spark.readStream.schema("k string, at timestamp").parquet(str(source))
    sessions = stream.gap_sessions(read, "k", "at", "10 minutes", "5 minutes")
    run = sessions.writeStream.format("memory").queryName("sessions_seen").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    # the watermark, five minutes behind 01:00, closes the two sessions that ended before it
    assert sorted((r["k"], r["n"]) for r in spark.table("sessions_seen").collect()) == [("u", 2), ("v", 1)]


def test_long_turns_are_aligned_whole(spark, tmp_path):
    said = "one " * 110 + "ends with the words that the copy lacks"
    spark.createDataFrame([(1, 0, said)], "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    row = aligned.monotone_alignment(spark, str(tmp_path)).first()
    assert row["similarity"] == round(similarity.ratio(said, said.replace(" the ", " ")), 4) < 1
