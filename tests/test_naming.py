"""Mentions, issues and protected rewrites against regular expressions one after another, and by hand."""

import random
import re

from pyspark.sql import functions as F

from strandloom.functions import repairs
from strandloom.operators import naming as n

FORMS = [("Claude Code", "Claude Code"), ("Claude", "Claude"), ("Code Lab", "Code Lab"), ("HyperFrames", "hyper frames"), ("C++", "C++"), (".NET", ".NET"), ("AI", "AI"), ("A B", "A B"), ("B C D", "B C D")]


def forms(spark, rows=FORMS):
    return spark.createDataFrame(rows, "name string, form string")


def test_mentions_are_those_of_each_pattern_by_itself(spark):
    rnd = random.Random(2)
    parts = ["Claude", "claude", "Code", "Lab", "hyper frames", "C++", ".NET", "AI", "A", "B", "C", "D", " ", " ", " ", "-", ".", "가", "  ", "x"]
    texts = [("".join(rnd.choice(parts) for _ in range(rnd.randint(0, 25)))) for _ in range(300)] + [None, ""]
    rows = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "i int, t string, run string")
    got = {(r["i"], r["name"], r["start"], r["end"]) for r in n.mentions(rows, ["i"], "t", forms(spark)).collect()}
    want = set()
    for i, t in enumerate(texts):
        for name, form in FORMS:
            for m in re.finditer(rf"(?<![A-Za-z0-9])(?={re.escape(form)}(?![A-Za-z0-9]))", t or "", re.I):
                want.add((i, name, m.start(), m.start() + len(form)))
    assert got == want and len(want) > 150


def issues(spark, *pairs):
    rows = spark.createDataFrame([(i, s, o) for i, (s, o) in enumerate(pairs)], "i int, s string, o string")
    out = {i: [] for i in range(len(pairs))}
    for r in n.name_issues(rows, ["i"], "s", "o", forms(spark)).collect():
        out[r["i"]].append((r["kind"], r["what"]))
    return [sorted(out[i]) for i in range(len(pairs))]


def test_issues_by_hand(spark):
    got = issues(
        spark,
        ("use Claude Code now", "Claude Code를 씁니다"),
        ("use Claude Code now", "claude code를 씁니다"),
        ("use hyper frames and C++", "HyperFrames와 도구"),
        ("see claude.ai and /Claude/x", "사이트를 봅니다"),
        ("AI and B C D", "그것"),  # an abbreviation, and a name of three words
        ("x", "Like가 좋은 case, Don't API Wow MP4 x.y"),
        ("do it for me", "합니다"),
        ("do it for me just because yeah", "저를 위해 하기 때문입니다"),
        (None, None),
    )
    assert got[0] == []
    assert got[1] == [("misspelt_name", "Claude"), ("misspelt_name", "Claude Code")]
    assert got[2] == [("missing_name", "C++")]
    assert got[3] == got[4] == got[8] == []
    assert got[5] == [("leak", "Like"), ("leak", "case"), ("untranslated", "Don"), ("untranslated", "Like"), ("untranslated", "Wow"), ("untranslated", "case"), ("untranslated", "x.y")]
    assert got[6] == [("lost_beneficiary", "for me")] and got[7] == [("invented_cause", "just because")]


def around(spark, rewrite, *texts):
    rows = spark.createDataFrame([(i, t, "kept") for i, t in enumerate(texts)], "i int, t string, _body string")
    got = n.rewritten_around_names(rows, ["i"], "t", forms(spark), rewrite).orderBy("i").collect()
    assert all(r["_body"] == "kept" for r in got)
    return [r["rewritten"] for r in got]


def test_names_survive_every_rule_set(spark):
    upper = lambda c: F.upper(F.regexp_replace(c, "[aeiou]", "*"))
    assert around(spark, upper, "use claude code and hyper frames", "__ENT001__ Claude __LIT001__", "1 Claude", None, "none at all") == [
        "*S* Claude Code *ND HyperFrames", "__ENT001__ Claude __LIT001__", "1 Claude", "", "N*N* *T *LL",
    ]
    said = "미드전니 Claude Code 변경해서이 Claude 음 API"
    assert around(spark, lambda c: repairs.repaired_spacing(c)[0], said) == [said]  # a name's place isn't a word that a join needs behind it
    assert around(spark, lambda c: repairs.cleaned_up(c)[0], said) == ["미드전니 Claude Code 변경해서이 Claude API"]


def test_restored_duplicates_go(spark):
    swap = lambda a, b: lambda c: F.regexp_replace(c, a, b)
    assert around(spark, swap("X", "Code"), "Claude Code X here", "Claude Code 코드를 봅니다") == ["Claude Code here", "Claude Code를 봅니다"]
    assert around(spark, swap("=", ""), "Claude=스는 좋다", "Claude= Claude", "Claude=스 없음") == ["Claude는 좋다", "Claude", "Claude스 없음"]


def test_longest_mention_wins(spark):
    rows = spark.createDataFrame([(1, "Claude Code Lab and A B C D")], "i int, t string")
    spans = n.chosen_spans(n.mentions(rows, ["i"], "t", forms(spark)), ["i"]).first()["spans"]
    assert [(s["start"], s["end"], s["name"]) for s in spans] == [(0, 11, "Claude Code"), (22, 27, "B C D")]


def test_texts_are_neither_numbered_by_shuffle_nor_sent_along_with_mentions(spark):
    rows = spark.createDataFrame([(1, "Claude Code Lab")], "i int, t string")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    found = plan(n.mentions(rows, ["i"], "t", forms(spark)))
    assert "Window" not in found and found.count("Join") == 2  # with the forms and, once a row, with its text
    assert plan(n.rewritten_around_names(rows, ["i"], "t", forms(spark), F.upper)).count("Join") == 2
    assert plan(n.name_issues(rows, ["i"], "t", "t", forms(spark))).count("Join") == 4


def test_names_behind_themselves_in_any_case_and_across_blanks(spark):
    texts = ("Claude\n\tClaude x", "Claude Claude Claude", "CLAUDE CODE code", "Claude Code Claude  Code", "AI ai,AI", "A B  b", "C++ c")
    assert around(spark, lambda c: c, *texts) == ["Claude x", "Claude", "Claude Code", "Claude Code Claude Code", "AI,AI", "A B", "C++ c"]


def test_places_are_in_characters_whatever_the_gaps_hold(spark):
    rows = spark.createDataFrame([(1, "😀|한글|AI | 😀 C++|x"), (2, "|"), (3, "AI|AI")], "i int, t string")
    got = sorted((r["i"], r["form"], r["start"], r["end"]) for r in n.mentions(rows, ["i"], "t", forms(spark)).collect())
    assert got == [(1, "AI", 5, 7), (1, "C++", 12, 15), (3, "AI", 0, 2), (3, "AI", 3, 5)]
