"""Repairs of recognised text, by hand and against plain Python over a whole table."""

import re

import pytest
from pyspark.sql import functions as F

from strandloom.functions import repairs
from strandloom.plans import catalogue

SF_DIR = "/root/testdata/sf0.001"
AHEAD = r"(?=\s+[가-힣A-Za-z])"


def spaced(text):
    changes = []

    def note(reason, ending, gone=1):
        def sub(m):
            found = m.group(0)
            to = found[: len(found) - gone] + ending if gone else found[: len(found) // 2]
            changes.append((found, to, reason))
            return to

        return sub

    for pattern, reason, ending, gone in (
        ("[가-힣]+(?:해서|하여|하면|하며|때|보시면|선택한|참고로)이" + AHEAD, "korean_bound_determiner_spacing", " 이", 1),
        ("[가-힣]+(?:하게|스럽게|답게|롭게)이" + AHEAD, "korean_attached_boundary_artifact", "", 1),
        ("(?<![가-힣])[가-힣]+(?:데|게|고|지만|는데)이" + AHEAD, "korean_discourse_boundary_artifact", " 이", 1),
        ("은은|는는|을을|를를|에서에서|으로로", "duplicated_korean_particle", "", 0),
        ("[가-힣]+고음" + AHEAD, "asr_filler_after_connective", ",", 1),
    ):
        text = re.sub(pattern, note(reason, ending, gone), text)
    return re.sub(r"\s{2,}", " ", re.sub(r"\s+([,.!?])", r"\1", text)).strip(), changes


def on(spark, column, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, x string")
    return [r[1] for r in df.select("i", column(F.col("x"))).orderBy("i").collect()]


HARD = ("클릭하면이 가하면이 나", "변경해서이 진행하면이  끝 .", "정확하게이 움직이고음 Go 그는는 집으로로 하는데이 a", "가을을을 에서에서에서", "하면이", "", "하는데이　우리")


def test_neighbouring_joins(spark):
    got = on(spark, lambda c: repairs.repaired_spacing(c)[0], *HARD)
    assert got[0] == "클릭하면 이 가하면 이 나" and got == [spaced(x)[0] for x in HARD]
    changes = on(spark, lambda c: repairs.repaired_spacing(c)[1], *HARD)
    assert [[(c["from"], c["to"], c["reason"]) for c in row] for row in changes] == [spaced(x)[1] for x in HARD]


def test_spacing_query_matches_plain_python(spark):
    from strandloom.plans.tables import utterances

    texts = {(r["conv_id"], r["turn"]): r["ko"] for r in utterances(spark, SF_DIR).collect()}
    rows = catalogue.QUERIES["spacing_repairs"](spark, SF_DIR).collect()
    assert len(rows) == len(texts) and sum(r["n_changes"] for r in rows) > 20
    for r in rows:
        text, changes = spaced(texts[r["conv_id"], r["turn"]])
        assert (r["repaired"], r["n_changes"]) == (text, len(changes))


@pytest.mark.parametrize(
    "said, found",
    [
        ("click Save.", ["Save"]),
        ("Then select open source and click Export.now right away", ["Export.now"]),
        ("pick sound effect, type hello", ["hello"]),
        ("{slash} command run the tests and open it", ["run the tests"]),
        ("{slash} command one two three four five six.", []),
        ("say launch preview and say Launch Preview.", ["launch preview", "Launch Preview"]),
        ("say it, say it, say go so say once", []),
        ("enter My-App. then choose My-App right", ["My-App"]),
    ],
)
def test_literal_targets(spark, said, found):
    assert on(spark, repairs.literal_targets, said) == [found]
