"""Contracts of answers, error by error."""

import json

from strandloom.operators import contracts as c
from strandloom.plans import catalogue

GOOD = {"start_utterance_id": "U1", "role": "learning", "confidence": 0.5, "needs_review": False, "title": "t", "summary": "s", "boundary_reason": "b"}
AD = {"start_utterance_id": "U2", "role": "promotion", "confidence": 1, "needs_review": True}


def found(spark, contract, *answers):
    raw = [(i, a if isinstance(a, str) or a is None else json.dumps(a)) for i, a in enumerate(answers)]
    df = spark.createDataFrame(raw, "i int, raw string")
    return [r["e"] for r in df.select("i", c.answer_errors(df["raw"], contract).alias("e")).orderBy("i").collect()]


def without(d, *keys, **more):
    return {k: v for k, v in d.items() if k not in keys} | more


def test_segmentation(spark):
    s = lambda *sections, **more: {"sections": list(sections), "warnings": []} | more
    got = found(
        spark, c.SEGMENTATION,
        s(GOOD, AD), " ", "```json {}```", "{", "[1]", None, {}, s(), s(GOOD, warnings=[1], more=2), {"sections": 3, "warnings": []},
        s(GOOD, 7, without(AD, "role", "confidence", title="x")), s(without(GOOD, "summary", title=" ", confidence=1.5, needs_review="no")), s(AD | {"end_seconds": 4, "kind": 1, "reason": 2}), s(AD | {"role": 5}), s(AD | {"confidence": True}),
    )
    assert got[:6] == [[], ["response_text_is_empty"], ["markdown_fence_is_forbidden"], ["response_must_be_one_exact_json_object"], ["response_root_must_be_an_object"], ["response_text_is_empty"]]
    assert got[6] == ["missing_top_level_fields:sections,warnings", "sections_must_be_a_list"]
    assert got[7] == ["sections_must_not_be_empty"]
    assert got[8] == ["unknown_top_level_fields:more", "warnings_must_be_a_list_of_strings"]
    assert got[9] == ["sections_must_be_a_list"]
    assert got[10] == ["sections[1]:must_be_an_object", "sections[2]:missing_fields:confidence,role"]
    assert got[11] == ["sections[0]:missing_fields:summary", "sections[0]:confidence_must_be_between_0_and_1", "sections[0]:needs_review_must_be_boolean", "sections[0]:title_must_be_a_nonempty_string"]
    assert got[12] == ["sections[0]:model_end_or_time_fields_forbidden:end_seconds", "sections[0]:model_kind_field_forbidden", "sections[0]:separate_reason_field_forbidden", "sections[0]:unknown_fields:end_seconds,kind,reason"]
    assert got[13] == ["sections[0]:unsupported_role"] and got[14] == ["sections[0]:confidence_must_be_between_0_and_1"]


def test_role_audit(spark):
    d = lambda a, b, **more: {"has_learning_block": a, "has_non_learning_block": b, "confidence": 0.9} | more
    t = lambda i, kind, **more: {"start_utterance_id": i, "class": kind} | more
    ask = lambda *xs: {"decisions": list(xs)}
    got = found(
        spark, c.ROLE_AUDIT,
        ask(d(True, False), d(False, True, non_learning_role="giveaway"), d(True, True, transitions=[t("a", "learning"), t("b", "non_learning", role="other_non_learning")])),
        ask(d(False, False, transitions=3)), ask(d(True, 1)), ask(d(False, True)), ask(d(False, True, non_learning_role="ad")), ask(d(True, True)),
        ask(d(True, True, transitions=[t("a", "learning"), t("b", "learning", role="giveaway"), t(" ", "x")])), ask(d(True, False, transitions=[])), ask(d(True, True, transitions=[])),
    )
    p = "decisions[0]"
    assert got[0] == []
    assert got[1] == [f"{p}:both_presence_flags_cannot_be_false"]
    assert got[2] == [f"{p}:has_non_learning_block_must_be_boolean"]
    assert got[3] == [f"{p}:missing_fields:non_learning_role"]
    assert got[4] == [f"{p}:non_learning_role_must_be_allowed"]
    assert got[5] == [f"{p}:missing_fields:transitions", f"{p}:transitions_must_be_a_list"]
    assert got[6] == [
        f"{p}.transitions[1]:unknown_fields:role", f"{p}.transitions[2]:start_utterance_id_must_be_a_nonempty_string", f"{p}.transitions[2]:unsupported_class",
        f"{p}.transitions[1]:consecutive_values_must_alternate", f"{p}:mixed_transitions_must_cover_both_classes",
    ]
    assert got[7] == [f"{p}:unknown_fields:transitions"] and got[8] == [f"{p}:transitions_must_not_be_empty"]


def test_editorial(spark):
    r = {"utterance_id": "U1", "decision": "repair", "confidence": "high", "corrected_text": "x", "changes": [{"from": "a", "to": "b", "reason": "c"}]}
    got = found(spark, c.EDITORIAL, {"reviews": [r, {"utterance_id": "U2", "decision": "keep", "confidence": "low"}]}, {"reviews": [without(r, "changes"), r | {"changes": [{"from": "", "to": "b"}]}, r | {"decision": "drop"}]})
    assert got[0] == []
    assert got[1] == [
        "reviews[0]:missing_fields:changes", "reviews[0]:changes_must_be_a_list", "reviews[1].changes[0]:missing_fields:reason", "reviews[1].changes[0]:from_must_be_a_nonempty_string", "reviews[2]:unsupported_decision",
    ]


def test_query_tells_paths(spark):
    rows = catalogue.QUERIES["segmentation_contract"](spark, "/root/testdata/sf0.001").collect()
    kinds = {r["error"].split(":")[1] if r["error"].startswith("sections[") else r["error"].split(":")[0] for r in rows}
    assert {"markdown_fence_is_forbidden", "missing_top_level_fields", "missing_fields", "unknown_fields", "unsupported_role", "confidence_must_be_between_0_and_1"} <= kinds


def test_an_answer_is_parsed_once(spark):
    df = spark.createDataFrame([("{}",)], "raw string")
    said = df.select(c.answer_errors(df["raw"], c.SEGMENTATION))._jdf.queryExecution().analyzed().expressions().toString()
    assert said.count("parse_json(") <= 2  # once in the expression, once in the name of its column
