"""The editorial pass by hand, above all where a row depends on what earlier rows became."""

from collections import defaultdict

from strandloom.functions import hangul as h
from strandloom.operators import editorial as e
from strandloom.plans import catalogue, editorial

SF_DIR = "/root/testdata/sf0.001"
NOTION = e.Name("Notion", pronunciations=("노션",))


def edit(spark, rows, names=(NOTION,), metadata=()):
    df = spark.createDataFrame([(v, p, x, "x") for v, texts in rows.items() for p, x in enumerate(texts)], "v string, p int, x string, _text string")
    m = spark.createDataFrame([(v, i, *r) for i, (v, *r) in enumerate(metadata)], "v string, at int, source string, weight int, text string")
    return {(r["v"], r["p"]): r for r in e.edit_videos(df, m, "v", "p", "x", list(names)).collect()}


def test_a_rewritten_row_is_evidence_for_the_next(spark):
    rows = {"a": ["Notion 화면", "노선을 엽니다", "메뉴", "노선 설정", "값", None, "노선 그대로"], "b": ["노선 화면", "노선을 엽니다"]}
    got = edit(spark, rows)
    assert [got["a", i]["edited"] for i in range(7)] == ["Notion 화면", "Notion을 엽니다", "메뉴", "Notion 설정", "값", "", "노선 그대로"]
    assert [got["b", i]["edited"] for i in range(2)] == rows["b"]  # no row of the other video counts
    assert [tuple(c) for c in got["a", 3]["changes"]] == [("노선", "Notion", "adjacent_dialogue_official_entity_continuity", "nearby_confirmed_entity_and_compatible_pronunciation")]


def test_acronyms_need_a_shared_word(spark):
    got = edit(spark, {"a": ["API 설정을 봅니다", "AP 설정 입력", "그냥 AP 값"], "b": ["API 설정", "ATP 설정", "AP 설정은"]})
    assert [got["a", i]["edited"] for i in (1, 2)] == ["API 설정 입력", "그냥 AP 값"]
    assert got["b", 2]["edited"] == "AP 설정은"  # two longer ones


def test_spacing_comes_first_and_registry_last(spark):
    claude = e.Name("Claude", pronunciations=("클로드",))
    anchored = e.Name("Midjourney", pronunciations=("미드저니",), anchors=("모델",))
    got = edit(spark, {"a": ["설정을 변경해서이 클로드를 씁니다", "미드저니 그림", "미드저니 모델", "미드저나 모델", "미드저니"], "b": ["미드저나 모델"]}, [claude, anchored])
    assert got["a", 0]["edited"] == "설정을 변경해서 이 Claude를 씁니다"
    assert [c["reason"] for c in got["a", 0]["changes"]] == ["korean_bound_determiner_spacing", "verified_registry_pronunciation"]
    # rows 1 and 4 have the anchor within two rows; the misheard name has enough occurrences in its video
    assert [got["a", i]["edited"] for i in (1, 2, 3, 4)] == ["Midjourney 그림", "Midjourney 모델", "Midjourney 모델", "Midjourney"]
    # without evidence of the video it isn't even near
    assert got["b", 0]["edited"] == "미드저나 모델" and got["b", 0]["near"] == []


def test_identity_of_a_channel(spark):
    about = [("a", "channel_title", 7, "김 민지 Minji Kim"), ("b", "channel_title", 7, "민지 Minji"), ("b", "creator_name", 7, "수진 Sujin"), ("c", "channel_title", 7, "조코딩 JoCoding")]
    rows = {"a": ["민즈님 안녕", "민지님 안녕", "김민즈가 왔다", "박수님 안녕"], "b": ["민즈님"], "c": ["조코딩님", "소코딩님"]}
    got = edit(spark, rows, metadata=about)
    assert [got["a", i]["edited"] for i in range(4)] == ["민지님 안녕", "민지님 안녕", "김 민지가 왔다", "박수님 안녕"]
    assert got["b", 0]["edited"] == "민즈님"  # two identities
    assert got["c", 1]["edited"] == "조코딩님" and got["a", 1]["changes"] == []


def test_ambiguous_and_weak_likeness_is_only_noted(spark):
    names = [e.Name("Alpha", pronunciations=("가나다라",), anchors=("화면",)), e.Name("Beta", pronunciations=("가나다러",), anchors=("화면",))]
    about = [("a", "video_title", 4, "Alpha Beta 화면"), ("b", "video_description", 2, "Alpha")]
    got = edit(spark, {"a": ["가나다로 화면"], "b": ["가나다로 화면"]}, names, about)
    assert [tuple(n) for n in got["a", 0]["near"]] == [("가나다로", "ambiguous_registry_near_match", ["Alpha", "Beta"])]
    assert [tuple(n) for n in got["b", 0]["near"]] == [("가나다로", "registry_pronunciation_near_match", ["Alpha"])] and got["b", 0]["changes"] == []


def test_letters():
    assert h.letters("노션 A-b") == "ㄴㅗㅅㅕㄴab" and h.phonetic_ratio("노선", "노션") == 0.2 and h.edits("", "ab") == 2
    assert h.without_particle("학교에서는") == "학교" and h.without_particle("나는") == "나는"


def test_query_runs_each_video_as_one_fold(spark):
    rows = defaultdict(list)
    for r in editorial.videos(spark, SF_DIR).orderBy("video", "pos").collect():
        rows[r["video"]].append((r["pos"], r["ko"]))
    got = catalogue.QUERIES["editorial_changes"](spark, SF_DIR).collect()
    assert {"adjacent_dialogue_official_entity_continuity", "verified_registry_pronunciation", "korean_bound_determiner_spacing", "video_local_person_identity_consistency"} <= {r["reason"] for r in got}
    for r in got:
        if r["reason"] == "verified_registry_pronunciation":
            assert (r["from_text"], r["to_text"]) in {(p, n.name) for n in editorial.NAMES for p in n.pronunciations}
    numbers = defaultdict(list)
    for r in got:
        numbers[r["video"], r["pos"]].append(r["nth_change"])
    assert all(sorted(x) == list(range(1, len(x) + 1)) for x in numbers.values())
    assert set(numbers) <= {(v, p) for v, texts in rows.items() for p, _ in texts}
