"""Values worked out by hand from the rules' definitions."""

from pyspark.sql import functions as F

from strandloom.functions import text as t


def said(spark, column, *texts):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i long, x string")
    return [r[0] for r in df.orderBy("i").select(column(F.col("x"))).collect()]


def test_stems(spark):
    words = ("running", "sing", "workers", "worker", "ester", "bodies", "quickly", "directed", "Directly", "cars", "papers", "ly")
    assert said(spark, t.stem_en, *words) == ["running", "sing", "worker", "worker", "ester", "bodie", "quick", "direct", "direct", "cars", "paper", "ly"]


def test_particles_in_the_order_of_the_list(spark):
    # 으로 comes before 로; 서울에서는 loses 에서는; a stem keeps two characters
    assert said(spark, t.strip_particle, "서울에서는", "집으로", "학교로", "나는", "우리 들에게", "사람들을") == ["서울", "집으로", "학교로", "나는", "우리", "사람"]


def test_suffixes_split_up_to_three_times(spark):
    df = spark.createDataFrame([("모델들에게",), ("확인했습니다",), ("가까지",), ("나이",), ("API",), ("서울까지만",)], "w string")
    got = {r["w"]: (r["stem"], r["suffix"]) for r in t.split_suffix(df, "w").collect()}
    assert got == {"모델들에게": ("모델들", "에게"), "확인했습니다": ("확인", "했습니다"), "가까지": ("", "가까지"), "나이": ("나이", ""), "API": ("API", ""), "서울까지만": ("서울", "까지만")}


def test_grounding(spark):
    assert said(spark, t.grounding_tokens, "API API 키를 프로젝트에서 3.5% 7 x") == [["api", "api", "키를", "프로젝트", "3.5%"]]
    df = spark.createDataFrame([("API API 도구", "the api here"), ("", "x")], "a string, b string")
    assert [r[0] for r in df.select(t.grounding_ratio(F.col("a"), F.col("b"))).collect()] == [2 / 3, 0.0]


def test_register(spark):
    texts = ("너무 좋습니다.", "너는 갑니다.", "당신의 것입니다.", '그는 "내가 할게"라고 했습니다.', "내가 할게.", "이건 내 거야")
    assert said(spark, t.register_violations, *texts) == [[], ["너/너는"], ["당신"], [], ["내가", "반말 종결"], ["반말 종결"]]


def test_target_language(spark):
    df = spark.createDataFrame([("", "漢字 글자"), ("漢", "漢字 글자"), ("", "한 a"), ("", "  "), ("", "글자")], "s string, o string")
    assert [r[0] for r in df.select(t.target_language_status(F.col("s"), F.col("o"))).collect()] == ["unexpected_han_characters", "ok", "insufficient_hangul", "empty", "ok"]


def test_actions(spark):
    assert said(spark, t.action_families, "버튼을 누르고 파일을 저장", "붙여 놓고 확인") == [["click", "change"], ["input", "verify"]]
    assert said(spark, t.action_worthy, "버튼을 누르는 이유", "저장하는 이유", "파일을 저장합니다", "생각합니다") == [True, False, True, False]


def test_aligned_form(spark):
    assert said(spark, t.aligned_form, ">> 미드전니  쇼트", "세리프 무드을") == ["미드저니 쇼츠", "sref 무드를"]
