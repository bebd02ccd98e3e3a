"""The tables as the roles that operators know: segments, chapters, utterances."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """A table for costly work in Python: one of fewer partitions than there are cores is dealt over them, any other stays as it is.

    With keys, rows of equal keys stay together, and a grouping by the keys needs no other shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df


def pieces(df: DataFrame) -> int:
    """Into how many parts a table of narrow rows is dealt by key: their number grows with its files, so that a task holds no more of a larger table.

    Given to repartition, as partitions that Spark chooses are joined into fewer and larger ones.
    """
    return 8 * df.rdd.getNumPartitions()


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timed segments of each user's stream: start, and an end `value` minutes later; an error ends a sentence, a signup is a new speaker."""
    start = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)") / F.lit(1e6)
    seg = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value", start.alias("start_s"))
    return seg.withColumn("end_s", F.col("start_s") + F.col("value") * 60)


SEG = """seg AS (SELECT user_id, event_id, event_type, value, epoch_us(ts) / 1e6 AS start_s, epoch_us(ts) / 1e6 + value * 60 AS end_s FROM events)"""


def chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's signups as chapter starts."""
    return segments(spark, sf_dir).where("event_type = 'signup'").select("user_id", F.col("event_id").alias("chapter_id"), "start_s")


CHAP = "chap AS (SELECT user_id, event_id AS chapter_id, start_s, lead(start_s) OVER (PARTITION BY user_id ORDER BY start_s, event_id) AS end_s FROM seg WHERE event_type = 'signup')"


#: Invented Korean clauses: each turn of a conversation ends with two of them, so that rules on Korean text have something to find.
CLAUSES = (
    "메뉴를 클릭하고 파일을 저장합니다.", "여기서 이유를 설명하겠습니다.", "화면은은 조금 다릅니다", "설정을 변경해서이 진행합니다.", "AI 도구를 실행하고 결과를 확인해요.",
    "너는 이 버튼을 누르면 돼.", "당신의 프로젝트를 만들어 봅시다.", "미드전니 모델을 씁니다.", "API 키를 입력하세요.", "APX 키를 복사해 붙여 주세요.",
    "데이터 구조를 봅니다 개념 설명", "처음 보여주던 것 그대로 둡니다.", "살짝 건드려 보는 단계입니다.", "우리 디자인 키트라고 부릅니다 UI", "컴퓨터워고 그래서",
    "정확하게이 움직입니다 그리고", "하는데이 계속합니다 우리", "3가지나 있는 항목입니다.", "버튼을 봅니다 Plug그인은 켭니다.", "전문 급수적인 내용입니다.",
    "AI 툴이 도구를 부릅니다.", "클릭 연습을 저장했어요 파일에서는.", "무드을 고르고 쇼트 길이를 맞춥니다.", "漢字語 두 글자", '그는 "내가 할게"라고 말했습니다.', "그냥 평범한 문장이에요", "모델들에게 프로젝트하였습니다 저장소까지만",
    "클로드 API 설정입니다.", "Claude APX 값을 봅니다.", "클루드 화면을 엽니다.", "프롬 푸트 예시입니다.", "프롬프트 창을 엽니다.", "민즈님 안녕하세요.", "노션 화면입니다.", "노선을 켭니다.",
)


def utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as timed utterances (conv_id, turn, chapter, start_s, end_s, ko, text): ten seconds apart, three to a chapter; text is the turn's own, ko has two Korean clauses behind it."""
    n = len(CLAUSES)
    clauses = F.array(*map(F.lit, CLAUSES))
    pick = lambda i: F.element_at(clauses, (i % n + 1).cast("int"))
    ko = F.concat(F.coalesce("text", F.lit("")), F.lit(" "), pick(F.col("conv_id") * 5 + F.col("turn") * 3), F.lit(" "), pick(F.col("conv_id") * 7 + F.col("turn") * 11 + 4))
    start = F.col("turn") * 10.0
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.expr("turn div 3").alias("chapter"), start.alias("start_s"), (start + 4 + F.col("turn") % 4).alias("end_s"), ko.alias("ko"), "text")


_LIST = "[" + ", ".join(f"'{c}'" for c in CLAUSES) + "]"
UTT = f"""utt AS (SELECT conv_id, turn, turn // 3 AS chapter, turn * 10.0::DOUBLE AS start_s, (turn * 10.0 + 4 + turn % 4)::DOUBLE AS end_s, coalesce(text, '') || ' ' || {_LIST}[(conv_id * 5 + turn * 3) % {len(CLAUSES)} + 1] || ' ' || {_LIST}[(conv_id * 7 + turn * 11 + 4) % {len(CLAUSES)} + 1] AS ko, text FROM conversations)"""
