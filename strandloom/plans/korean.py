"""Queries of the functions on Korean text, over the turns of conversations as Korean utterances."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandloom.functions import text
from strandloom.plans.registry import query
from strandloom.plans.tables import UTT, table, utterances

_ALIGNED = r"trim(regexp_replace(regexp_replace(ko, '>>+', ' ', 'g'), '\s+', ' ', 'g'))"
for _forms, _to in text.ALIGNED_FORMS:
    _ALIGNED = f"regexp_replace({_ALIGNED}, '{_forms}', '{_to}', 'gi')"


def _first(word: str, endings: tuple[str, ...], least: int = 2) -> str:
    """SQL for the length of the first ending that fits, 0 if none does."""
    return "CASE " + " ".join(f"WHEN ends_with({word}, '{e}') AND length({word}) >= {len(e) + least} THEN {len(e)}" for e in endings) + " ELSE 0 END"


def _cut(word: str, endings: tuple[str, ...]) -> str:
    return f"left({word}, length({word}) - ({_first(word, endings)}))"


@query(f"""WITH {UTT} SELECT conv_id, turn, lower({_ALIGNED}) AS aligned FROM utt""")
def alignment_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text as alignment sees it: known misspellings replaced, lower case."""
    return utterances(spark, sf_dir).select("conv_id", "turn", text.aligned_form(F.col("ko")).alias("aligned"))


@query(f"""
WITH {UTT}, w AS (SELECT DISTINCT unnest(regexp_extract_all(ko, '[가-힣]+')) AS w FROM utt) SELECT w, {_cut("w", text.PARTICLES)} AS bare FROM w
""")
def particle_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words without their particles, the first in the list's order that fits."""
    w = utterances(spark, sf_dir).select(F.explode(F.regexp_extract_all("ko", F.lit("([가-힣]+)"), 1)).alias("w")).distinct()
    return w.select("w", text.strip_particle(F.col("w")).alias("bare"))


def _level(stem: str) -> str:
    parts = []
    for e in text.SUFFIXES:
        parts.append(f"WHEN ends_with({stem}, '{e}') AND length({stem}) >= {len(e) + 2} THEN '{e}'")
        if len(e) > 1:
            parts.append(f"WHEN ends_with({stem}, '{e}') THEN '!'")
    return "CASE " + " ".join(parts) + " END"


_S = "CASE WHEN {e} = '!' THEN '' WHEN {e} IS NULL THEN {s} ELSE left({s}, length({s}) - length({e})) END"


@query(f"""
WITH {UTT}, w AS (SELECT DISTINCT unnest(regexp_extract_all(ko, '[가-힣]+')) AS w FROM utt),
a AS (SELECT w, {_level("w")} AS e1 FROM w), b AS (SELECT *, {_S.format(e="e1", s="w")} AS s1 FROM a),
c AS (SELECT *, CASE WHEN e1 IS NOT NULL THEN CASE WHEN e1 = '!' THEN '!' ELSE {_level("s1")} END END AS e2 FROM b), d AS (SELECT *, {_S.format(e="e2", s="s1")} AS s2 FROM c),
f AS (SELECT *, CASE WHEN e2 IS NOT NULL THEN CASE WHEN e2 = '!' THEN '!' ELSE {_level("s2")} END END AS e3 FROM d), g AS (SELECT *, {_S.format(e="e3", s="s2")} AS s3 FROM f)
SELECT w, CASE WHEN '!' IN (coalesce(e1, ''), coalesce(e2, ''), coalesce(e3, '')) THEN '' ELSE s3 END AS stem, CASE WHEN '!' IN (coalesce(e1, ''), coalesce(e2, ''), coalesce(e3, '')) THEN w ELSE coalesce(e3, '') || coalesce(e2, '') || coalesce(e1, '') END AS suffix FROM g
""")
def suffix_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words as stem and endings, split off up to three times."""
    w = utterances(spark, sf_dir).select(F.explode(F.regexp_extract_all("ko", F.lit("([가-힣]+)"), 1)).alias("w")).distinct()
    return text.split_suffix(w, "w")


_TOKENS = f"list_filter(list_transform(regexp_extract_all(ko, '[A-Za-z][A-Za-z0-9.+#/_-]*|[가-힣]{{2,}}|\\d+(?:\\.\\d+)?%?'), lambda t: CASE WHEN regexp_matches(t, '^[가-힣]') THEN {_cut('t', text.GROUNDING_PARTICLES)} ELSE lower(t) END), lambda t: length(t) >= 2)"


@query(f"""
WITH {UTT}, t AS (SELECT *, {_TOKENS} AS toks, lower(coalesce(lag(ko) OVER (PARTITION BY conv_id ORDER BY turn), '')) AS src FROM utt)
SELECT conv_id, turn, len(toks)::BIGINT AS n_tokens, round(CASE WHEN len(toks) = 0 THEN 0 ELSE len(list_filter(toks, lambda x: contains(src, x))) / len(toks) END, 6) AS ratio FROM t
""")
def grounding_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of an utterance's tokens that the one before supports, repeats counted."""
    before = F.coalesce(F.lag("ko").over(Window.partitionBy("conv_id").orderBy("turn")), F.lit(""))
    u = utterances(spark, sf_dir).withColumn("src", before)
    return u.select("conv_id", "turn", F.size(text.grounding_tokens(F.col("ko"))).cast("long").alias("n_tokens"), F.round(text.grounding_ratio(F.col("ko"), F.col("src")), 6).alias("ratio"))


@query(f"""
WITH {UTT} SELECT conv_id, turn, CASE WHEN trim(ko) = '' THEN 'empty' WHEN len(list_filter(regexp_extract_all(ko, '[\\x{{3400}}-\\x{{4dbf}}\\x{{4e00}}-\\x{{9fff}}]'), lambda c: turn % 2 = 0 OR c <> '漢')) >= 2 THEN 'unexpected_han_characters' WHEN len(regexp_extract_all(ko, '[가-힣ㄱ-ㅎㅏ-ㅣ]')) < 2 THEN 'insufficient_hangul' ELSE 'ok' END AS status FROM utt
""")
def target_language_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an utterance is Korean; Han characters of its source (here one, in odd turns) are exempt."""
    source = F.when(F.col("turn") % 2 == 1, "漢").otherwise("")
    return utterances(spark, sf_dir).select("conv_id", "turn", text.target_language_status(source, F.col("ko")).alias("status"))


_PLAIN = "ko"
for _q in text.QUOTED:
    _PLAIN = f"regexp_replace({_PLAIN}, '{_q.replace(chr(39), chr(39) * 2)}', ' ', 'g')"
_CASUAL = ", ".join(f"CASE WHEN regexp_matches(p, '(^|[^가-힣]){pattern}($|[^가-힣])') THEN '{label}' END" for label, pattern in text.CASUAL_WORDS.items())


@query(f"""
WITH {UTT}, q AS (SELECT conv_id, turn, {_PLAIN} AS p FROM utt)
SELECT conv_id, turn, array_to_string(list_filter([{_CASUAL}, CASE WHEN regexp_matches(p, '{text.CASUAL_ENDING}') THEN '반말 종결' END], lambda x: x IS NOT NULL), ', ') AS violations FROM q
""")
def register_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Casual address and endings outside quotations."""
    return utterances(spark, sf_dir).select("conv_id", "turn", F.array_join(text.register_violations(F.col("ko")), ", ").alias("violations"))


_FAMILIES = ", ".join(f"CASE WHEN regexp_matches(c, '{'|'.join(stems)}') THEN '{family}' END" for family, stems in text.ACTION_FAMILIES.items())


@query(f"""
WITH {UTT}, c AS (SELECT conv_id, turn, ko, lower(regexp_replace(ko, '\\s+', '', 'g')) AS c FROM utt), f AS (SELECT *, list_filter([{_FAMILIES}], lambda x: x IS NOT NULL) AS fam FROM c)
SELECT conv_id, turn, array_to_string(fam, ',') AS families, len(fam) > 0 AND regexp_matches(ko, '{text.DIRECT_CUE}') AND NOT (regexp_matches(ko, '{text.CONCEPT_CUE}') AND NOT regexp_matches(ko, '{text.STRONG_CUE}')) AS worthy FROM f
""")
def action_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten verb families an utterance shows, and whether it is worth a step: a direct cue and no mere concept."""
    ko = F.col("ko")
    return utterances(spark, sf_dir).select("conv_id", "turn", F.array_join(text.action_families(ko), ",").alias("families"), text.action_worthy(ko).alias("worthy"))


@query(f"""
WITH {UTT}, s AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'A Motion Graphic with a sound effect' ELSE 'plain' END AS src, ko || ' 컨텐츠 동영상 그래픽, 모션 그래픽스와 소리 효과, 음향 효과 ' AS o FROM utt),
g AS (SELECT *, replace(replace(o, '컨텐츠', '콘텐츠'), '워크 플로우', '워크플로우') AS o1 FROM s), m AS (SELECT *, CASE WHEN contains(lower(src), 'motion graphic') THEN replace(replace(o1, '동영상 그래픽', '모션 그래픽'), '모션 그래픽스', '모션 그래픽') ELSE o1 END AS o2 FROM g)
SELECT conv_id, turn, trim(CASE WHEN contains(lower(src), 'sound effect') THEN replace(replace(o2, '소리 효과', '사운드 효과'), '음향 효과', '사운드 효과') ELSE o2 END) AS rewritten FROM m
""")
def source_conditioned_rewrites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of an output that change only where its source names them."""
    source = F.lower(F.when(F.col("turn") % 2 == 0, "A Motion Graphic with a sound effect").otherwise("plain"))
    out = F.concat("ko", F.lit(" 컨텐츠 동영상 그래픽, 모션 그래픽스와 소리 효과, 음향 효과 "))
    return utterances(spark, sf_dir).select("conv_id", "turn", text.source_conditioned(source, out).alias("rewritten"))


#: What makes an utterance suspicious, and how much it adds. Each is found where a pattern matches.
SIGNALS = (
    ("malformed_korean_join", 4.0, r"[가-힣]+(해서|하여|하면|하며|때|보시면|선택한|참고로)이(\s|$)|은은|는는|이가가|을을|를를|을를|를을|에서에서|으로로|와과|과와"),
    ("attached_token_boundary_artifact", 4.0, r"[가-힣]+(하게|스럽게|답게|롭게)이\s+[가-힣A-Za-z]"),
    ("attached_token_boundary_candidate", 4.0, r"(^|[^가-힣])[가-힣]+(데|게|고|지만|는데)이\s+[가-힣A-Za-z]"),
    ("broken_korean_compound", 3.0, r"[가-힣]{2,}\s+급수적(인|으로|이다|입니다)?"),
    ("loanword_semantic_duplication", 3.0, r"(AI|LLM|MCP)?\s*툴이\s+도구"),
    ("unusual_korean_connective_sequence", 4.0, r"[가-힣]+워고(\s|$)"),
    ("short_technical_modifier_needs_context_review", 3.0, r"(^|[^가-힣])[가-힣]{2}\s+구조(에|가|는|를|의|\s)"),
    ("contextually_unusual_action_verb", 3.0, r"살짝\s+[가-힣]{2,5}\s+보는"),
    ("past_demonstration_verb_needs_review", 3.0, r"처음\s+[가-힣]{3,8}(던|었던)\s+것"),
)
LATIN_FUSION = "[A-Za-z][A-Za-z0-9+./-]*(그인|포넌트|퍼티|이어|큰)(은|는|이|가|을|를|도)?"
UNITS = "년|월|일|개|번|단계|시간|분|초|원"
KIT, KIT_CONTEXT = r"[가-힣]{2,}\s+(UI\s+)?키트(라든지|라고|를|은|는)?", r"UI|디자인\s*시스템|오픈\s*소스|컴포넌트"
ACRONYM = "[A-Z][A-Z0-9]{1,4}"

_SIGNALS_SQL = ", ".join(f"CASE WHEN regexp_matches(ko, '{p}') THEN {{'s': '{name}', 'w': {w}}} END" for name, w, p in SIGNALS)


@query(f"""
WITH {UTT}, tok AS (SELECT conv_id, turn, unnest(regexp_extract_all(ko, '[가-힣]{{2,}}|[A-Za-z][A-Za-z0-9+./-]*')) AS t FROM utt), freq AS (SELECT conv_id, lower(t) AS k, count(*) AS n FROM tok GROUP BY 1, 2),
lex AS (SELECT tok.conv_id, turn, round(5.0 * count(*) FILTER (WHERE n = 1) / count(*), 6) AS lexical FROM tok JOIN freq ON freq.conv_id = tok.conv_id AND freq.k = lower(tok.t) GROUP BY 1, 2),
acr AS (SELECT conv_id, turn, unnest(list_transform(regexp_extract_all(' ' || regexp_replace(ko, '([^A-Za-z0-9])', '\\1 ', 'g') || ' ', '[^A-Za-z0-9]({ACRONYM})[^A-Za-z0-9]', 1), lambda x: x)) AS a FROM utt), acount AS (SELECT conv_id, a, count(*) AS n FROM acr GROUP BY 1, 2),
single AS (SELECT DISTINCT conv_id, turn FROM acr JOIN acount USING (conv_id, a) WHERE n = 1),
near AS (SELECT DISTINCT x.conv_id, x.turn FROM acr x JOIN acr y ON x.conv_id = y.conv_id AND abs(x.turn - y.turn) = 1 AND x.a <> y.a AND length(x.a) = length(y.a) AND levenshtein(x.a, y.a) = 1),
rk AS (SELECT u.*, coalesce(lexical, 0.0) AS lexical, count(*) OVER (PARTITION BY u.conv_id) AS n_rows, row_number() OVER (PARTITION BY u.conv_id, chapter ORDER BY coalesce(lexical, 0.0) DESC, start_s) AS rank FROM utt u LEFT JOIN lex USING (conv_id, turn)),
d AS (SELECT rk.conv_id, rk.turn, lexical, rank, list_filter([{_SIGNALS_SQL},
  CASE WHEN len(list_filter(regexp_extract_all(ko, '[0-9]+([가-힣]{{2,}})', 1), lambda x: NOT regexp_matches(x, '^({UNITS})'))) > 0 OR regexp_matches(ko, '{LATIN_FUSION}') THEN {{'s': 'malformed_script_boundary', 'w': 3.0}} END,
  CASE WHEN regexp_matches(ko, '{KIT}') AND regexp_matches(ko, '{KIT_CONTEXT}') THEN {{'s': 'unverified_official_name_candidate', 'w': 4.0}} END,
  CASE WHEN near.turn IS NOT NULL THEN {{'s': 'acronym_discourse_inconsistency', 'w': 4.0}} END, CASE WHEN single.turn IS NOT NULL THEN {{'s': 'singleton_unregistered_acronym', 'w': 3.0}} END,
  CASE WHEN n_rows >= 8 AND ((rank <= 6 AND lexical >= 1.8) OR lexical >= 3.35) THEN {{'s': 'video_local_lexical_outlier', 'w': 0.0}} END, CASE WHEN lexical >= 3.35 THEN {{'s': 'severe_video_local_lexical_outlier', 'w': 3.0}} END], lambda x: x IS NOT NULL) AS sig
  FROM rk LEFT JOIN near ON near.conv_id = rk.conv_id AND near.turn = rk.turn LEFT JOIN single ON single.conv_id = rk.conv_id AND single.turn = rk.turn)
SELECT conv_id, turn, array_to_string(list_sort(list_transform(sig, lambda x: x.s)), ',') AS signals, round(lexical + list_sum(list_transform(sig, lambda x: x.w::DOUBLE)), 4) AS score, rank FROM d WHERE len(sig) > 0
""")
def suspicious_utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Utterances with signals of bad recognition: patterns, rare words of the conversation, acronyms once or one letter from a neighbour's."""
    return text.suspicion(utterances(spark, sf_dir), "conv_id", "turn", "chapter", "start_s", "ko", SIGNALS, LATIN_FUSION, UNITS, KIT, KIT_CONTEXT, ACRONYM)


_NAMES = ("Claude Code", "Whisper")


@query(f"""WITH {UTT} SELECT conv_id, turn, regexp_replace(regexp_replace(ko || ' Whisper (whisper), Claude  Code(Claude  Code)', 'Claude\\s+Code', 'Claude Code', 'gi'), '(Claude Code|Whisper)\\s*\\(\\s*(Claude Code|Whisper)\\s*\\)', '\\1', 'gi') AS named FROM utt""")
def official_name_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Official names in one spelling, and a name repeated in brackets once."""
    out = F.concat("ko", F.lit(" Whisper (whisper), Claude  Code(Claude  Code)"))
    return utterances(spark, sf_dir).select("conv_id", "turn", text.official_names(out, _NAMES).alias("named"))


@query(f"""
WITH {UTT}, s AS (SELECT conv_id, turn, unnest(list_filter(string_split(regexp_replace(trim(ko), '([.!?。！？])\\s+', '\\1' || chr(10), 'g'), chr(10)), lambda x: trim(x) <> '')) AS x FROM utt)
SELECT conv_id, turn, count(*) AS n_sentences, sum(length(trim(x)))::BIGINT AS n_chars FROM s GROUP BY 1, 2
""")
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of an utterance: cut after closing marks."""
    x = F.filter(F.transform(F.split(F.trim("ko"), r"(?<=[.!?。！？])\s+|\n+"), lambda v: F.trim(v)), lambda v: v != "")
    return utterances(spark, sf_dir).select("conv_id", "turn", F.explode(x).alias("x")).groupBy("conv_id", "turn").agg(F.count("*").alias("n_sentences"), F.sum(F.char_length("x")).alias("n_chars"))


@query()
def jamo_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words as their letters, and how far they are from a protected term by letters."""
    w = utterances(spark, sf_dir).select(F.explode(F.regexp_extract_all("ko", F.lit("([가-힣]{2,})"), 1)).alias("w")).distinct()
    return w.select("w", text.jamo(F.col("w")).alias("letters"), F.round(text.phonetic_ratio(F.col("w"), F.lit("프로젝트")), 6).alias("ratio"))
