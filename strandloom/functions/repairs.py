"""Rewrites of recognised text that are safe by rule, with counts of what each changed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Joins that recognition makes, what takes their place, why, and by which kind of evidence. All but doubled particles have a word behind them.
AHEAD = r"(?=\s+[가-힣A-Za-z])"
SPACING = (
    (r"([가-힣]+(?:해서|하여|하면|하며|때|보시면|선택한|참고로))이", AHEAD, "$1 이", "korean_bound_determiner_spacing", "korean_grammar_rule"),
    (r"([가-힣]+(?:하게|스럽게|답게|롭게))이", AHEAD, "$1", "korean_attached_boundary_artifact", "conservative_korean_adverb_boundary_rule"),
    (r"(?<![가-힣])([가-힣]+(?:데|게|고|지만|는데))이", AHEAD, "$1 이", "korean_discourse_boundary_artifact", "conservative_korean_discourse_boundary_rule"),
    (r"(?:(은)은|(는)는|(을)을|(를)를|(에서)에서|(으)로로)", "", "$1$2$3$4$5$6", "duplicated_korean_particle", "korean_grammar_rule"),
    (r"([가-힣]+고)음", AHEAD, "$1,", "asr_filler_after_connective", "korean_grammar_rule"),
)
CHANGE = "array<struct<`from`:string,`to`:string,reason:string,evidence:string>>"


def repaired_spacing(text: Column) -> tuple[Column, Column]:
    """The text with its joins repaired, and the changes (from, to, reason, evidence): rule by rule, each from left to right."""
    changes = []
    for pattern, ahead, to, reason, evidence in SPACING:
        found = F.regexp_extract_all(text, F.lit(f"(?U)({pattern}){ahead}"), 1)
        changes.append(F.transform(found, _change(f"(?U){pattern}", to, reason, evidence)))
        text = F.regexp_replace(text, f"(?U){pattern}{ahead}", to)
    tidy = F.trim(F.regexp_replace(F.regexp_replace(text, r"(?U)\s+([,.!?])", "$1"), r"(?U)\s{2,}", " "))
    return tidy, F.concat(*changes)


def _change(pattern: str, to: str, reason: str, evidence: str):
    return lambda m: F.struct(m.alias("from"), F.regexp_replace(m, pattern, to).alias("to"), F.lit(reason).alias("reason"), F.lit(evidence).alias("evidence"))


#: Spoken and misheard forms with what stands for them; the second group needs its context.
GENERIC = ((r"\b무드을\b", "무드를"), (r"\b일간된\b", "일관된"), (r"\b요런\b", "이런"), (r"\b끝나는게\b", "끝나는 게"), (r"\b같은게\b", "같은 게"))
CONTEXT = ((r"\b감나\s+뽑는\b", "누구나 뽑는"), (r"\b좀적인\s+비주얼\b", "좀 범용적인 비주얼"), (r"\b임무를\s+내가\s+만든\s+무드에\b", "인물을 내가 만든 무드에"), (r"\b더\s+좋은\s+사실\s+오늘\s+주제는\b", "사실 오늘 주제는"))
EVENT = r"\[[^\]]*\]"
_WORD = "가-힣A-Za-z0-9"
#: What is taken out.
REMOVED = (EVENT, f"(?<![{_WORD}])어\\s+좀\\s+어\\s+좀(?![{_WORD}])", f"(?<![{_WORD}])(?:어|음)(?![{_WORD}])", "(?<![A-Za-z0-9/_.-])A(?![A-Za-z0-9/_.-])")
REPEATED = f"(?U)\\b([{_WORD}]+)(?:\\s+\\1)+\\b"


def cleaned_up(text: Column) -> tuple[Column, Column]:
    """The text without events in brackets, fillers, a lone A and repeated words, with known forms replaced; and the number of changes."""
    n = F.lit(0)
    for pattern in REMOVED:
        n = n + F.regexp_count(text, F.lit(pattern))
        text = F.regexp_replace(text, pattern, " ")
    # one pass leaves no neighbours equal but those that a removal brought together, which the second takes
    for _ in range(2):
        n = n + F.regexp_count(text, F.lit(REPEATED))
        text = F.regexp_replace(text, REPEATED, "$1")
    for pattern, to in GENERIC + CONTEXT:
        n = n + F.regexp_count(text, F.lit(f"(?U){pattern}"))
        text = F.regexp_replace(text, f"(?U){pattern}", to)
    return F.regexp_replace(F.trim(F.regexp_replace(text, r"\s+", " ")), r"\s+([,.!?…])", "$1"), n


_NAME = "[A-Za-z][A-Za-z0-9_.-]*"
#: What leads to a literal target, words that such a target isn't, and marks that it doesn't end with.
SLASH = r"\{slash\}\s*command\s+(.+?)(?=\s+and\s+(?:edit|then|before|after|open|select|type|click)\b|[,.!?]|$)"
CLICK = rf"\b(?:type|enter|click|select|choose|pick)\s+({_NAME}(?:\s+{_NAME}){{0,3}}?)(?=\s+(?:and|then|right|over)\b|[,.!?]|$)"
SAY = rf"\bsay\s+({_NAME}(?:\s+{_NAME}){{0,2}}?)(?=\s+(?:and|so|over|right)\b|[,.!?]|$)"
SPOKEN = ("i", "you", "we", "they", "it", "this", "that", "not")
GENERIC_PHRASES = (
    "worst case", "best case", "sound effect", "sound effects", "motion graphic", "motion graphics", "raw file", "output file", "brand color", "brand kit", "open source",
    "full automatic editing", "automatic editing", "b-roll", "b-rolls", "b roll", "b rolls", "hold on", "all right", "alright", "trust me", "see this", "look at this",
    "by the way", "on the side note", "start to finish", "step by step",
)
MARKS = " \t\n\r.,:;!?()[]{}\"'“”‘’"
NAME_TOKEN = r"([A-Za-z0-9+#_-]+(?:\.[A-Za-z0-9+#_-]+)*)"


def clean_name(value: Column) -> Column:
    """A name with single spaces and without marks around it."""
    return F.btrim(F.regexp_replace(value, r"(?U)\s+", " "), F.lit(MARKS))


def name_tokens(value: Column) -> Column:
    return F.regexp_extract_all(value, F.lit(NAME_TOKEN), 1)


def literal_targets(text: Column) -> Column:
    """What a text tells to run (one to five words), type or click (unless it is a common phrase), or, at least twice, say: the first of each."""
    flat = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    found = lambda p: F.transform(F.regexp_extract_all(flat, F.lit(f"(?i){p}"), 1), lambda v: clean_name(v))
    command = F.filter(found(SLASH), lambda c: F.size(name_tokens(c)).between(1, 5))
    clicked = F.filter(found(CLICK), lambda c: (c != "") & ~F.lower(c).isin(*GENERIC_PHRASES))
    plain = F.filter(found(SAY), lambda s: (F.size(name_tokens(s)) > 0) & ~F.arrays_overlap(name_tokens(F.lower(s)), F.array(*map(F.lit, SPOKEN))))
    low = F.transform(plain, lambda s: F.lower(s))
    twice = F.filter(plain, lambda s: F.size(F.filter(low, lambda o: o == F.lower(s))) >= 2)
    return F.array_distinct(F.concat(command, clicked, twice))


def ownership(name: Column) -> Column:
    """`P by B` and `B’s P` as `B's P`; other names stay."""
    by = F.regexp_extract(name, r"(?i)^(.+?)\s+by\s+(.+)$", 1)
    of = F.regexp_extract(name, r"(?i)^(.+?)\s+by\s+(.+)$", 2)
    return F.when(by != "", F.concat(F.trim(of), F.lit("'s "), F.trim(by))).otherwise(F.regexp_replace(name, r"^(.+?)[’']s\s+(.+)$", "$1's $2"))


def rich_parts(line: Column) -> Column:
    """A line's parts (kind, value): code between backticks, and text."""
    found = F.regexp_extract_all(line, F.lit(r"(`[^`]+`|(?:[^`]|`(?![^`]+`))+)"), 1)
    code = lambda c: c.rlike("(?s)^`[^`]+`$")
    return F.transform(found, lambda c: F.struct(F.when(code(c), "code").otherwise("text").alias("kind"), F.when(code(c), F.regexp_replace(c, "`", "")).otherwise(c).alias("value")))


#: What an output must keep of its source. Numbers may have a currency before and a unit behind.
URL = r"(https?://\S+|www\.\S+)"
FILE = r"\b([\w@+.-]+\.(?:md|markdown|json|csv|txt|py|js|ts|tsx|jsx|html|css|yaml|yml|toml|zip|pdf|fig|mp4|mov|wav|mp3|png|jpg|jpeg|webp|svg))\b"
NUMBER = r"(?<!\w)((?:[$€£¥₩]\s*)?\d+(?:[.,]\d+)*(?:\s*%|\s*(?:credits?|GB|MB|KB|TB|ms|s|sec|seconds?|minutes?|hours?|fps|px))?)"
QUOTES = (r"`([^`\n]{2,100})`", r"\"([^\"\n]{2,100})\"", r"“([^”\n]{2,100})”", r"‘([^’\n]{2,100})’")
EDGES = " \t\n,.;:()[]{}"


def keep_first(values: Column) -> Column:
    """Values without marks around them, the first spelling of each, empty ones left out."""
    plain = F.filter(F.transform(values, lambda v: F.btrim(v, F.lit(EDGES))), lambda v: v != "")
    low = F.transform(plain, lambda v: F.lower(v))
    return F.filter(F.transform(plain, lambda v, i: F.when(F.array_position(low, F.lower(v)) == i + 1, v)), lambda v: v.isNotNull())


def exact_values(text: Column) -> Column:
    """URLs, files, numbers with their units and quoted strings of a text."""
    found = lambda p: F.regexp_extract_all(text, F.lit(f"(?iU){p}"), 1)
    return keep_first(F.concat(found(URL), found(FILE), found(NUMBER), *[found(q) for q in QUOTES]))


def latin_names(text: Column) -> Column:
    """Names that stand out: acronyms, words with digits or capitals within, and capitalised words that don't begin a sentence."""
    strong = r"\b((?=[A-Za-z0-9+.#:/_-]*(?:\d|[a-z][A-Za-z0-9+.#:/_-]*[A-Z]))[A-Za-z][A-Za-z0-9+.#:/_-]*|[A-Z][A-Z]+)\b"
    inner = r"(?<=[^.!?\s]\s|[,;:]\s)\b([A-Z][a-z]+)\b"
    return keep_first(F.concat(F.regexp_extract_all(text, F.lit(strong), 1), F.regexp_extract_all(text, F.lit(inner), 1)))


def fidelity_warnings(source: Column, out: Column) -> Column:
    """What an output lacks of its source's exact values and names."""
    lost = lambda values, kind: F.transform(F.filter(values, lambda v: ~F.contains(out, v)), lambda v: F.concat(F.lit(f"possible_missing_{kind}:"), v))
    return F.concat(lost(exact_values(source), "exact_value"), lost(latin_names(source), "latin_name"))
