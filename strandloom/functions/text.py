"""Column functions on text: cleaning, tokens, stems, scripts, containment, grounding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandloom.functions.names import fresh

SPACES = r"(?U)\s+"
#: Endings in the order in which they are tried; the first that fits is taken.
PARTICLES = ("들에는", "들에게", "께서는", "에서는", "으로", "에게", "처럼", "라는", "라고", "께서", "들을", "들이", "들은", "은", "는", "이", "가", "을", "를", "도", "에", "의", "만", "와", "과", "들")
GROUNDING_PARTICLES = ("으로", "에서", "에게", "까지", "부터", "처럼", "보다", "하고", "으로서", "으로써", "이나", "거나", "라도", "을", "를", "이", "가", "은", "는", "에", "로", "와", "과", "도", "만")
SUFFIXES = (
    "하였습니다", "했습니다", "합니다", "하기", "됩니다", "입니다", "이었어요", "겠습니다", "았습니다", "었습니다", "습니다", "였어요", "이에요", "예요",
    "하면서", "하며", "해서", "하는", "하고", "한", "에서", "으로", "처럼", "보다", "라는", "라고", "들과", "들을", "들이", "들은", "에서는", "에게", "께서",
    "까지", "부터", "랑", "로", "와", "과", "은", "는", "이", "가", "을", "를", "도", "의", "에", "만",
)
#: Spellings that alignment takes for one.
ALIGNED_FORMS = (
    ("미드전니|미드전이|미드전위|미드이|미드니|미드전일", "미드저니"),
    ("나노바나 프로|나노 나노바나|나노바나로", "나노바나나 프로"),
    ("시덴댄스|시덴스|시덴댄스로", "시댄스"),
    ("세리프|쓰리프|슬리프|스리프|테리프|세리피|세리프트|세리포|슬피", "Sref"),
    ("무드을", "무드를"),
    ("일간된", "일관된"),
    ("임무를", "인물을"),
    ("쇼트", "쇼츠"),
)
#: Verb families and the stems that show them, in text without spaces.
ACTION_FAMILIES = {
    "open": ("열", "들어가", "접속", "이동"),
    "click": ("클릭", "누르", "버튼"),
    "input": ("입력", "붙여넣", "붙여놓", "작성", "치고", "쳐서"),
    "copy": ("복사", "가져오", "불러오", "추출"),
    "select": ("선택", "고르", "지정"),
    "connect": ("연결", "추가", "설치", "등록"),
    "create": ("생성", "만들", "구성", "구축", "구현"),
    "run": ("실행", "빌드", "요청", "적용"),
    "verify": ("확인", "검토", "읽어", "비교"),
    "change": ("수정", "변경", "바꾸", "정리", "저장"),
}
#: What shows a direct operation, a mere concept, and an operation in spite of a concept.
DIRECT_CUE = "클릭|누르|버튼|입력|붙여|복사|선택|연결|추가|설치|등록|검색|요청|실행|저장|파일|탭|메뉴|플러그인|사이트|모드|켜|끄|열어|들어가|가져오|불러오|리네임|변경|수정|만들어|구성해"
CONCEPT_CUE = "개념|정의|차이|의미|이유|왜|때문|과정|구조|원리|라고 생각|이라고 보|설명|배경"
STRONG_CUE = "클릭|누르|입력|복사|붙여|설치|실행|요청|버튼|탭|메뉴"
#: Forms of address and endings that aren't respectful; each stands between non-Hangul characters.
CASUAL_WORDS = {
    "당신": "당신(만의|의|은|는|이|가|을|를|에게|께|도|과|와|이랑|처럼|부터|까지|이라면|이면|이라도|이라서|이라)?",
    "너/너는": "너(만의|의|는|가|를|에게|도|랑|처럼|라면|라서|라도)?",
    "네가": "네가",
    "내가": "내가",
    "나는": "나는",
}
CASUAL_ENDING = "(야|이야|거야|돼|해|줘|몰라|알아|있어|없어|했어|할게)([.!?]|$)"
QUOTED = ('"[^"\\n]{0,500}"', "'[^'\\n]{0,500}'", "“[^”\\n]{0,500}”", "‘[^’\\n]{0,500}’")
LEADS = ("ㄱ", "ㄲ", "ㄴ", "ㄷ", "ㄸ", "ㄹ", "ㅁ", "ㅂ", "ㅃ", "ㅅ", "ㅆ", "ㅇ", "ㅈ", "ㅉ", "ㅊ", "ㅋ", "ㅌ", "ㅍ", "ㅎ")
VOWELS = ("ㅏ", "ㅐ", "ㅑ", "ㅒ", "ㅓ", "ㅔ", "ㅕ", "ㅖ", "ㅗ", "ㅘ", "ㅙ", "ㅚ", "ㅛ", "ㅜ", "ㅝ", "ㅞ", "ㅟ", "ㅠ", "ㅡ", "ㅢ", "ㅣ")
TAILS = ("", "ㄱ", "ㄲ", "ㄳ", "ㄴ", "ㄵ", "ㄶ", "ㄷ", "ㄹ", "ㄺ", "ㄻ", "ㄼ", "ㄽ", "ㄾ", "ㄿ", "ㅀ", "ㅁ", "ㅂ", "ㅄ", "ㅅ", "ㅆ", "ㅇ", "ㅈ", "ㅊ", "ㅋ", "ㅌ", "ㅍ", "ㅎ")


def clean_display(text: Column) -> Column:
    """Speaker marks off, runs of space to one."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r">>+", " "), SPACES, " "))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"([가-힣A-Za-z0-9]+)"), 1)


def bare(text: Column) -> Column:
    """Letters and digits of any script only, lower-cased."""
    return F.lower(F.regexp_replace(text, r"(?U)[\W_]+", ""))


def compact(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, SPACES, ""))


def without_fillers(words: Column, fillers: tuple[str, ...]) -> Column:
    """Repeated words stay; only fillers go."""
    return F.filter(words, lambda w: ~F.lower(w).isin(*fillers))


def first_ending(word: Column, endings: tuple[str, ...], least: int = 2) -> Column:
    """The first of the endings that the word has and that leaves `least` characters; null if none does."""
    out = F.when(F.lit(False), "")
    for e in endings:
        out = out.when(word.endswith(e) & (F.char_length(word) - len(e) >= least), e)
    return out


def without(word: Column, ending: Column) -> Column:
    """The word without an ending that it has."""
    return F.when(ending.isNull(), word).otherwise(F.substring(word, F.lit(1), F.char_length(word) - F.char_length(ending)))


def strip_particle(word: Column) -> Column:
    """The word, without spaces, without its particle if two characters remain."""
    bare = F.regexp_replace(word, SPACES, "")
    return without(bare, first_ending(bare, PARTICLES))


def next_suffix(stem: Column) -> Column:
    """The next ending to be split off; an exclamation mark where one of several characters would leave too little; null where none fits."""
    out = F.when(F.lit(False), "")
    for e in SUFFIXES:
        fits = stem.endswith(e) & (F.char_length(stem) - len(e) >= 2)
        out = out.when(fits, e).when(stem.endswith(e), "!") if len(e) > 1 else out.when(fits, e)
    return out


def split_suffix(words: DataFrame, word: str, levels: int = 3) -> DataFrame:
    """words with stem and suffix: endings of a Hangul word split off up to three times; the stem is empty where an ending leaves too little."""
    (ending,) = fresh(words, "ending")
    out = words.withColumns({"stem": F.col(word), "suffix": F.lit(""), ending: F.lit("")})
    e = F.col(ending)
    for _ in range(levels):
        goes = e.isNotNull() & (e != "!") & F.col(word).rlike("^[가-힣]+$")
        out = out.withColumn(ending, F.when(goes, next_suffix(F.col("stem"))).when(e == "!", "!"))
        cut = e.isNotNull() & (e != "!")
        out = out.withColumns({"stem": F.when(e == "!", "").when(cut, without(F.col("stem"), e)).otherwise(F.col("stem")), "suffix": F.when(e == "!", F.col(word)).when(cut, F.concat(ending, "suffix")).otherwise(F.col("suffix"))})
    return out.drop(ending)


def stem_and_suffix(word: Column, levels: int = 3) -> Column:
    """As split_suffix, as one struct (stem, suffix) of a word."""
    endings = F.array(*map(F.lit, SUFFIXES))

    def step(held: Column, _: Column) -> Column:
        stem = held["stem"]
        left = lambda e: F.char_length(stem) - F.char_length(e)
        first = F.get(F.filter(endings, lambda e: F.endswith(stem, e) & ((left(e) >= 2) | (F.char_length(e) > 1))), F.lit(0))
        shorter = F.struct(F.substring(stem, F.lit(1), left(first)).alias("stem"), F.concat(first, held["suffix"]).alias("suffix"))
        nothing = F.struct(F.lit("").alias("stem"), word.alias("suffix"))
        return F.when(first.isNull() | (stem == ""), held).when(left(first) >= 2, shorter).otherwise(nothing)

    whole = F.struct(word.alias("stem"), F.lit("").alias("suffix"))
    return F.when(word.rlike("^[가-힣]+$"), F.aggregate(F.sequence(F.lit(1), F.lit(levels)), whole, step)).otherwise(whole)


def aligned_form(text: Column) -> Column:
    """Display text with the spellings that alignment takes for one, in lower case."""
    out = clean_display(text)
    for forms, to in ALIGNED_FORMS:
        out = F.regexp_replace(out, f"(?iu){forms}", to)
    return F.lower(out)


def action_families(text: Column) -> Column:
    low = F.lower(F.regexp_replace(text, SPACES, ""))
    return F.array_compact(F.array(*[F.when(low.rlike("|".join(stems)), family) for family, stems in ACTION_FAMILIES.items()]))


def action_worthy(text: Column) -> Column:
    """A verb family and a direct cue, and not a mere concept."""
    return (F.size(action_families(text)) > 0) & text.rlike(DIRECT_CUE) & ~(text.rlike(CONCEPT_CUE) & ~text.rlike(STRONG_CUE))


def jamo(word: Column) -> Column:
    """Hangul syllables as their letters; other characters stay."""
    table = lambda xs: F.array(*map(F.lit, xs))

    def letters(c: Column) -> Column:
        n = F.ascii(c) - 0xAC00
        parts = F.concat(
            F.element_at(table(LEADS), (n / 588).cast("int") + 1),
            F.element_at(table(VOWELS), ((n % 588) / 28).cast("int") + 1),
            F.element_at(table(TAILS), (n % 28).cast("int") + 1),
        )
        return F.when(n.between(0, 11171), parts).otherwise(c)

    return F.array_join(F.transform(F.split(word, ""), letters), "")


def phonetic_ratio(a: Column, b: Column) -> Column:
    """Edits between the letters of two words over the longer one's letters."""
    x, y = jamo(F.lower(a)), jamo(F.lower(b))
    return F.levenshtein(x, y) / F.greatest(F.char_length(x), F.char_length(y), F.lit(1))


def stem_en(word: Column) -> Column:
    """A rough English stem: the first of a few endings goes if five characters remain; all that begins with direct is one."""
    low = F.lower(word)
    n = F.char_length(low)
    out = F.when(F.lit(False), "")
    for e in ("ing", "ers", "er", "ed", "ly", "s"):
        out = out.when(low.endswith(e) & (n > len(e) + 4), F.substring(low, F.lit(1), n - len(e)))
    stem = out.otherwise(low)
    return F.when(stem.startswith("direct"), "direct").otherwise(stem)


def contains_phrase(text: Column, phrase: Column) -> Column:
    """Korean phrases ignore spaces; Latin ones stand between word bounds, in any case."""
    korean = F.contains(F.regexp_replace(text, SPACES, ""), F.regexp_replace(phrase, SPACES, ""))
    padded = F.concat(F.lit(" "), F.regexp_replace(F.lower(text), r"(?U)[\W_]+", " "), F.lit(" "))
    latin = F.contains(padded, F.concat(F.lit(" "), F.regexp_replace(F.lower(phrase), r"(?U)[\W_]+", " "), F.lit(" ")))
    return F.when(phrase.rlike("[가-힣]"), korean).otherwise(latin)


GROUNDING_TOKEN = r"([A-Za-z][A-Za-z0-9.+#/_-]*|[가-힣]{2,}|\d+(?:\.\d+)?%?)"


def grounding_tokens(text: Column) -> Column:
    """Latin words, Korean words without their particle and numbers, in lower case, from two characters on; repeats stay."""
    found = F.transform(F.regexp_extract_all(text, F.lit(GROUNDING_TOKEN), 1), lambda t: F.lower(t))
    bare = F.transform(found, lambda t: F.when(t.rlike("^[가-힣]"), without(t, first_ending(t, GROUNDING_PARTICLES))).otherwise(t))
    return F.filter(bare, lambda t: F.char_length(t) >= 2)


def grounding_ratio(text: Column, source: Column) -> Column:
    """The share of a text's grounding tokens that occur anywhere in its source; 0 without tokens."""
    t = grounding_tokens(text)
    low = F.lower(source)
    return F.coalesce(F.try_divide(F.size(F.filter(t, lambda x: F.contains(low, x))).cast("double"), F.size(t)), F.lit(0.0))


def target_language_status(source: Column, text: Column) -> Column:
    """ok, or why a text isn't Korean: empty, two or more Han characters that its source hasn't got, fewer than two Hangul ones."""
    out = F.trim(F.coalesce(text, F.lit("")))
    han = F.regexp_extract_all(out, F.lit("([\u3400-\u4dbf\u4e00-\u9fff])"), 1)
    new = F.size(F.filter(han, lambda c: ~F.contains(F.coalesce(source, F.lit("")), c)))
    return F.when(out == "", "empty").when(new >= 2, "unexpected_han_characters").when(F.regexp_count(out, F.lit("[가-힣ㄱ-ㅎㅏ-ㅣ]")) < 2, "insufficient_hangul").otherwise("ok")


def register_violations(text: Column) -> Column:
    """Forms of address and endings outside quotation marks that aren't respectful."""
    for q in QUOTED:
        text = F.regexp_replace(text, q, " ")
    words = [F.when(text.rlike(f"(^|[^가-힣]){pattern}($|[^가-힣])"), label) for label, pattern in CASUAL_WORDS.items()]
    return F.array_compact(F.array(*words, F.when(text.rlike(CASUAL_ENDING), "반말 종결")))


def squeeze_repeats(words: Column) -> Column:
    """Neighbouring equal words, in any case, as one."""
    n = F.size(words)
    at = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: (i == 1) | (F.lower(F.try_element_at(words, i)) != F.lower(F.try_element_at(words, F.greatest(i - 1, F.lit(1))))))
    return F.when(n > 0, F.transform(at, lambda i: F.element_at(words, i))).otherwise(words)


def keyword_in_context(text: Column, phrase: str, reach: int, most: int) -> Column:
    """Up to `most` occurrences with `reach` characters on either side."""
    parts = F.split(text, rf"\Q{phrase}\E")
    upto = F.transform(F.sequence(F.lit(1), F.least(F.size(parts) - 1, F.lit(most))), lambda i: F.char_length(F.array_join(F.slice(parts, F.lit(1), i), phrase)))
    cut = F.transform(upto, lambda p: F.substring(text, F.greatest(p - reach, F.lit(0)) + 1, F.least(p, F.lit(reach)) + len(phrase) + reach))
    return F.when(F.size(parts) > 1, cut).otherwise(F.array().cast("array<string>"))


def minimal_pieces(line: Column) -> Column:
    """Pieces of a line, cut after runs of terminal punctuation."""
    return F.regexp_extract_all(line, F.lit(r"([^.!?…]+[.!?…]*|[.!?…]+)"), 1)


def source_conditioned(source: Column, out: Column) -> Column:
    """Spellings that always change, and terms that change where the source, in lower case, names them."""
    plain = F.replace(F.replace(out, F.lit("컨텐츠"), F.lit("콘텐츠")), F.lit("워크 플로우"), F.lit("워크플로우"))
    motion = F.replace(F.replace(plain, F.lit("동영상 그래픽"), F.lit("모션 그래픽")), F.lit("모션 그래픽스"), F.lit("모션 그래픽"))
    plain = F.when(F.contains(source, F.lit("motion graphic")), motion).otherwise(plain)
    sound = F.replace(F.replace(plain, F.lit("소리 효과"), F.lit("사운드 효과")), F.lit("음향 효과"), F.lit("사운드 효과"))
    return F.trim(F.when(F.contains(source, F.lit("sound effect")), sound).otherwise(plain))


def official_names(out: Column, names: tuple[str, ...]) -> Column:
    """Names in their official spelling whatever their case and spaces, and `X (X)` as X."""
    for name in names:
        out = F.regexp_replace(out, "(?i)" + r"\s+".join(name.split()), name) if " " in name else out
    any_name = "|".join(names)
    return F.regexp_replace(out, rf"(?i)({any_name})\s*\(\s*({any_name})\s*\)", "$1")


def suspicion(rows: DataFrame, video: str, row: str, chapter: str, start: str, body: str, signals: tuple, latin_fusion: str, units: str, kit: str, kit_context: str, acronym: str) -> DataFrame:
    """(video, row, signals, score, rank) of rows with signals of bad recognition.

    Words are counted per row before they are shuffled, and acronyms meet those of the rows beside theirs only.
    """
    key = [video, row]
    tokens = rows.select(*key, F.explode(F.regexp_extract_all(body, F.lit("([가-힣]{2,}|[A-Za-z][A-Za-z0-9+./-]*)"), 1)).alias("t")).groupBy(*key, F.lower("t").alias("k")).agg(F.count("*").alias("c"))
    freq = tokens.groupBy(video, "k").agg(F.sum("c").alias("n"))
    rare = F.sum(F.when(F.col("n") == 1, F.col("c")).otherwise(0))
    lexical = tokens.join(freq, [video, "k"]).groupBy(*key).agg(F.round(5.0 * rare / F.sum("c"), 6).alias("lexical"))
    found = F.regexp_extract_all(body, F.lit(f"(?<![A-Za-z0-9])({acronym})(?![A-Za-z0-9])"), 1)
    acronyms = rows.select(*key, F.explode(found).alias("a"))
    single = acronyms.join(acronyms.groupBy(video, "a").agg(F.count("*").alias("n")).where("n = 1"), [video, "a"]).select(*key).distinct().withColumn("single", F.lit(True))
    beside = acronyms.distinct().withColumn("at", F.explode(F.array(F.col(row) - 1, F.col(row) + 1)))
    pairs = beside.alias("x").join(acronyms.distinct().alias("y"), (F.col(f"x.{video}") == F.col(f"y.{video}")) & (F.col("x.at") == F.col(f"y.{row}")))
    alike = (F.col("x.a") != F.col("y.a")) & (F.char_length("x.a") == F.char_length("y.a")) & (F.levenshtein("x.a", "y.a") == 1)
    near = pairs.where(alike).select(F.col(f"x.{video}").alias(video), F.col(f"x.{row}").alias(row)).distinct().withColumn("near", F.lit(True))
    all_rows = rows.join(lexical, key, "left").join(single, key, "left").join(near, key, "left").withColumn("lexical", F.coalesce("lexical", F.lit(0.0)))
    w = Window.partitionBy(video)
    ranked = all_rows.withColumns({"n_rows": F.count("*").over(w), "rank": F.row_number().over(Window.partitionBy(video, chapter).orderBy(F.desc("lexical"), start)).cast("long")})
    b, lex = F.col(body), F.col("lexical")
    fused = F.size(F.filter(F.regexp_extract_all(body, F.lit("[0-9]+([가-힣]{2,})"), 1), lambda x: ~x.rlike(f"^({units})"))) > 0
    tests = [(name, weight, b.rlike(pattern)) for name, weight, pattern in signals] + [
        ("malformed_script_boundary", 3.0, fused | b.rlike(latin_fusion)),
        ("unverified_official_name_candidate", 4.0, b.rlike(kit) & b.rlike(kit_context)),
        ("acronym_discourse_inconsistency", 4.0, F.col("near")),
        ("singleton_unregistered_acronym", 3.0, F.col("single")),
        ("video_local_lexical_outlier", 0.0, (F.col("n_rows") >= 8) & (((F.col("rank") <= 6) & (lex >= 1.8)) | (lex >= 3.35))),
        ("severe_video_local_lexical_outlier", 3.0, lex >= 3.35),
    ]
    said = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, _, test in tests]))
    score = lex
    for _, weight, test in tests:
        score = score + F.when(test, F.lit(weight)).otherwise(F.lit(0.0))
    out = ranked.select(*key, said.alias("said"), F.round(score, 4).alias("score"), "rank").where(F.size("said") > 0)
    return out.select(*key, F.array_join(F.array_sort("said"), ",").alias("signals"), "score", "rank")
