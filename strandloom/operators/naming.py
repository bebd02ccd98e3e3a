"""Names in texts: all mentions in one pass, what an output lacks of its source's names, and rewrites that leave names alone.

A text's words are numbered, and its windows of as many words as some name has meet the names' forms by equality. Every
form is found wherever it stands, overlapping ones too, whatever the number of forms; they are broadcast if they are few and shuffled otherwise.
"""

from __future__ import annotations

from collections.abc import Callable
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.functions.names import fresh
from strandloom.functions.repairs import GENERIC_PHRASES, name_tokens
from strandloom.functions.wordlists import LATIN_TERMS, LEAK_WORDS

#: Addresses, paths and commands, whose parts aren't names.
LITERAL = r"(?i)https?://[^\s\"'<>]+|(?<![A-Za-z0-9])(?:[A-Za-z0-9_-]+\.)+(?:com|ai|io|dev|app|net|org)(?:/[A-Za-z0-9_./?=&%-]*)?|(?<![A-Za-z0-9])/[A-Za-z0-9_./-]+|\{slash\}\s*command(?:\s+[A-Za-z0-9_.-]+){0,8}"
#: What may stay Latin in an output besides names.
LATIN_SPANS = (
    r"(?i)https?://\S+|www\.\S+|(?<![A-Za-z0-9])(?:[A-Za-z0-9_-]+\.)+(?:com|ai|io|dev|app|net|org)(?:/[A-Za-z0-9_./?=&%-]*)?",
    r"(?U)(?<!\w)/[A-Za-z0-9_./-]+",
    r"(?i)\{slash\}\s*[^,.!?\n]{1,80}",
)
#: Endings that recognition adds to a name, before a particle.
ADDED = "(?:스|즈)(?=(?:은|는|이|가|을|를|에|에서|의|와|과|로|으로|예요|이에요|입니다))"
CODE_AGAIN = r"\s+코드(?=[을를이가은는에의와과로으로,.!?\s]|$)"
SPAN = "array<struct<start:int,end:int,name:string>>"
MENTION = "array<struct<name:string,form:string,start:int,end:int>>"
#: How many forms are sent to every executor; more are shuffled.
BROADCAST = 300_000


def _within(value: Column, use: Callable[[Column], Column]) -> Column:
    """What use makes of a value, which is computed once however often functions of arrays use it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _low(text: Column) -> Column:
    """The text with A-Z in lower case and all else as it is."""
    return F.translate(text, ascii_uppercase, ascii_lowercase)


def _with_mentions(rows: DataFrame, key: list[str], text: str, forms: DataFrame, out: str) -> DataFrame:
    """rows with their texts' mentions in column out, as an array.

    A text's words meet the forms by equality, alone and as many together as some form has. Only those that a form has are shuffled, without their text; each row meets its own
    once, and there the characters between and beside them decide.
    """
    words_of = lambda c: F.regexp_extract_all(_low(c), F.lit("([a-z0-9]+)"), 1)
    k, nth, window, name, form, lead, word, met = fresh(rows, "k", "nth", "window", "name", "form", "lead", "word", "met")
    f = forms.select(F.col("name").alias(name), F.col("form").alias(form)).distinct().withColumn("words", words_of(F.col(form)))
    before, alone = F.char_length(F.regexp_extract(form, "^([^A-Za-z0-9]*)", 1)), F.col(form).rlike(r"^[A-Za-z0-9]+\z")
    f = f.select(name, form, F.size("words").alias(k), F.array_join("words", " ").alias(window), before.alias(lead), alone.alias(word)).where(F.col(k) > 0)
    sizes = {r[k]: r["count"] for r in f.groupBy(k).count().collect()}
    f = F.broadcast(f) if sum(sizes.values()) <= BROADCAST else f

    def windows(words: Column, n: int) -> Column:
        joined = lambda w, i: w if n == 1 else F.concat_ws(" ", *[F.get(words, i + j) for j in range(n)])
        return F.transform(F.slice(words, F.lit(1), F.greatest(F.size(words) - (n - 1), F.lit(0))), lambda w, i: F.struct(F.lit(n).alias(k), i.alias(nth), joined(w, i).alias(window)))

    every = _within(words_of(F.col(text)), lambda words: F.concat(*[windows(words, n) for n in sorted(sizes) or [1]]))
    told = rows.select(*key, F.explode(every).alias(met)).select(*key, f"{met}.*").join(f, [k, window])
    told = told.groupBy(*key).agg(F.collect_list(F.struct(nth, name, form, lead, word)).alias(met))

    # the text's outline, with a bar before each word: as long as the text, but for the bars
    outline = F.regexp_replace(F.regexp_replace(text, "[^A-Za-z0-9]", " "), "([A-Za-z0-9]+)", "|$1")

    def placed(bars: Column) -> Column:
        start = lambda m: F.char_length(F.call_function("substring_index", bars, F.lit("|"), m[nth] + 1)) - m[nth] - m[lead]
        return F.transform(met, lambda m: F.struct(m[name].alias("name"), m[form].alias("form"), start(m).alias("start"), m[word].alias("word")))

    def stands(m: Column) -> Column:
        size = F.char_length(m["form"])
        same = F.lower(F.substring(text, m["start"] + 1, size)) == F.lower(m["form"])
        beside = lambda at: ~F.coalesce(F.substring(text, at, F.lit(1)).rlike("^[A-Za-z0-9]"), F.lit(False))
        return m["word"] | ((m["start"] >= 0) & same & beside(m["start"] + size + 1) & ((m["start"] == 0) | beside(F.greatest(m["start"], F.lit(1)))))

    found = F.filter(_within(outline, placed), stands)
    found = F.transform(found, lambda m: F.struct(m["name"].alias("name"), m["form"].alias("form"), m["start"].alias("start"), (m["start"] + F.char_length(m["form"])).alias("end")))
    none = F.array().cast(MENTION)
    return rows.join(told, key, "left").withColumn(out, F.when(F.col(met).isNull(), none).otherwise(found.cast(MENTION))).drop(met)


def mentions(rows: DataFrame, key: list[str], text: str, forms: DataFrame) -> DataFrame:
    """(key, name, form, start, end) of every place where a form of a name (name, form) stands between other characters than ASCII letters and digits, in any case.

    Places are in characters from 0. A form without letters or digits is never found; a null text holds none.
    """
    (m,) = fresh(rows, "m")
    return _with_mentions(rows.select(*key, text), key, text, forms, m).select(*key, F.explode(m).alias(m)).select(*key, f"{m}.*")


def _chosen(found: Column) -> Column:
    """Of an array's overlapping mentions the longest, then the first; in order of place. One that comes again meets itself."""

    def add(held: Column, m: Column) -> Column:
        meets = F.exists(held, lambda s: (s["start"] < m["end"]) & (m["start"] < s["end"]))
        return F.when(meets, held).otherwise(F.concat(held, F.array(F.struct(m["start"].alias("start"), m["end"].alias("end"), m["name"].alias("name")))))

    one = lambda m: F.struct((m["start"] - m["end"]).alias("shorter"), F.lower(m["name"]).alias("low"), m["start"].alias("start"), m["end"].alias("end"), m["name"].alias("name"))
    return F.array_sort(F.aggregate(F.array_sort(F.transform(found, one)), F.array().cast(SPAN), add))


def chosen_spans(found: DataFrame, key: list[str]) -> DataFrame:
    """(key, spans): of overlapping mentions the longest, then the first; in order of place."""
    every = found.groupBy(*key).agg(F.collect_list(F.struct("name", "form", "start", "end")).alias("m"))
    return every.select(*key, _chosen(F.col("m")).alias("spans"))


def _pieces(text: Column, spans: Column, put: Callable[[Column, Column], Column]) -> Column:
    """The text with each span replaced by what put makes of (span, number)."""
    n = F.size(spans)
    after = lambda i: F.when(i > 0, F.get(spans, F.greatest(i - 1, F.lit(0)))["end"]).otherwise(0)
    gap = lambda i, to: F.substring(text, after(i) + 1, to - after(i))
    parts = F.transform(spans, lambda s, i: F.concat(gap(i, s["start"]), put(s, i)))
    rest = F.substring(text, after(n) + 1, F.char_length(text))
    return F.when(n > 0, F.concat(F.array_join(parts, ""), rest)).otherwise(text)


def _with_spans(rows: DataFrame, key: list[str], text: str, forms: DataFrame, out: str) -> DataFrame:
    return _with_mentions(rows, key, text, forms, out).withColumn(out, _chosen(F.col(out)))


def name_issues(rows: DataFrame, key: list[str], source: str, output: str, forms: DataFrame) -> DataFrame:
    """(key, kind, what) of each issue of an output: misspelt_name and missing_name for names of one or two words that the source holds in some form, leak for common words and
    untranslated for other Latin words that no name, address or abbreviation accounts for, lost_beneficiary and invented_cause for two relations.

    forms has (name, form) of verified names; every name is a form of itself. Names within addresses and commands don't count. A null source or output is empty.
    """
    s, o, plain = fresh(rows, "source", "output", "plain")
    given = rows.select(*key, F.coalesce(F.col(source), F.lit("")).alias(s), F.coalesce(F.col(output), F.lit("")).alias(o)).withColumn(plain, F.regexp_replace(s, LITERAL, "__"))
    whole = forms.select("name", "form").union(forms.select("name", F.col("name").alias("form"))).distinct()
    itself = whole.select("name", F.col("name").alias("form")).distinct()
    words = name_tokens(F.col("name"))
    counted = whole.where(F.size(words).between(1, 2) & ~F.lower("name").isin(*GENERIC_PHRASES) & ~((F.size(words) == 1) & F.upper("name").isin(*LATIN_TERMS)))
    asked, there, named_in = fresh(given, "asked", "there", "named_in")
    given = _with_mentions(_with_mentions(given, key, plain, counted, asked), key, o, itself, there)
    named = lambda c: F.array_distinct(F.transform(c, lambda m: m["name"]))
    given = given.withColumn(asked, named(F.col(asked))).withColumn(named_in, named(F.col(there))).withColumn("spans", _chosen(F.col(there)))
    lacking = F.filter(asked, lambda name: ~F.contains(F.col(o), name))
    lacking = F.transform(lacking, lambda name: F.struct(F.when(F.array_contains(named_in, name), "misspelt_name").otherwise("missing_name").alias("kind"), name.alias("what")))

    bare = given.withColumn("left", _pieces(F.col(o), F.col("spans"), lambda m, i: F.lit(" ")))
    text = F.col("left")
    for pattern in LATIN_SPANS:
        text = F.regexp_replace(text, pattern, " ")
    bare = bare.withColumn("left", text)
    common = F.regexp_extract_all("left", F.lit("(?<![A-Za-z])([A-Za-z]+(?:'[A-Za-z]+)?)(?![A-Za-z])"), 1)
    leaks = F.array_distinct(F.filter(common, lambda w: F.lower(F.replace(w, F.lit("'"), F.lit(""))).isin(*LEAK_WORDS)))
    terms = "|".join(sorted(LATIN_TERMS, key=len, reverse=True))
    rest = F.regexp_replace("left", rf"(?i)(?<![A-Za-z0-9])(?:{terms})(?![A-Za-z0-9])", " ")
    latin = F.transform(F.regexp_extract_all(rest, F.lit("(?<![A-Za-z])([A-Za-z][A-Za-z0-9_.+#/-]*)(?![A-Za-z])"), 1), lambda w: F.btrim(w, F.lit(".,")))
    other = F.array_distinct(F.filter(latin, lambda w: (F.char_length(w) > 1) & ~w.rlike(r"^[A-Z]{2,5}\d*$")))
    said = lambda kind, xs: F.transform(xs, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("what")))
    low = F.lower(s)
    lost = low.rlike(r"\bfor me\b") & ~F.col(o).rlike(r"저\s*대신|제\s*대신|저를\s*위해|저에게|제게|저한테|저를\s*대신|해\s*주|해주")
    invented = low.rlike(r"\bjust\s+because\s+(?:yeah|yes|you know|whatever)\b") & F.col(o).rlike("왜냐하면|때문")
    relations = F.array_compact(F.array(F.when(lost, F.struct(F.lit("lost_beneficiary").alias("kind"), F.lit("for me").alias("what"))), F.when(invented, F.struct(F.lit("invented_cause").alias("kind"), F.lit("just because").alias("what")))))
    (issue,) = fresh(rows, "issue")
    found = bare.select(*key, F.explode(F.concat(lacking, said("leak", leaks), said("untranslated", other), relations)).alias(issue))
    return found.select(*key, f"{issue}.kind", f"{issue}.what")


def rewritten_around_names(rows: DataFrame, key: list[str], text: str, forms: DataFrame, rewrite: Callable[[Column], Column], out: str = "rewritten") -> DataFrame:
    """rows with the text rewritten, in column out (it replaces one so named), while names keep their place as one character each.

    The character is the first of a private range that the text doesn't hold, followed by the name's number, so texts that hold placeholders of any other kind aren't mistaken, and what was
    taken out lies beside the text. Where a rewrite drops a name's place the name is gone, and where it doubles it the name stands twice.
    Afterwards what recognition adds to a name goes, and a name's last word or the whole name behind itself goes too. Names come back in their official form.
    """
    rows = rows.drop(out)
    body, spans, mark, kept = fresh(rows, "body", "spans", "mark", "kept")
    itself = forms.select("name", "form").union(forms.select("name", F.col("name").alias("form"))).distinct()
    given = _with_spans(rows.withColumn(body, F.coalesce(F.col(text), F.lit(""))), key, body, itself, spans)
    free = F.get(F.filter(F.array(*[F.lit(chr(0xE000 + i)) for i in range(64)]), lambda c: ~F.contains(F.col(body), c)), F.lit(0))
    given = given.withColumn(mark, F.coalesce(free, F.lit(chr(0xF8FF)))).withColumn(kept, F.transform(spans, lambda m: m["name"]))
    held = _pieces(F.col(body), F.col(spans), lambda m, i: F.concat(F.col(mark), i.cast("string"), F.col(mark)))
    done = rewrite(held)
    done = F.regexp_replace(done, F.concat(F.lit("("), mark, F.lit(r"\d+"), mark, F.lit(")" + ADDED)), F.lit("$1"))
    numbers = F.sequence(F.lit(0), F.size(kept) - 1)

    def back(x: Column, i: Column) -> Column:
        return F.replace(x, F.concat(F.col(mark), i.cast("string"), F.col(mark)), F.get(kept, i))

    def once(x: Column, name: Column) -> Column:
        quoted = F.concat(F.lit(r"\Q"), name, F.lit(r"\E"))
        last = F.concat(F.lit(r"\Q"), F.element_at(name_tokens(name), -1), F.lit(r"\E"))
        for again in (last, quoted):
            x = F.regexp_replace(x, F.concat(F.lit("(?i)(?<![A-Za-z0-9])("), quoted, F.lit(r")\s+"), again, F.lit("(?![A-Za-z0-9])")), F.lit("$1"))
        code = F.regexp_replace(x, F.concat(F.lit("("), quoted, F.lit(")" + CODE_AGAIN)), F.lit("$1"))
        return F.when(F.lower(F.element_at(name_tokens(name), -1)) == "code", code).otherwise(x)

    names = F.array_sort(F.array_distinct(kept), lambda a, b: F.char_length(b) - F.char_length(a))

    # a name's patterns leave a text as it is that doesn't hold, in any case and with any blanks, what they look for
    flat = lambda c: F.regexp_replace(_low(c), r"\s+", " ")
    last = lambda name: F.try_element_at(name_tokens(name), F.lit(-1))
    told = lambda name: F.struct(name.alias("name"), flat(F.concat(name, F.lit(" "), last(name))).alias("one"), flat(F.concat(name, F.lit(" "), name)).alias("two"), ((F.lower(last(name)) == "code") | F.contains(name, F.lit(r"\E"))).alias("code"))
    state = lambda x: F.struct(x.alias("x"), flat(x).alias("low"))
    may = lambda held, n: F.coalesce(n["code"] | F.contains(held["low"], n["one"]) | F.contains(held["low"], n["two"]), F.lit(True))
    step = lambda held, n: F.when(may(held, n), _within(once(held["x"], n["name"]), state)).otherwise(held)
    restored = F.aggregate(numbers, done, back)
    whole = F.when(F.size(kept) > 0, F.aggregate(F.transform(names, told), _within(restored, state), step)["x"]).otherwise(done)
    return given.withColumn(out, F.trim(F.regexp_replace(whole, r"(?U)\s+", " "))).drop(body, spans, mark, kept)
