"""Repair of misheard words by what a video's own metadata and speech support.

Windows of two words, then of one, meet the evidence of their video by pieces that few edits leave whole. A window's best candidate must be
unique; of windows that share a word the first, the third and so on are taken. The words are then put back between what stood around them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandloom.functions.names import fresh
from strandloom.functions.text import stem_and_suffix
from strandloom.operators.joins import near_names, unique_best
from strandloom.operators.members import saved

#: What counts as a word.
WORD = "[가-힣]{2,}|[A-Z][A-Z0-9&+.-]{1,}"
SEGMENT = f"({WORD}|(?s:(?:(?!{WORD}).)+))"
HANGUL, ACRONYM = "^[가-힣]+$", "^[A-Z][A-Z0-9&+.-]+$"
CHANGE = "array<struct<before:string,after:string,distance:int,sources:array<string>,seen:bigint>>"

Canonical = Callable[[Column], Column]


def kind(word: Column) -> Column:
    return F.when(word.rlike(HANGUL), "hangul").when(word.rlike(ACRONYM), "acronym")


def _words(rows: DataFrame, key: list[str], text: str) -> DataFrame:
    """(key, seg, n, word, blank, stem, suffix): the words of each row, numbered by n; blank tells that only space lies before the next word."""
    segs = rows.select(*key, F.posexplode(F.regexp_extract_all(text, F.lit(SEGMENT), 1)).alias("seg", "word"))
    order = Window.partitionBy(*key).orderBy("seg")
    is_word = F.col("word").rlike(f"^(?:{WORD})$")
    after, second = F.lead("word").over(order), F.lead("word", 2).over(order)
    space = F.trim(F.regexp_replace(F.coalesce(after, F.lit("-")), r"(?U)\s+", "")) == ""
    blank = F.coalesce(after.rlike(f"^(?:{WORD})$"), F.lit(False)) | (space & second.isNotNull())
    words = segs.withColumns({"blank": blank, "is_word": is_word}).where("is_word")
    words = words.withColumn("n", F.row_number().over(order))
    return words.withColumn("split", stem_and_suffix(F.col("word"))).select(*key, "seg", "n", "word", "blank", "split.stem", "split.suffix")


def collect_evidence(rows: DataFrame, metadata: DataFrame, video: str, pos: str, text: str, canonical: Canonical | None = None) -> DataFrame:
    """(video, compact, display, priority, sources, seen, official, anchors) of every supported word or pair of words.

    metadata has (video, at, source, priority, text). A phrase is shown as its first occurrence of highest priority; seen counts it among single words of the rows.
    official: its canonical form is another one. anchors: canonical Latin names within two words of an acronym.
    """
    said = _words(metadata, [video, "at", "source", "priority"], "text")
    order = Window.partitionBy(video, "at", "source", "priority").orderBy("n")
    pair = said.withColumns({"next": F.lead("stem").over(order)}).where(F.col("blank") & F.col("stem").rlike(HANGUL) & F.col("next").rlike(HANGUL) & (F.char_length("stem") >= 2) & (F.char_length("next") >= 2))
    pair = pair.where((F.char_length("stem") + F.char_length("next")).between(4, 10))
    at = lambda two: F.struct((-F.col("priority")).alias("p"), "at", F.lit(two).alias("two"), "n").alias("first")
    named = said.select(video, "source", "priority", F.col("stem").alias("phrase"), at(0)).union(pair.select(video, "source", "priority", F.concat_ws(" ", "stem", "next"), at(1)))
    compact = F.regexp_replace("phrase", " ", "")
    named = named.withColumn("compact", compact).where((F.char_length("compact") >= 3) & kind(F.col("compact")).isNotNull())
    known = named.groupBy(video, "compact").agg(F.min_by("phrase", "first").alias("shown"), F.max("priority").alias("priority"), F.array_sort(F.collect_set("source")).alias("sources"))
    heard = _words(rows, [video, pos], text).where((F.char_length("stem") >= 3) & kind(F.col("stem")).isNotNull())
    heard = heard.groupBy(video, F.col("stem").alias("compact")).agg(F.count("*").alias("seen"))
    both = known.join(heard, [video, "compact"], "full_outer").withColumn("display", F.coalesce("shown", "compact"))
    if canonical is None:
        both = both.withColumns({"official": F.lit(False), "anchors": F.array().cast("array<string>")})
    else:
        other = F.when(canonical(F.col("stem")) != F.col("stem"), canonical(F.col("stem")))
        beside = said.withColumn("other", F.when(other.rlike("[A-Za-z]"), other)).withColumn("others", F.collect_list("other").over(order.rowsBetween(-2, 2)))
        anchors = beside.where(F.col("word").rlike(ACRONYM)).groupBy(video, F.col("word").alias("compact")).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("others")))).alias("anchors"))
        both = both.join(anchors, [video, "compact"], "left").withColumns({"official": F.coalesce((canonical(F.col("shown")) != F.col("shown")), F.lit(False)), "anchors": F.coalesce("anchors", F.array().cast("array<string>"))})
    filled = {"priority": F.coalesce("priority", F.lit(0)), "seen": F.coalesce("seen", F.lit(0).cast("long")), "sources": F.coalesce("sources", F.array().cast("array<string>"))}
    return both.withColumns(filled).select(video, "compact", "display", "priority", "sources", "seen", "official", "anchors")


def _eligible(evidence: DataFrame) -> DataFrame:
    """What a window may be repaired to."""
    e = evidence.withColumns({"suffix": stem_and_suffix(F.col("display"))["suffix"], "kind": kind(F.col("compact"))})
    size = F.char_length("compact")
    whole = F.contains("display", F.lit(" ")) | (F.col("suffix") == "")
    hangul = (F.col("kind") == "hangul") & whole & (((size >= 4) & (F.col("priority") >= 2)) | F.col("official") | ((F.col("priority") >= 3) & F.col("seen").between(1, 5)))
    acronym = (F.col("kind") == "acronym") & (F.size("anchors") > 0) & ((F.col("priority") > 0) | (F.col("seen") >= 3))
    return e.where(hangul | acronym).drop("suffix")


def _pass(rows: DataFrame, evidence: DataFrame, eligible: DataFrame, names: DataFrame, width: int, video: str, pos: str, text: str, out: str, log: str) -> DataFrame:
    """rows with the repaired text and the changes of one width of windows."""
    key = [video, pos]
    words = _words(rows, key, text)
    order = Window.partitionBy(*key).orderBy("n")
    if width == 2:
        words = words.withColumns({"stem2": F.lead("stem").over(order), "suffix2": F.lead("suffix").over(order), "seg2": F.lead("seg").over(order)})
        spans = words.where(F.col("blank") & (F.char_length("stem") == 2) & (F.char_length("stem2") == 2))
        spans = spans.select(*key, "n", F.col("seg").alias("from_seg"), F.col("seg2").alias("to_seg"), F.concat("stem", "stem2").alias("observed"), F.col("suffix2").alias("tail"))
    else:
        spans = words.where("stem <> ''").select(*key, "n", F.col("seg").alias("from_seg"), F.col("seg").alias("to_seg"), F.col("stem").alias("observed"), F.col("suffix").alias("tail"))
    spans = spans.withColumn("kind", kind(F.col("observed"))).where("kind IS NOT NULL")
    # windows near some name first, so that the other joins see few rows
    spans = spans.join(names, "observed")
    exact = evidence.select(video, F.col("compact").alias("observed"), F.col("priority").alias("own_priority"), F.col("seen").alias("own_seen"))
    spans = spans.join(exact, [video, "observed"], "left").where(~(F.coalesce("own_priority", F.lit(0)) > 0) & ~((F.col("kind") == "acronym") & (F.coalesce("own_seen", F.lit(0)) >= 3)))
    found = spans.join(eligible.withColumnRenamed("kind", "of_kind"), [video, "compact"]).where("kind = of_kind")
    found = found.join(rows.select(*key, F.col(text).alias("row_text")), key)
    single = ~F.contains("display", F.lit(" "))
    fits = F.col("official") | (F.col("seen") >= 5) | ((F.col("priority") >= 3) & ~single) if width == 1 else single & (F.col("priority") >= 2) & (F.char_length("compact") == 4)
    near = F.exists("anchors", lambda a: F.contains(F.col("row_text"), a))
    most = F.when((F.col("kind") == "hangul") & (F.char_length("observed") >= 4) & (F.col("priority") >= 3) & (F.col("seen") >= 5), 2).otherwise(1)
    found = found.where(F.when(F.col("kind") == "hangul", (F.char_length("observed") >= 3) & fits).otherwise(near)).where(F.col("distance") <= most)
    found = found.withColumn("support", F.col("priority") * 3 + F.least("seen", F.lit(10)))
    best = unique_best(found, [*key, "n"], [F.col("distance"), F.desc("support"), F.col("compact")], [F.col("distance"), F.col("support")])
    if width == 2:  # of neighbours that share a word every other one, from the left
        run = Window.partitionBy(*key).orderBy("n")
        best = best.withColumn("run", F.col("n") - F.row_number().over(run))
        best = best.withColumn("turn", F.row_number().over(Window.partitionBy(*key, "run").orderBy("n"))).where("turn % 2 = 1")
    change = F.struct("from_seg", "to_seg", F.concat("display", "tail").alias("after"), F.col("distance").cast("int").alias("distance"), "sources", "seen")
    per_row = best.groupBy(*key).agg(F.array_sort(F.collect_list(change)).alias("repairs"))
    joined = rows.join(per_row, key, "left").withColumn("segs", F.regexp_extract_all(text, F.lit(SEGMENT), 1))

    def put(seg: Column, i: Column) -> Column:
        starts = F.filter("repairs", lambda r: r["from_seg"] == i)
        inside = F.exists("repairs", lambda r: (i > r["from_seg"]) & (i <= r["to_seg"]))
        return F.when(F.size(starts) > 0, F.get(starts, F.lit(0))["after"]).when(inside, "").otherwise(seg)

    def told(r: Column) -> Column:
        before = F.array_join(F.slice("segs", r["from_seg"] + 1, r["to_seg"] - r["from_seg"] + 1), "")
        return F.struct(before.alias("before"), r["after"].alias("after"), r["distance"].alias("distance"), r["sources"].alias("sources"), r["seen"].alias("seen"))

    repaired = F.when(F.col("repairs").isNull(), F.col(text)).otherwise(F.array_join(F.transform("segs", put), ""))
    return joined.withColumns({out: repaired, log: F.coalesce(F.transform("repairs", told), F.array().cast(CHANGE))}).select(*[c for c in rows.columns if c not in (out, log)], out, log)


def repair_by_evidence(rows: DataFrame, metadata: DataFrame, video: str, pos: str, text: str, canonical: Canonical | None = None) -> DataFrame:
    """(video, pos, text, repaired, changes) of every row.

    changes has (before, after, distance, sources, seen), those of single words first, each from left to right. canonical rewrites the repaired text, and tells
    which names are official. (video, pos) tells rows apart. A null text counts as empty. Numbers, other words and what lies between words aren't touched.
    """
    v, p, t = fresh(rows, "video", "pos", "text")
    given = rows.select(F.col(video).alias(v), F.col(pos).alias(p), F.coalesce(F.col(text), F.lit("")).alias(t))
    known = metadata.withColumnRenamed(video, v)
    evidence = saved(collect_evidence(given, known, v, p, t, canonical), "evidence")
    eligible = saved(_eligible(evidence), "eligible")
    targets = eligible.select("compact").distinct()
    one, two, log2, log1 = "_one", "_two", "_log2", "_log1"

    def names(now: str, df: DataFrame) -> DataFrame:
        order = Window.partitionBy(v, p).orderBy("n")
        words = _words(df, [v, p], now).withColumn("next", F.lead("stem").over(order))
        both = F.when(F.col("blank") & (F.char_length("stem") == 2) & (F.char_length("next") == 2), F.concat("stem", "next"))
        observed = words.select(F.explode(F.array("stem", both)).alias("observed")).where(kind(F.col("observed")).isNotNull()).distinct()
        return saved(near_names(observed, targets, "observed", "compact", 2).select("observed", "compact", "distance"), "near")

    first = saved(_pass(given, evidence, eligible, names(t, given), 2, v, p, t, two, log2), "repaired")
    second = _pass(first, evidence, eligible, names(two, first), 1, v, p, two, one, log1)
    changes, repaired = F.concat(log1, log2), F.col(one)
    if canonical is not None:
        changes = F.transform(changes, lambda c: c.withField("after", canonical(c["after"])))
        repaired = canonical(repaired)
    return second.select(F.col(v).alias(video), F.col(p).alias(pos), F.col(t).alias(text), repaired.alias("repaired"), changes.alias("changes"))
