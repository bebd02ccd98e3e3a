"""Proposed spellings of names: which are safe to apply, and which follow from spellings already accepted in the same video.

Phrases meet transcripts through an index of character n-grams: a phrase takes its rarest one, and only rows that have it are searched. So a
proposal never scans its video, and one that the video doesn't say falls out before any text is read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.functions.repairs import clean_name, name_tokens
from strandloom.functions.similarity import ratio_udf
from strandloom.functions.wordlists import DESCRIPTORS, STOPWORDS

GRAM = 3
#: What isn't a phrase but an address or a command.
LITERAL = r"(?i)https?://|(?:[A-Za-z0-9_-]+\.)+(?:com|ai|io|dev|app|net|org)|\{slash\}|(?<!\w)/[A-Za-z0-9_./-]+"
#: Letters of a key that may stay unexplained, or be added to it, at most; least likeness of a supported word.
UNEXPLAINED, LIKE = 4, 0.86
#: Least likeness for a family of two or more, by its chapter; by its name too; for any family; with a collision; and how far the second best must be.
CHAPTER_LIKE, FAMILY_LIKE, NAME_LIKE, ALONE_LIKE, COLLISION_LIKE, MARGIN = 0.68, 0.74, 0.58, 0.84, 0.70, 0.08


def fuzzy_key(value: Column) -> Column:
    return F.regexp_replace(F.lower(value), "[^a-z0-9]+", "")


def _grams(text: Column, size: Column) -> Column:
    low = F.lower(text)
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.char_length(low) - size + 1), lambda i: F.substring(low, i, size)))


def occurrences(phrases: DataFrame, texts: DataFrame) -> DataFrame:
    """(video, phrase, pos) for each row that holds a phrase (video, phrase), whatever the case. texts has (video, pos, text)."""
    asked = phrases.select("video", "phrase").where("phrase <> ''").distinct().withColumn("size", F.least(F.char_length("phrase"), F.lit(GRAM)))
    asked = asked.withColumn("gram", F.explode(_grams(F.col("phrase"), F.col("size"))))
    sizes = F.filter(F.sequence(F.lit(1), F.lit(GRAM)), lambda n: n <= F.char_length("text"))
    # rows tell their grams of the sizes that some phrase is short enough to need
    index = texts.where(F.char_length("text") > 0).select("video", "pos", F.explode(sizes).alias("size"), "text").join(F.broadcast(asked.select("size").distinct()), "size")
    index = index.select("video", "pos", "size", F.explode(_grams(F.col("text"), F.col("size"))).alias("gram")).join(asked.select("video", "size", "gram").distinct(), ["video", "size", "gram"], "left_semi")
    often = index.groupBy("video", "gram").agg(F.count("*").alias("n"))
    rarest = asked.join(often, ["video", "gram"], "left").groupBy("video", "phrase").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("r")).where("r.n > 0")
    near = rarest.select("video", "phrase", F.col("r.gram").alias("gram")).join(index.select("video", "gram", "pos"), ["video", "gram"])
    return near.join(texts, ["video", "pos"]).where(F.contains(F.lower("text"), F.lower("phrase"))).select("video", "phrase", "pos")


def supported_words(names: DataFrame, texts: DataFrame) -> DataFrame:
    """(video, word) of words that name something in a video: those of its names, and those that its texts write like a name."""
    of_names = names.select("video", F.explode(name_tokens(F.col("name"))).alias("w")).select("video", F.lower("w").alias("word")).where(~F.col("word").isin(*DESCRIPTORS))
    found = F.regexp_extract_all("text", F.lit(r"(?<![A-Za-z0-9])([A-Za-z][A-Za-z0-9+#_-]{2,})(?![A-Za-z0-9])"), 1)
    said = texts.select("video", F.explode(found).alias("w")).where(F.col("w").rlike("^.+[A-Z0-9]")).select("video", F.lower("w").alias("word"))
    return of_names.union(said.where(~F.col("word").isin(*DESCRIPTORS, *STOPWORDS))).distinct()


def mapping_safety(mappings: DataFrame, texts: DataFrame, names: DataFrame, metadata: DataFrame | None = None) -> DataFrame:
    """(video, raw, canonical, reason) of every proposed spelling; reason is the first that keeps it from being applied, null if it is safe.

    mappings has (video, raw, canonical), texts (video, pos, text), names (video, name, verified); metadata has texts (video, text) that support words but aren't searched.
    Reasons in order: empty, same, literal, unheard (no row holds it), established (it is a name itself), collapse (part of it would be lost), expansion (a shorter form
    of the same), no_significant_word, unsupported_word, swapped_name (it spells a verified name, in several words, that the canonical lacks).
    """
    m = mappings.select("video", F.col("raw").alias("given"), F.col("canonical").alias("proposed")).distinct()
    m = m.withColumns({"raw": F.coalesce(clean_name(F.col("given")), F.lit("")), "canonical": F.coalesce(clean_name(F.col("proposed")), F.lit(""))})
    m = m.withColumns({"rk": fuzzy_key(F.col("raw")), "ck": fuzzy_key(F.col("canonical")), "rt": name_tokens(F.col("raw"))})
    heard = occurrences(m.select("video", F.col("raw").alias("phrase")), texts).select("video", F.col("phrase").alias("raw")).distinct().withColumn("heard", F.lit(True))
    own = names.select("video", F.lower("name").alias("low")).distinct().withColumn("is_name", F.lit(True))
    significant = F.array_distinct(F.filter(F.transform(F.regexp_extract_all("canonical", F.lit("([A-Za-z][A-Za-z0-9+#_-]*)"), 1), lambda t: F.lower(t)), lambda t: (t != "s") & ~t.isin(*DESCRIPTORS, *STOPWORDS)))
    m = m.withColumn("words", significant)
    words = m.select("video", F.explode("words").alias("word")).distinct()
    all_texts = texts.select("video", "text") if metadata is None else texts.select("video", "text").union(metadata.select("video", "text"))
    known = supported_words(names, all_texts)
    missing = words.join(known, ["video", "word"], "left_anti")
    near = missing.join(known.withColumnRenamed("word", "known"), "video").where((F.substring("word", 1, 1) == F.substring("known", 1, 1)) & (F.abs(F.char_length("word") - F.char_length("known")) <= 2))
    close = near.where(ratio_udf("word", "known") >= LIKE).select("video", "word").distinct()
    lost = missing.join(close, ["video", "word"], "left_anti").groupBy("video").agg(F.collect_set("word").alias("lost"))
    joined = m.join(heard, ["video", "raw"], "left").withColumn("low", F.lower("raw")).join(own, ["video", "low"], "left").join(lost, "video", "left")
    anchors = names.where("verified").select("video", "name", fuzzy_key(F.col("name")).alias("key")).where((F.size(name_tokens(F.col("name"))) == 1) & F.col("name").rlike("^.+[A-Z0-9]|^[A-Z0-9]+$") & (F.char_length("key") >= 5))
    runs = F.flatten(F.transform(F.array(F.lit(2), F.lit(3)), lambda k: F.transform(F.filter(F.sequence(F.lit(1), F.size("rt")), lambda i: i + k - 1 <= F.size("rt")), lambda i: fuzzy_key(F.array_join(F.slice("rt", i, k), "")))))
    spelt = m.where(F.size("rt") >= 2).select("video", "given", "proposed", "canonical", F.explode(runs).alias("key")).join(anchors, ["video", "key"])
    inside = F.contains(F.concat(F.lit(" "), F.regexp_replace(F.lower("canonical"), "[^a-z0-9]", " "), F.lit(" ")), F.concat(F.lit(" "), F.regexp_replace(F.lower("name"), "[^a-z0-9]", " "), F.lit(" ")))
    swapped = spelt.where(~inside).select("video", "given", "proposed").distinct().withColumn("swapped", F.lit(True))
    joined = joined.join(swapped, ["video", "given", "proposed"], "left")
    collapse = (F.size("rt") >= 2) & (F.size(name_tokens(F.col("canonical"))) == 1) & (F.col("rk") != "") & (F.col("ck") != "") & F.contains("rk", F.col("ck")) & (F.char_length("rk") - F.char_length("ck") >= UNEXPLAINED)
    part = (F.col("rk") != "") & (F.col("ck") != "") & (F.startswith("ck", F.col("rk")) | F.startswith("rk", F.col("ck"))) & (F.abs(F.char_length("rk") - F.char_length("ck")) >= UNEXPLAINED)
    reason = (
        F.when((F.col("raw") == "") | (F.col("canonical") == ""), "empty")
        .when(F.lower("raw") == F.lower("canonical"), "same")
        .when(F.col("raw").rlike(LITERAL), "literal")
        .when(F.col("heard").isNull(), "unheard")
        .when(F.col("is_name"), "established")
        .when(collapse, "collapse")
        .when(part, "expansion")
        .when(F.size("words") == 0, "no_significant_word")
        .when(F.coalesce(F.arrays_overlap("words", "lost"), F.lit(False)), "unsupported_word")
        .when(F.col("swapped"), "swapped_name")
    )
    return joined.select("video", F.col("given").alias("raw"), F.col("proposed").alias("canonical"), reason.alias("reason"))


def propagate_families(phrases: DataFrame, accepted: DataFrame, texts: DataFrame, names: DataFrame, metadata: DataFrame | None = None) -> DataFrame:
    """(video, nth, raw, canonical, family): for each suspicious phrase, in order, the name that its video's accepted spellings support, or null; family counts that name's spellings then.

    phrases has (video, nth, raw), accepted (video, raw, canonical), texts (video, pos, text, label: the chapter's), names (video, name, verified). What is accepted joins its family and counts for the phrases behind
    it, so a video's phrases go through a fold in order. All likenesses, chapters and safety are computed before, as joins.
    A family is of one video and one name of one word; what the fold holds is the families of one video. Phrases that metadata (video, pos, text) holds as such are left out.
    """
    fam = accepted.join(names.where("verified").select("video", F.col("name").alias("canonical")), ["video", "canonical"])
    fam = fam.where((F.size(name_tokens(F.col("canonical"))) == 1) & (F.lower("raw") != F.lower("canonical"))).select("video", "canonical", "raw").distinct()
    heard = occurrences(fam.select("video", F.col("raw").alias("phrase")), texts.select("video", "pos", "text")).select("video", F.col("phrase").alias("raw")).distinct()
    fam = fam.join(heard, ["video", "raw"])
    new = phrases.select("video", "nth", F.col("raw")).join(accepted.select("video", "raw"), ["video", "raw"], "left_anti").withColumn("rk", fuzzy_key(F.col("raw"))).where(F.char_length("rk") >= 5)
    if metadata is not None:
        shown = occurrences(new.select("video", F.col("raw").alias("phrase")), metadata).join(metadata.select("video", "pos", "text"), ["video", "pos"])
        alone = F.rlike("text", F.concat(F.lit(r"(?i)(?<![A-Za-z0-9])\Q"), "phrase", F.lit(r"\E(?![A-Za-z0-9])")))
        new = new.join(shown.where(alone).select("video", F.col("phrase").alias("raw")).distinct(), ["video", "raw"], "left_anti")
    # witnesses: spellings of the families, and suspicious phrases before this one, which may have joined one by then
    spelt = fam.select("video", "canonical", fuzzy_key(F.col("raw")).alias("wk")).distinct()
    named = new.join(spelt, "video").withColumn("like", ratio_udf("rk", "wk"))
    earlier = new.join(new.select("video", F.col("nth").alias("before"), F.col("rk").alias("bk")), "video").where("before < nth").withColumn("like", ratio_udf("rk", "bk")).where(F.col("like") >= CHAPTER_LIKE)
    earlier = earlier.groupBy("video", "nth").agg(F.collect_list(F.struct("before", "bk", "like")).alias("earlier"))
    each = named.groupBy("video", "nth", "raw", "rk", "canonical").agg(F.max("like").alias("like"), F.collect_set("wk").alias("keys"))
    said = occurrences(new.select("video", F.col("raw").alias("phrase")), texts.select("video", "pos", "text")).join(texts.select("video", "pos", fuzzy_key(F.col("label")).alias("lk")), ["video", "pos"])
    labels = said.groupBy("video", F.col("phrase").alias("raw")).agg(F.collect_set("lk").alias("labels"))
    ck = fuzzy_key(F.col("canonical"))
    chapter = F.coalesce(F.exists("labels", lambda k: F.contains(k, ck) | F.contains(ck, k)), F.lit(False))
    verified = names.where("verified").select("video", F.explode(name_tokens(F.col("name"))).alias("w")).groupBy("video").agg(F.collect_set(F.lower("w")).alias("verified_words"))
    first = F.lower(F.get(name_tokens(F.col("raw")), F.lit(0)))
    each = each.join(labels, ["video", "raw"], "left").join(verified, "video")
    each = each.withColumns({"name_like": ratio_udf("rk", ck), "chapter": chapter, "collision": F.array_contains("verified_words", first) & (first != F.lower("canonical"))})
    safe = mapping_safety(each.select("video", "raw", "canonical"), texts.select("video", "pos", "text"), names).select("video", "raw", "canonical", F.col("reason").isNull().alias("safe"))
    each = each.join(safe, ["video", "raw", "canonical"])
    option = F.struct("canonical", "like", "name_like", "chapter", "collision", "safe", "keys")
    rows = each.groupBy("video", "nth", "raw", "rk").agg(F.array_sort(F.collect_list(option)).alias("options")).join(earlier, ["video", "nth"], "left")
    kind = rows.schema["video"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        video: object = object()
        joined: dict[int, str] = {}  # phrases accepted so far in this video
        keys: dict[str, set[str]] = {}  # the spellings of each family
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                if r["video"] != video:
                    video, joined, keys = r["video"], {}, {}
                ranked = []
                for o in r["options"]:
                    family = keys.setdefault(o["canonical"], set())
                    family.update(o["keys"])
                    like = max([o["like"], *(w["like"] for w in (r["earlier"] if r["earlier"] is not None else []) if joined.get(w["before"]) == o["canonical"])])
                    n = len(family)
                    if o["collision"]:
                        fits = o["chapter"] and n >= 2 and like >= COLLISION_LIKE
                    else:
                        fits = n >= 2 and ((o["chapter"] and like >= CHAPTER_LIKE) or (like >= FAMILY_LIKE and o["name_like"] >= NAME_LIKE)) or like >= ALONE_LIKE
                    if fits:
                        ranked.append((like + 0.10 * bool(o["chapter"]) + min(0.06, 0.02 * n), o["canonical"], n, o["safe"]))
                ranked.sort(reverse=True)
                clear = ranked and (len(ranked) == 1 or ranked[0][0] - ranked[1][0] >= MARGIN)
                _, name, n, safe = ranked[0] if clear else (0, None, None, False)
                if safe:
                    joined[r["nth"]] = name
                    keys[name].add(r["rk"])
                out.append((video, r["nth"], r["raw"], name if safe else None, n if safe else None))
            yield pd.DataFrame({"video": [o[0] for o in out], "nth": [o[1] for o in out], "raw": [o[2] for o in out], "canonical": [o[3] for o in out], "family": pd.array([o[4] for o in out], "Int64")})

    return rows.repartition("video").sortWithinPartitions("video", "nth").mapInPandas(run, f"video {kind}, nth long, raw string, canonical string, family long")
