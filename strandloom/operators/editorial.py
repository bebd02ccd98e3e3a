"""The editorial pass over a video's utterances: spacing, the video's own identity, and names that nearby utterances or the registry support.

What a row may become depends on the two rows before it as they were rewritten, and on the two behind it as they were given: a name that one row
gets is evidence for the next. So the rows of a video go through a fold in order, with two texts as its state; all that doesn't
depend on earlier decisions (spacing, identities, scores of names) is computed by Spark before.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandloom.functions import hangul as h
from strandloom.functions import repairs
from strandloom.functions.names import fresh

ACRONYM = re.compile(r"(?<![A-Za-z0-9])[A-Z][A-Z0-9]{1,4}(?![A-Za-z0-9])")
HANGUL_WORD = re.compile("[가-힣]{2,}")
ANY_WORD = re.compile("[가-힣]{2,}|[A-Za-z][A-Za-z0-9+./-]*")
HONORIFIC = re.compile(r"([가-힣]{2,8})\s*님")
ROWS = 128  # whose texts are held at once
REACH = 2  # rows on either side that count as nearby
#: How near, by letters, a word must be to a name: with an honorific, with a creator's first name, with a lost beginning, at any place, in the registry.
NEAR_HONORIFIC, NEAR_CREATOR, NEAR_ENDING, NEAR_WORD, NEAR_REGISTRY, AMBIGUOUS = 0.26, 0.34, 0.45, 0.22, 0.28, 0.03
CHANGE = "struct<`from`:string,`to`:string,reason:string,evidence:string>"
NEAR = "struct<surface:string,reason:string,names:array<string>>"


@dataclass(frozen=True)
class Name:
    name: str
    category: str = "tool"
    tier: str = "A"
    aliases: tuple[str, ...] = ()
    pronunciations: tuple[str, ...] = ()
    anchors: tuple[str, ...] = ()


def _count(text: Column, form: str) -> Column:
    if re.search("[가-힣]", form):
        bare, f = F.lower(F.regexp_replace(text, r"(?U)[\s._/-]+", "")), h.compact(form)
        return ((F.char_length(bare) - F.char_length(F.replace(bare, F.lit(f), F.lit("")))) / len(f)).cast("long")
    return F.regexp_count(text, F.lit(rf"(?i)(?<![A-Za-z0-9])\Q{form}\E(?![A-Za-z0-9])")).cast("long")


def name_scores(rows: DataFrame, metadata: DataFrame, video: str, text: str, names: list[Name]) -> DataFrame:
    """(video, scores): for each name the weights of the metadata that hold it, and its occurrences in the rows, six at most."""
    held = lambda n: F.greatest(*[_count(F.col("text"), f) for f in dict.fromkeys((n.name, *n.aliases, *n.pronunciations))], F.lit(0).cast("long")) > 0
    given = metadata.groupBy(video).agg(*[F.sum(F.when(held(n), F.col("weight")).otherwise(0)).alias(f"m{i}") for i, n in enumerate(names)])
    spoken = lambda n: sum((_count(F.col(text), f) for f in (n.name, *n.aliases, *n.pronunciations) if f), F.lit(0).cast("long"))
    said = rows.groupBy(video).agg(*[F.sum(spoken(n)).alias(f"o{i}") for i, n in enumerate(names)])
    score = lambda i: F.coalesce(f"m{i}", F.lit(0)) + F.least(F.coalesce(f"o{i}", F.lit(0)), F.lit(6))
    return said.join(given, video, "left").select(video, F.array(*[score(i).cast("long") for i in range(len(names))]).alias("scores"))


def identities(metadata: DataFrame, video: str) -> DataFrame:
    """(video, short, full) of videos whose channel and creator name one person in Korean and Latin letters."""
    display = metadata.where(F.col("source").isin("channel_title", "creator_name"))
    flat = lambda p: F.trim(F.regexp_replace(F.regexp_extract("text", p, 0), r"(?U)\s+", " "))
    korean, latin = flat(r"(?U)[가-힣][가-힣\s]{1,24}"), flat(r"(?U)[A-Za-z][A-Za-z0-9]*(?:\s+[A-Za-z][A-Za-z0-9]*){0,3}")
    one = display.select(video, "at", korean.alias("korean"), latin.alias("latin")).withColumn("key", F.regexp_replace("korean", r"(?U)[\s._/-]+", ""))
    one = one.where((F.char_length("key") >= 2) & (F.col("latin") != ""))
    each = one.groupBy(video).agg(F.size(F.collect_set(F.struct("key", F.lower("latin")))).alias("n"), F.min_by("korean", "at").alias("full")).where("n = 1")
    short = F.element_at(F.split("full", " "), -1)
    return each.select(video, short.alias("short"), "full").where(F.char_length("short") >= 2)


class Editor:
    """Rewrites one video's rows in order."""

    def __init__(self, names: list[Name]) -> None:
        self.names = names
        self.about, self.about_compact = "", ""
        longest = lambda n: max(map(len, (*n.aliases, *n.pronunciations)), default=0)
        self.by_length = sorted(range(len(names)), key=lambda i: -longest(names[i]))

    def row(self, text: str, before: list[str], given: str, after: list[str], short: str | None, full: str | None, scores: list[int], about: str) -> tuple[str, list[tuple], list[tuple]]:
        self.text, self.changes, self.near = text, [], []
        if short:
            self._identity(short, full)
        nearby = "\n".join(before + after)
        self._acronyms(nearby)
        self._nearby_names(nearby)
        self._registry("\n".join([*before, given, *after]), scores, about)
        return self.text, self.changes, self.near

    def _put(self, start: int, end: int, to: str, reason: str, evidence: str) -> None:
        found, self.text = self.text[start:end], self.text[:start] + to + self.text[end:]
        if found != to:
            self.changes.append((found, to, reason, evidence))

    def _identity(self, short: str, full: str) -> None:
        evidence = "explicit_channel_or_creator_metadata"
        n, honoured = len(self.changes), list(HONORIFIC.finditer(self.text))
        for m in honoured:
            name = m.group(1)
            if name == short or h.phonetic_ratio(name, short) <= NEAR_HONORIFIC or (len(h.compact(name)) == len(h.compact(short)) == 2 and h.edits(name, short) == 1):
                self._put(*m.span(), f"{short}님", "video_local_person_identity_consistency", evidence)
                break
        first, whole = full.split()[0], h.compact(full)
        if first != full:
            for m in HANGUL_WORD.finditer(self.text):
                stem = h.without_particle(m.group())
                if stem.startswith(first) and stem != whole and (h.phonetic_ratio(stem, whole) <= NEAR_CREATOR or (len(stem) == len(whole) and h.edits(stem, whole) <= 2)):
                    self._put(*m.span(), m.group().replace(stem, full, 1), "video_local_creator_identity_consistency", evidence)
                    break
        if n == len(self.changes):
            self.near += [(m.group(), "video_local_person_identity_near_match", [full]) for m in HONORIFIC.finditer(self.text) if 0 < h.phonetic_ratio(m.group(1), short) <= NEAR_CREATOR]

    def _acronyms(self, nearby: str) -> None:
        """An acronym that lost a letter which one of the nearby ones has, if the rows share a word."""
        bare = lambda text: {h.without_particle(w) if re.search("[가-힣]", w) else w for w in ANY_WORD.findall(text)}
        own, others = bare(self.text), bare(nearby)
        korean = lambda words: {w[:2] for w in words if re.fullmatch("[가-힣]{2,}", w)}
        if not any(re.search("[가-힣]", w) and len(w) >= 2 for w in own & others) and not korean(own) & korean(others):
            return
        known = set(ACRONYM.findall(nearby))
        for seen in ACRONYM.findall(self.text):
            longer = [k for k in known if len(k) == len(seen) + 1 and h.edits(seen, k) == 1]
            if len(longer) == 1:
                self.text = re.sub(rf"(?<![A-Za-z0-9]){seen}(?![A-Za-z0-9])", longer[0], self.text)
                self.changes.append((seen, longer[0], "adjacent_dialogue_acronym_continuity", "nearby_confirmed_entity_and_shared_concept"))

    def _nearby_names(self, nearby: str) -> None:
        """The first word that sounds like a name which a nearby row holds."""
        for name in self.names:
            if name.tier not in ("A", "B") or not h.contains(nearby, name.name):
                continue
            for m in HANGUL_WORD.finditer(self.text):
                stem = h.without_particle(m.group())
                if any(self._sounds_like(stem, h.compact(p)) for p in name.pronunciations):
                    to = m.group().replace(stem, name.name, 1)
                    self.changes.append((m.group(), to, "adjacent_dialogue_official_entity_continuity", "nearby_confirmed_entity_and_compatible_pronunciation"))
                    self.text = self.text[: m.start()] + to + self.text[m.end() :]
                    break

    @staticmethod
    def _sounds_like(stem: str, spoken: str) -> bool:
        ratio, longer = h.phonetic_ratio(stem, spoken), len(spoken) - len(stem)
        return (len(stem) >= 2 and 0 < longer <= 2 and stem[-2:] == spoken[-2:] and ratio <= NEAR_ENDING) or (abs(longer) <= 1 and ratio <= NEAR_WORD)

    def _replace(self, spoken: str, name: str) -> bool:
        behind = "" if re.search("[가-힣]", spoken) else "(?![A-Za-z0-9])"
        ahead = "(?<![가-힣A-Za-z0-9])" if not behind else "(?<![A-Za-z0-9])"
        text = re.sub(ahead + re.escape(spoken) + behind, lambda _: name, self.text, flags=re.IGNORECASE)
        changed, self.text = text != self.text, text
        return changed

    def _registry(self, context: str, scores: list[int], about: str) -> None:
        if about != self.about:
            self.about, self.about_compact = about, h.compact(about)
        context_compact = h.compact(context)

        def holds(anchor: str) -> bool:
            if re.search("[가-힣]", anchor):  # without spaces the parts simply follow one another
                return h.compact(anchor) in context_compact + h.compact(self.text) + self.about_compact
            return h.contains(f"{context}\n{self.text}\n{about}", anchor)

        supported = lambda n: not n.anchors or any(map(holds, n.anchors))
        for name in (self.names[i] for i in self.by_length):
            if supported(name):
                for spoken in sorted(name.pronunciations, key=len, reverse=True):
                    if self._replace(spoken, name.name):
                        self.changes.append((spoken, name.name, "verified_registry_pronunciation", "global_canonical_registry"))
        words = list(HANGUL_WORD.finditer(self.text))
        seen = [h.without_particle(m.group()) for m in words]
        seen += [f"{h.without_particle(m.group())} {h.without_particle(n.group())}" for m, n in zip(words, words[1:]) if not self.text[m.end() : n.start()].strip()]
        for word in seen:
            ratios: dict[str, tuple[float, int]] = {}
            for i in self.by_length:
                name = self.names[i]
                if not name.anchors or (scores[i] < 2 and not (name.category == "UI_feature" and "모드" in word)) or not supported(name):
                    continue
                for spoken in name.pronunciations:
                    if spoken and abs(len(h.compact(word)) - len(h.compact(spoken))) <= 1 and 0 < (r := h.phonetic_ratio(word, spoken)) <= NEAR_REGISTRY:
                        ratios[name.name] = min(ratios.get(name.name, (r, i)), (r, i))
            ranked = sorted((r, name, i) for name, (r, i) in ratios.items())
            if len(ranked) > 1 and ranked[1][0] - ranked[0][0] < AMBIGUOUS:
                self.near.append((word, "ambiguous_registry_near_match", [ranked[0][1], ranked[1][1]]))
            elif ranked and scores[ranked[0][2]] >= 3 and self._replace(word, ranked[0][1]):
                self.changes.append((word, ranked[0][1], "unique_video_supported_registry_near_match", "repeated_video_entity_evidence"))
            elif ranked:
                self.near.append((word, "registry_pronunciation_near_match", [ranked[0][1]]))


def edit_videos(rows: DataFrame, metadata: DataFrame, video: str, pos: str, text: str, names: list[Name]) -> DataFrame:
    """(video, pos, text, edited, changes, near) of every row.

    metadata has (video, at, source, weight, text). changes has (from, to, reason, evidence) in the order in which they were made, near what is too weak or ambiguous. A null text
    is empty. One video is one task's stream of rows, of which two texts are held; its metadata comes with its first row.
    """
    v, p, t, spaced, made, a1, a2, nth = fresh(rows, "video", "pos", "text", "spaced", "made", "after1", "after2", "nth")
    given = rows.select(F.col(video).alias(v), F.col(pos).alias(p), F.coalesce(F.col(text), F.lit("")).alias(t))
    said = metadata.withColumnRenamed(video, v)
    about = said.groupBy(v).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "source", "text"))), lambda r: r["text"]), "\n").alias("about"))
    order = Window.partitionBy(v).orderBy(p)
    clean, changes = repairs.repaired_spacing(F.col(t))
    ready = given.withColumns({spaced: clean, made: changes, a1: F.lead(t, 1).over(order), a2: F.lead(t, 2).over(order), nth: F.rank().over(order)})
    of_video = name_scores(given, said, v, t, names).join(identities(said, v), v, "left").join(about, v, "left")
    ready = ready.join(of_video, v).withColumns({c: F.when(F.col(nth) == 1, F.col(c)) for c in ("scores", "short", "full", "about")}).drop(nth)
    placed = ready.repartition(v).sortWithinPartitions(v, p)
    kinds = {f.name: f.dataType.simpleString() for f in given.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        editor, now, held = Editor(names), object(), []
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                part, out = batch.slice(at, ROWS), []
                for r in part.to_pylist():
                    if r[v] != now:
                        now, held, short, full, scores, said_of = r[v], [], r["short"], r["full"], r["scores"], r["about"] or ""
                    after = [x for x in (r[a1], r[a2]) if x is not None]
                    edited, changed, near = editor.row(r[spaced], held, r[t], after, short, full, scores, said_of)
                    out.append((edited, [tuple(c.values()) for c in r[made]] + changed, near))
                    held = [*held, edited][-REACH:]
                edited, changed, near = zip(*out)
                made_of = lambda xs, fields: pa.array([[dict(zip(fields, x)) for x in row] for row in xs], pa.list_(pa.struct(fields)))
                texts = dict.fromkeys(("from", "to", "reason", "evidence"), pa.string())
                columns = [*part.select([v, p, t]).columns, pa.array(edited, pa.string()), made_of(changed, texts), made_of(near, {"surface": pa.string(), "reason": pa.string(), "names": pa.list_(pa.string())})]
                yield pa.RecordBatch.from_arrays(columns, names=[v, p, t, "edited", "changes", "near"])

    return placed.mapInArrow(run, f"`{v}` {kinds[v]}, `{p}` {kinds[p]}, `{t}` string, edited string, changes array<{CHANGE}>, near array<{NEAR}>").select(F.col(v).alias(video), F.col(p).alias(pos), F.col(t).alias(text), "edited", "changes", "near")
