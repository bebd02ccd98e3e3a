"""Repair by evidence against plain Python that walks the windows one after another."""

import random
import re
from collections import Counter, defaultdict

from strandloom.functions import text as t
from strandloom.operators import evidence
from strandloom.plans import catalogue, editorial

SF_DIR = "/root/testdata/sf0.001"
WORD = re.compile(evidence.WORD)
NAMES = editorial.SPOKEN_NAMES


def canonical(x):
    for a, b in NAMES.items():
        x = x.replace(a, b)
    return x


def split(word):
    if not re.fullmatch("[가-힣]+", word):
        return word, ""
    stem, suffix = word, ""
    for _ in range(3):
        for e in t.SUFFIXES:
            if stem.endswith(e):
                if len(stem) - len(e) >= 2:
                    stem, suffix = stem[: -len(e)], e + suffix
                    break
                if len(e) > 1:
                    return "", word
        else:
            break
    return stem, suffix


def kind(x):
    return "hangul" if re.fullmatch("[가-힣]+", x) else "acronym" if re.fullmatch("[A-Z][A-Z0-9&+.-]+", x) else None


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def phrases(text):
    found = list(WORD.finditer(text))
    out = [split(m.group())[0] for m in found]
    for m, n in zip(found, found[1:]):
        a, b = split(m.group())[0], split(n.group())[0]
        if not text[m.end() : n.start()].strip() and kind(a) == kind(b) == "hangul" and len(a) >= 2 and len(b) >= 2 and 4 <= len(a) + len(b) <= 10:
            out.append(f"{a} {b}")
    return out


def repair(rows, metadata):
    """{pos: (repaired, changes)} of one video."""
    known, sources, anchors = {}, defaultdict(set), defaultdict(set)
    for source, priority, text in metadata:
        for p in phrases(text):
            c = p.replace(" ", "")
            if len(c) < 3 or not kind(c):
                continue
            e = known.setdefault(c, [p, 0, False, 0])
            if priority > e[1]:
                e[0], e[1] = p, priority
            sources[c].add(source)
            e[2] = canonical(e[0]) != e[0]
        words = [m.group() for m in WORD.finditer(text)]
        for i, w in enumerate(words):
            if kind(w) == "acronym":
                for near in words[max(0, i - 2) : i + 3]:
                    alias = split(near)[0]
                    if canonical(alias) != alias and re.search("[A-Za-z]", canonical(alias)):
                        anchors[w].add(canonical(alias))
    seen = Counter(p for text in rows.values() for m in WORD.finditer(text) if len(p := split(m.group())[0]) >= 3 and kind(p))
    for c, n in seen.items():
        known.setdefault(c, [c, 0, False, 0])[3] = n
    can = []
    for c, (display, priority, official, n) in known.items():
        if kind(c) == "hangul":
            if not (" " not in display and split(display)[1]) and ((len(c) >= 4 and priority >= 2) or official or (priority >= 3 and 1 <= n <= 5)):
                can.append(c)
        elif anchors[c] and (priority or n >= 3):
            can.append(c)
    out = {}
    for pos, text in rows.items():
        changes = []
        for width in (2, 1):
            found, taken, now = list(WORD.finditer(text)), [], text
            i = 0
            while i + width <= len(found):
                window = found[i : i + width]
                i += 1
                if width == 2 and (now[window[0].end() : window[1].start()].strip() or any(len(split(m.group())[0]) != 2 for m in window)):
                    continue
                stems = [split(m.group())[0] for m in window]
                c = "".join(stems)
                if not all(stems) or not kind(c):
                    continue
                own = known.get(c)
                if own and (own[1] or (kind(c) == "acronym" and own[3] >= 3)):
                    continue
                ranked = []
                for x in can:
                    display, priority, official, n = known[x]
                    if kind(x) != kind(c) or len(x) != len(c):
                        continue
                    if kind(c) == "hangul":
                        if len(c) < 3 or (width == 1 and not (official or n >= 5 or (priority >= 3 and " " in display))) or (width == 2 and (" " in display or priority < 2 or len(x) != 4)):
                            continue
                    elif not any(a in now for a in anchors[x]):
                        continue
                    most = 2 if kind(c) == "hangul" and len(c) >= 4 and priority >= 3 and n >= 5 else 1
                    if 0 < (d := edits(c, x)) <= most:
                        ranked.append((d, -(priority * 3 + min(n, 10)), x))
                ranked.sort()
                if not ranked or (len(ranked) > 1 and ranked[0][:2] == ranked[1][:2]):
                    continue
                d, _, x = ranked[0]
                after = known[x][0] + split(window[-1].group())[1]
                taken.append((window[0].start(), window[-1].end(), after, d, x))
                i += width - 1  # a word belongs to one window
            for a, b, after, d, x in reversed(taken):
                text = text[:a] + after + text[b:]
                changes.append((now[a:b], canonical(after), d, sorted(sources[x]), known[x][3]))
        out[pos] = (canonical(text), changes[::-1])
    return out


def test_overlapping_windows_and_ties(spark):
    meta = {1: [("video_title", 3, "프롬프트 클로드 API 가나다라 화면"), ("youtube_description", 2, "롬프트가 마바사아 마바사자")], 2: [("video_title", 3, "워크플로 콘텐츠 콘텐트")]}
    rows = {
        1: {0: "프롬 푸트 예시", 1: "프롬 푸트 푸롬 프트로 봅니다", 2: "클루드를 Claude APX 클로두", 3: "APX 혼자", 4: "마바 사차 화면", 5: "", 6: "가나 다마 12,3 가나다마", 7: "프롬프투 프롬프투"},
        2: {0: "콘텐초 워크플루", 1: "워크 플로 워크플로 워크플로 워크플로 워크플로 워크플로 워커플루"},
    }
    check(spark, rows, meta)


def check(spark, rows, meta):
    given = [(v, p, x, 1) for v, texts in rows.items() for p, x in texts.items()]
    df = spark.createDataFrame(given, "v long, p long, x string, _text int")
    m = spark.createDataFrame([(v, i, *r) for v, records in meta.items() for i, r in enumerate(records)], "v long, at int, source string, priority int, text string")
    got = {(r["v"], r["p"]): (r["repaired"], [tuple(c) for c in r["changes"]]) for r in evidence.repair_by_evidence(df, m, "v", "p", "x", editorial.canonical).collect()}
    want = {(v, p): y for v, texts in rows.items() for p, y in repair(texts, meta.get(v, [])).items()}
    assert got == want
    assert len(got) == len(given)
    return sum(len(c) for _, c in got.values())


def test_random_words_match_plain_python(spark):
    rnd = random.Random(8)
    syllables, meta, rows = "가나다라마", {}, {}
    word = lambda: "".join(rnd.choice(syllables) for _ in range(rnd.choice([2, 2, 3, 4]))) + rnd.choice(["", "", "를", "에서는"])
    for v in range(12):
        meta[v] = [(s, p, " ".join(word() for _ in range(6))) for s, p in (("video_title", 3), ("youtube_description", 2), ("creator_chapter_label", 3))]
        rows[v] = {p: "".join(word() + rnd.choice([" ", " ", ", ", "  "]) for _ in range(rnd.randint(0, 14))) for p in range(12)}
    assert check(spark, rows, meta) > 15


def test_query_matches_plain_python(spark):
    texts, meta = defaultdict(dict), defaultdict(list)
    for r in editorial.videos(spark, SF_DIR).orderBy("video", "pos").collect():
        texts[r["video"]][r["pos"]] = r["ko"]
    for r in editorial.metadata(spark, SF_DIR).orderBy("video", "at").collect():
        meta[r["video"]].append((r["source"], r["priority"], r["text"]))
    want = sorted((v, p, i, *c[:3], ",".join(c[3]), c[4]) for v, rows in texts.items() for p, (_, changes) in repair(rows, meta[v]).items() for i, c in enumerate(changes, 1))
    got = catalogue.QUERIES["evidence_repairs"](spark, SF_DIR).collect()
    assert sorted(tuple(r)[:8] for r in got) == want and len(want) > 3
