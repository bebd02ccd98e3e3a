"""Safety of proposed spellings and families of spellings, against plain Python and by hand."""

import difflib
import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from strandloom.functions.wordlists import DESCRIPTORS, STOPWORDS
from strandloom.operators import mappings as m
from strandloom.plans import catalogue, editorial

SF_DIR = "/root/testdata/sf0.001"
TOKEN = re.compile(r"[A-Za-z0-9+#_-]+(?:\.[A-Za-z0-9+#_-]+)*")


def key(x):
    return re.sub("[^a-z0-9]+", "", x.lower())


def like(a, b):
    return difflib.SequenceMatcher(None, a, b, autojunk=False).ratio()


def clean(x):
    return re.sub(r"\s+", " ", x or "").strip(" \t\n\r.,:;!?()[]{}\"'“”‘’")


def reason(raw, canonical, texts, names):
    raw, canonical = clean(raw), clean(canonical)
    if not raw or not canonical:
        return "empty"
    if raw.lower() == canonical.lower():
        return "same"
    if re.search(r"https?://|(?:[A-Za-z0-9_-]+\.)+(?:com|ai|io|dev|app|net|org)|\{slash\}|(?<!\w)/[A-Za-z0-9_./-]+", raw, re.I):
        return "literal"
    if not any(raw.lower() in t.lower() for t in texts):
        return "unheard"
    if raw.lower() in {n.lower() for n, _ in names}:
        return "established"
    rk, ck, rt, ct = key(raw), key(canonical), TOKEN.findall(raw), TOKEN.findall(canonical)
    if len(rt) >= 2 and len(ct) == 1 and rk and ck and ck in rk and len(rk.replace(ck, "", 1)) >= 4:
        return "collapse"
    if rk and ck and (ck.startswith(rk) or rk.startswith(ck)) and abs(len(rk) - len(ck)) >= 4:
        return "expansion"
    words = [w.lower() for w in re.findall(r"[A-Za-z][A-Za-z0-9+#_-]*", canonical)]
    words = [w for w in words if w != "s" and w not in DESCRIPTORS and w not in STOPWORDS]
    if not words:
        return "no_significant_word"
    known = {t.lower() for n, _ in names for t in TOKEN.findall(n)} - set(DESCRIPTORS)
    for t in texts:
        for w in re.findall(r"(?<![A-Za-z0-9])([A-Za-z][A-Za-z0-9+#_-]{2,})(?![A-Za-z0-9])", t):
            if (any(c.isupper() for c in w[1:]) or any(c.isdigit() for c in w)) and w.lower() not in DESCRIPTORS and w.lower() not in STOPWORDS:
                known.add(w.lower())
    if not all(w in known or any(w[0] == k[0] and abs(len(w) - len(k)) <= 2 and like(w, k) >= 0.86 for k in known) for w in words):
        return "unsupported_word"
    for name, verified in names:
        technical = re.search("^.+[A-Z0-9]|^[A-Z0-9]+$", name)
        if verified and len(TOKEN.findall(name)) == 1 and technical and len(key(name)) >= 5 and len(rt) >= 2:
            spelt = any(key(" ".join(rt[i : i + k])) == key(name) for k in (2, 3) for i in range(len(rt) - k + 1))
            if spelt and not re.search(rf"(?<![A-Za-z0-9]){re.escape(name)}(?![A-Za-z0-9])", canonical, re.I):
                return "swapped_name"
    return None


def families(phrases, accepted, texts, labels, names):
    """{nth: (canonical, family)} of one video, one phrase after another."""
    spelt = defaultdict(list)
    for raw, canonical in accepted.items():
        if (canonical, True) in names and len(TOKEN.findall(canonical)) == 1 and raw.lower() != canonical.lower() and any(raw.lower() in t.lower() for t in texts):
            spelt[canonical].append(raw)
    verified, out = {t.lower() for n, ok in names if ok for t in TOKEN.findall(n)}, {}
    for nth, raw in sorted(phrases.items()):
        if raw in accepted or len(key(raw)) < 5:
            continue
        scored = []
        for canonical, witnesses in spelt.items():
            top, named = max(like(key(raw), key(w)) for w in witnesses), like(key(raw), key(canonical))
            chapter = any(raw.lower() in t.lower() and (key(canonical) in key(x) or key(x) in key(canonical)) for t, x in zip(texts, labels))
            first, n = TOKEN.findall(raw)[0].lower(), len({key(w) for w in witnesses})
            if first in verified and first != canonical.lower():
                ok = chapter and n >= 2 and top >= 0.70
            else:
                ok = (chapter and n >= 2 and top >= 0.68) or (n >= 2 and top >= 0.74 and named >= 0.58) or top >= 0.84
            if ok:
                scored.append((top + 0.10 * chapter + min(0.06, 0.02 * n), canonical, n))
        scored.sort(reverse=True)
        if scored and (len(scored) == 1 or scored[0][0] - scored[1][0] >= 0.08) and reason(raw, scored[0][1], texts, names) is None:
            spelt[scored[0][1]].append(raw)
            out[nth] = scored[0][1:]
    return out


def frames(spark, texts, names):
    t = spark.createDataFrame([(v, i, x, label) for v, rows in texts.items() for i, (x, label) in enumerate(rows)], "video string, pos int, text string, label string")
    return t, spark.createDataFrame([(v, n, ok) for v, ns in names.items() for n, ok in ns], "video string, name string, verified boolean")


TEXTS = {
    "a": [("We use Hyper frames with Nova", "Intro"), ("Cloud kode, cloud code and X hyper frames", "CloudCode"), ("HyperFrames or Claude then", ""), ("Ab c", "x"), ("Sandy and OpenAI and Open board", "OpenBoard")],
    "b": [("nothing of that", "")],
}
NAMES = {"a": [("HyperFrames", True), ("CloudCode", True), ("Claude", False), ("Sandy Lee", True), ("OpenBoard", True)], "b": [("HyperFrames", True)]}


def test_each_reason_by_hand_and_by_plain_python(spark):
    cases = [
        ("", "X", "empty"), ("Cloud Code", "cloud code", "same"), ("claude.ai", "Claude", "literal"), ("hyper cloud", "HyperFrames", "unheard"), ("Claude", "CloudCode", "established"),
        ("X hyper frames or Claude", "HyperFrames", "unheard"), ("We use Hyper frames", "HyperFrames", "collapse"), ("Nova", "Novastudio", "expansion"), ("Sandy", "Sandy Lee", None), ("Ab c", "The app", "no_significant_word"), ("Nova", "Zephyr", "unsupported_word"),
        ("Hyper frames", "CloudCode", "swapped_name"), ("Cloud kode", "CloudCode", None), ("hyper frames", "Nova's HyperFrames", "unsupported_word"), ("Open board", "OpenBoards", "swapped_name"), (" Cloud kode. ", "CloudCode", None), ("b c", "Claude", None),
    ]
    t, n = frames(spark, TEXTS, NAMES)
    given = spark.createDataFrame([("a", r, c) for r, c, _ in cases] + [("b", "Hyper frames", "HyperFrames"), ("b", None, "HyperFrames")], "video string, raw string, canonical string")
    got = {(r["video"], r["raw"], r["canonical"]): r["reason"] for r in m.mapping_safety(given, t, n).collect()}
    want = {("a", r, c): reason(r, c, [x for x, _ in TEXTS["a"]], NAMES["a"]) for r, c, _ in cases}
    assert {(r, c): want["a", r, c] for r, c, _ in cases} == {(r, c): y for r, c, y in cases}
    assert got == want | {("b", "Hyper frames", "HyperFrames"): "unheard", ("b", None, "HyperFrames"): "empty"}


def test_order_decides_what_a_family_takes(spark):
    """The second phrase is near the first only, which must have joined before."""
    texts = {"a": [("Midjurney of old", "x"), ("Midjurnee and Mitjurnee", "x")]}
    names = {"a": [("Midjourney", True)]}
    t, n = frames(spark, texts, names)
    accepted = spark.createDataFrame([("a", "Midjurney", "Midjourney")], "video string, raw string, canonical string")

    def run(phrases):
        p = spark.createDataFrame([("a", i, x) for i, x in phrases.items()], "video string, nth long, raw string")
        got = {r["nth"]: (r["canonical"], r["family"]) for r in m.propagate_families(p, accepted, t, n).collect() if r["canonical"]}
        assert got == families(phrases, {"Midjurney": "Midjourney"}, [x for x, _ in texts["a"]], ["x", "x"], names["a"])
        return {phrases[i]: x for i, x in got.items()}

    assert run({1: "Midjurnee", 2: "Mitjurnee"}) == {"Midjurnee": ("Midjourney", 1), "Mitjurnee": ("Midjourney", 2)}
    assert run({1: "Mitjurnee", 2: "Midjurnee"}) == {"Midjurnee": ("Midjourney", 1)}


def test_occurrences_search_only_rows_with_the_rarest_gram(spark):
    rnd = random.Random(3)
    rows = [("v", i, "".join(rnd.choice("abAB .") for _ in range(rnd.randint(0, 30)))) for i in range(200)]
    asked = [("v", "".join(rnd.choice("abAB .") for _ in range(rnd.randint(1, 6)))) for _ in range(60)] + [("w", "a")]
    got = m.occurrences(spark.createDataFrame(asked, "video string, phrase string"), spark.createDataFrame(rows, "video string, pos int, text string"))
    want = {(v, p, i) for v, p in asked for w, i, x in rows if v == w and p.lower() in x.lower()}
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)


def test_queries_match_plain_python(spark):
    texts, labels, names, accepted, phrases = (defaultdict(list), defaultdict(list), defaultdict(set), defaultdict(dict), defaultdict(dict))
    for r in editorial.heard_parts(spark, SF_DIR).orderBy("pos").collect():
        texts[r["video"]].append(r["text"])
        labels[r["video"]].append(r["label"])
        names[r["video"]].add((r["canonical"], True))
        if r["pos"] % 3 == 0:
            accepted[r["video"]][r["raw"]] = r["canonical"]
        phrases[r["video"]].setdefault(r["raw"], r["pos"])
    rows = catalogue.QUERIES["mapping_reasons"](spark, SF_DIR).collect()
    assert all((reason(r["raw"], r["canonical"], texts[r["video"]], names[r["video"]]) or "safe") == r["reason"] for r in rows)
    assert {"safe", "literal", "unheard", "unsupported_word", "swapped_name"} <= {r["reason"] for r in rows}
    got = defaultdict(dict)
    for r in catalogue.QUERIES["variant_families"](spark, SF_DIR).where(F.col("canonical").isNotNull()).collect():
        got[r["video"]][r["nth"]] = (r["canonical"], r["family"])
    want = {v: f for v in texts if (f := families({n: raw for raw, n in phrases[v].items()}, accepted[v], texts[v], labels[v], names[v]))}
    assert dict(got) == want and sum(map(len, want.values())) > 5
