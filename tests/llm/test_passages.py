import random

import numpy as np
import pyarrow as pa

from strandloom.llm import passages as p


def brute_windows(h, least):
    """Compact windows of one sequence by definition of the tree."""
    out = []

    def split(left, right):
        if right - left < least:
            return
        low = h[left:right].min()
        ties = [i for i in range(left, right) if h[i] == low]
        c = ties[len(ties) // 2]
        out.append((left, c, right))
        split(left, c)
        split(c + 1, right)

    split(0, len(h))
    return sorted(out)


def test_windows_match_the_tree():
    rnd = np.random.default_rng(2)
    for n, kinds in ((200, 1 << 40), (200, 5), (46, 9), (45, 9), (300, 1)):
        h = rnd.integers(0, kinds, n).astype(np.uint64)
        l, c, r = p.compact_windows(h, np.array([0]), np.array([n]))
        assert sorted(zip(l.tolist(), c.tolist(), r.tolist())) == brute_windows(h, p.LEAST)


def test_every_subsequence_is_in_one_window():
    h = np.random.default_rng(4).permutation(120).astype(np.uint64)
    l, c, r = p.compact_windows(h, np.array([0]), np.array([120]))
    for i in range(120 - p.LEAST):
        for j in range(i + p.LEAST, 121):
            mine = [k for k in range(len(l)) if l[k] <= i <= c[k] < j <= r[k]]
            assert len(mine) == 1 and h[i:j].min() == h[c[mine[0]]]


def test_words_are_hashed_alike_wherever_pieces_end(monkeypatch):
    text = "  Ab c\tAB  é\x0bab c " + "long" * 40 + " ab\n" + "x" * 300
    whole, places = p.word_hashes(np.frombuffer(text.encode(), np.uint8))
    assert len(whole) == len(text.split()) and len(set(whole.tolist())) == len(set(text.lower().split()))
    monkeypatch.setattr(p, "PIECE", 7)
    pieces, at = p.word_hashes(np.frombuffer(text.encode(), np.uint8))
    assert (pieces == whole).all() and (at == places).all()
    assert len(p.word_hashes(np.frombuffer(b" \n ", np.uint8))[0]) == 0


def block(rows):
    """A block of windows whose anchor is in the middle of 91 tokens, given as lists of 95 words."""
    n = len(rows)
    at = p.pack(np.zeros(n, np.int64), np.full(n, 45), np.full(n, 91), 0)
    return p.Block(np.zeros(n, np.int64), np.arange(n), at, [np.array(r, np.uint16).tobytes() for r in rows])


def test_similarity_against_sets():
    rnd = random.Random(9)
    for kinds in (60000, 3):
        for _ in range(60):
            a = [rnd.randrange(kinds) for _ in range(95)]
            b = list(a)
            for _ in range(rnd.randint(0, 4)):
                k = rnd.randrange(95)
                b = (b[:k] + [rnd.randrange(kinds)] + b[k + rnd.randint(0, 1) :] + a)[:95]
            both = block([a, b])
            x, y = ([tuple(w[i : i + 5]) for i in range(91)] for w in (a, b))
            sims = [len(set(x[i : i + 46]) & set(y[i : i + 46])) / len(set(x[i : i + 46]) | set(y[i : i + 46])) for i in range(46)]
            found = p.similar_starts(both, np.array([0]), np.array([1]))[0]
            assert found.any() == (max(sims) >= p.SIMILAR)
            assert not (found & (np.array(sims) < p.SIMILAR)).any()


def shingles(words):
    return [hash(tuple(words[i : i + 5])) for i in range(len(words) - 4)]


def brute(texts):
    """Classes of texts (lists of words) by all pairs of their 50-word passages, None for one without a link, and links."""
    sets = [[frozenset(t[i : i + 46]) for i in range(len(t) - 45)] for t in map(shingles, texts)]
    group, links = list(range(len(texts))), set()
    where = {}
    for k, t in enumerate(map(shingles, texts)):
        for i, x in enumerate(t):
            where.setdefault(x, []).append((k, i))
    for k in range(len(texts)):
        for i, s in enumerate(sets[k]):
            met = {}
            for x in s:
                for q, j in where[x]:
                    if q > k:
                        for o in range(max(0, j - 45), min(j, len(sets[q]) - 1) + 1):
                            met[q, o] = met.get((q, o), 0) + 1
            for (q, o), n in met.items():
                if n >= 30 and len(s & sets[q][o]) >= 0.8 * len(s | sets[q][o]):
                    links.add((k, q))
    for k, q in links:
        a, b = group[k], group[q]
        group = [min(a, b) if g in (a, b) else g for g in group]
    return [g if group.count(g) > 1 else None for g in group], links


def classes(spark, texts):
    df = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(texts)], "doc_id long, text string")
    return {r["doc_id"]: r for r in p.passage_classes(df).collect()}


def make(rnd, kinds=4000):
    return lambda n: [rnd.choice("abcdefghijklmnop") + str(rnd.randint(0, kinds)) for _ in range(n)]


def edited(rnd, passage, word="edit"):
    k = rnd.randrange(len(passage))
    return passage[:k] + [f"{word}{rnd.randint(0, 10**6)}"] + passage[k + rnd.randint(0, 1) :]


def test_whole_result_against_brute_force(spark):
    rnd = random.Random(21)
    words = make(rnd)
    line, texts = words(30), []
    for i in range(25):  # the frequent line in unlike texts
        texts.append(words(40) + line + words(40))
    for i in range(20):  # pairs that share a passage around it, some with an edit
        passage = words(12) + line + words(12)
        texts += [words(rnd.randint(0, 80)) + passage + words(30), words(30) + (edited(rnd, passage) if i % 2 else passage) + words(rnd.randint(0, 80))]
    for i in range(12):  # others, with one or two edits, from 50 words on
        passage = words(rnd.randint(50, 90))
        other = edited(rnd, passage) if i % 3 else edited(rnd, edited(rnd, passage))
        texts += [words(35) + passage + words(35), words(35) + other + words(35)]
    texts += [["w"] * 120, ["w"] * 90, words(49), []]
    rnd.shuffle(texts)
    expected, links = brute(texts)
    rows = classes(spark, texts)
    got = [rows[k]["class_id"] for k in range(len(texts))]
    caught = sum(got[a] is not None and got[a] == got[b] for a, b in links)
    wrong = [k for k in range(len(texts)) if got[k] is not None and expected[k] is None]
    print("links", len(links), "caught", caught)
    assert not wrong and len({frozenset(k for k in rows if got[k] == g) for g in got if g is not None}) >= 30
    assert caught >= 0.95 * len(links)
    equal = {}
    for k, w in enumerate(texts):
        for i in range(len(w) - 49):
            equal.setdefault(tuple(w[i : i + 50]), []).append((k, i))
    for places in equal.values():  # equal passages are caught without exception, every copy with its span
        if len({k for k, _ in places}) > 1:
            assert len({got[k] for k, _ in places}) == 1 and got[places[0][0]] is not None
            assert all(any(s["start"] <= i and i + 50 <= s["end"] for s in rows[k]["spans"]) for k, i in places)


def test_hot_groups_are_compared_in_blocks(spark):
    rnd = random.Random(12)
    words = make(rnd, 50000)
    line = words(60)
    texts = [words(20) + line + words(20) for _ in range(1300)]
    for i in range(10):
        passage = words(6) + line[:40] + words(6)
        texts += [words(70) + passage + words(70), words(70) + edited(rnd, passage) + words(70)]
    rows = classes(spark, texts)
    got = [rows[k]["class_id"] for k in range(len(texts))]
    assert set(got[:1300]) == {0}
    assert all(any(s["start"] <= 20 and s["end"] >= 80 for s in rows[k]["spans"]) for k in range(1300))
    pairs = [(got[k], got[k + 1]) for k in range(1300, len(texts), 2)]
    assert sum(a is not None and a == b for a, b in pairs) >= 9


def test_no_pair_of_a_large_key_is_left_out():
    """Pairs whose words other windows have too, and that sort far from each other on both sides."""
    rnd = random.Random(31)
    line, heads, tails = rnd.sample(range(60000), 30), [rnd.sample(range(60000), 14) for _ in range(20)], [rnd.sample(range(60000), 14) for _ in range(20)]
    rows = [rnd.sample(range(60000), 19) + h + line + t + rnd.sample(range(60000), 18) for h in heads for t in tails]
    for k in range(0, 40, 2):  # others with one word changed beside the line
        rows.append(rnd.sample(range(60000), 19) + rows[k * 10][19:32] + [60001 + k] + rows[k * 10][33:77] + rnd.sample(range(60000), 18))
    b = block(rows)
    i, j = np.triu_indices(len(rows), 1)
    near = p.similar_starts(b, i, j).any(axis=1)
    expected = set(zip(i[near].tolist(), j[near].tolist()))
    first = set(zip(*(x.tolist() for x in p.candidates(b))))
    rest = {pair for x, y in p.remaining(b, np.arange(len(rows)), np.zeros(len(rows), bool)) for pair in zip(x.tolist(), y.tolist())}
    assert len(expected) > 10 and not expected <= first and expected <= rest
    x, y, *_ = p.compare(b)
    assert all(any(k in (u, v) for u, v in zip(x.tolist(), y.tolist())) for pair in expected for k in pair)


def test_hot_windows_of_different_blocks_are_compared(spark):
    rnd = random.Random(41)
    words = make(rnd, 50000)
    line, heads, tails = words(30), [words(12) for _ in range(115)], [words(12) for _ in range(10)]
    texts = [words(40) + h + line + t + words(40) for h in heads for t in tails]
    pairs = [(k, len(texts) + n) for n, k in enumerate(range(0, len(texts), 50))]
    texts += [words(40) + texts[k][40:50] + ["other"] + texts[k][51:94] + words(40) for k, _ in pairs]
    rows = classes(spark, texts)
    caught = sum(rows[a]["class_id"] is not None and rows[a]["class_id"] == rows[b]["class_id"] for a, b in pairs)
    print("pairs", len(pairs), "caught", caught)
    assert caught >= 0.9 * len(pairs)


def test_windows_whose_words_repeat_meet_by_few_tokens():
    """One word over and over between others, as in junk: all windows hold its token many times, and only those alike as sets may meet."""
    rnd = random.Random(51)
    rows = []
    for _ in range(150):
        head = rnd.randint(10, 36)
        rows.append([rnd.choice([rnd.randrange(60000), 7, 8]) for _ in range(head)] + [1] * 46 + [rnd.choice([rnd.randrange(60000), 7, 8]) for _ in range(49 - head)])
    for k in range(0, 100, 2):  # one word changed
        at = rnd.choice([x for x in range(95) if not 36 <= x < 56])
        rows.append(rows[k][:at] + [rnd.randrange(60000)] + rows[k][at + 1 :])
    rows += [rnd.sample(range(60000), 20) + [1] * 5 + rnd.sample(range(60000), 70) for _ in range(50)]
    b, n = block(rows), len(rows)
    i, j = np.triu_indices(n, 1)
    expected = p.similar_starts(b, i, j).any(axis=1)
    counts = {}
    for x, t in enumerate(b.tokens):
        for token in t.tolist():
            counts.setdefault(token, set()).add(x)
    shared = [[{"place": q, "n": len(counts[token])} for q, token in enumerate(t.tolist()) if len(counts[token]) > 1] for t in b.tokens]
    columns = {"key": b.key, "uid": b.uid, "at": np.full(n, p.pack(np.array([0]), np.array([45]), np.array([91]), 0)[0])}
    words = [np.array(r, np.uint16) for r in rows]
    given = pa.table(columns | {"fore": [w[45:].tobytes() for w in words], "aft": [w[:50][::-1].tobytes() for w in words], "wid": np.arange(n)})
    given = given.append_column("shared", pa.array(shared, pa.list_(pa.struct([("place", pa.int32()), ("n", pa.int32())]))))
    given = given.append_column("spans", pa.array([[]] * n, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))))
    told = pa.Table.from_batches(list(p._first_tokens(iter(given.to_batches())))).to_pylist()
    of, wide = {}, {}
    for r in told:
        of.setdefault((r["token"], r["wid"]), []).append(r["wide"])
    assert all(len(x) == len(set(x)) for x in of.values())
    meets = {}
    for (token, w), x in of.items():
        meets.setdefault(token, set()).add(w)
    met = {(x, y) for s in meets.values() for x in s for y in s if x < y}
    assert expected.sum() > 20 and set(zip(i[expected].tolist(), j[expected].tolist())) <= met
    assert len(met) < len(i) / 4


def test_classes(spark):
    rnd = random.Random(3)
    words = make(rnd, 400)
    common, near = words(60), words(90)
    docs = []
    for i in range(30):
        w = words(rnd.randint(0, 300))
        if i in (3, 9, 17):
            k = rnd.randint(0, len(w))
            w = w[:k] + common + w[k:]
        if i in (5, 11):
            w = words(40) + near[:45] + ([near[45]] if i == 5 else ["other"]) + near[46:] + words(30)
        docs.append((i, " ".join(w)))
    docs += [(100, docs[20][1] + " tail"), (101, docs[20][1] + " tail"), (102, None), (103, ""), (104, "w " * 300), (105, "w " * 200), (None, docs[9][1]), (106, " ".join(words(20))), (107, None)]
    docs[20] = (20, " ".join(words(80)))
    docs += [(108, docs[20][1]), (108, docs[20][1])]
    df = spark.createDataFrame([(*d, "u", 1, b"b") for d in docs], "doc_id long, text string, uid string, at int, body binary")
    rows = p.passage_classes(df).collect()
    assert len(rows) == len(docs)
    classes = {}
    for r in rows:
        if r["class_id"] is not None:
            classes.setdefault(r["class_id"], set()).add(r["doc_id"])
    assert classes == {3: {3, 9, 17, None}, 5: {5, 11}, 100: {100, 101}, 104: {104, 105}, 20: {20, 108}}
    spans = {r["doc_id"]: r["spans"] for r in rows}
    assert all(b - a >= p.PASSAGE for s in spans.values() for a, b in s)
    assert spans[106] == [] and spans[102] == []
    assert p.passage_classes(df.limit(0)).collect() == []


def test_a_very_long_text(spark):
    rnd = random.Random(5)
    words = make(rnd, 10**6)
    passage = words(60)
    long = words(400_000) + passage + words(1000) + passage
    rows = classes(spark, [words(70) + passage + words(70), long, words(200)])
    assert [rows[k]["class_id"] for k in range(3)] == [0, 0, None]
    # a passage may run five words beyond what is equal and still be similar enough
    assert [(s["start"], s["end"]) for s in rows[1]["spans"]] == [(399_995, 400_065), (401_055, 401_120)]


def test_every_copy_has_its_span(spark):
    rnd = random.Random(7)
    words = make(rnd, 400)
    passage = words(60)
    texts = [[], []]
    for w in texts:
        for _ in range(20):
            w += passage + words(15)
    for r in classes(spark, texts).values():
        assert all(any(s["start"] <= at and at + 60 <= s["end"] for s in r["spans"]) for at in range(0, 20 * 75, 75))
