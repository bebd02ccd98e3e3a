import random
import re
from collections import Counter

import duckdb
import numpy as np

from strandloom.llm import catalogue, collocations as co

UPPER = {c: c + 32 for c in range(65, 91)}


def brute(docs, few=2, many=3, least=10, cover=50, top=2000):
    count, total = Counter(), Counter()
    for lang, text in docs:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for k in range(1, many + 1):
                for i in range(len(w) - k + 1):
                    count[lang, tuple(w[i : i + k])] += 1
    candidates = {p: a for p, a in count.items() if few <= len(p[1]) <= many and a >= least}
    longest = Counter()
    for (lang, p), a in candidates.items():
        for k in range(few, len(p)):
            for i in range(len(p) - k + 1):
                longest[lang, p[i : i + k]] = max(longest[lang, p[i : i + k]], a)
    rows = {}
    for (lang, p), a in candidates.items():
        if longest[lang, p] and 100 * longest[lang, p] >= cover * a:
            continue
        cuts = [(1_000_000 * a * a // (count[lang, p[:k]] * count[lang, p[k:]]), k, count[lang, p[:k]], count[lang, p[k:]]) for k in range(1, len(p))]
        score, _, l, r = min(cuts)
        rows.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), l, r))
    return sorted((lang, i, p.decode(), -a, l, r, total[lang], -s) for lang, found in rows.items() for i, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1))


def run(spark, docs, **options):
    df = spark.createDataFrame([(lang, t, 1, "x", b"") for lang, t in docs], "lang string, text string, n int, PHRASE string, doc_id binary")
    return sorted(map(tuple, co.phrases(df, **options).collect()))


def texts(n, seed=3):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)] + ["É", "ÜBER", "The", "tHE"]
    out = []
    for i in range(n):
        words = rnd.choices(vocabulary, [1 / (k + 1) for k in range(len(vocabulary))], k=rnd.randint(0, 90))
        for at in range(0, len(words) - 3, 17):
            words[at : at + 3] = ["New", "york", "City"]
        out.append((rnd.choice(["en", "de", None, "und"]), "".join(w + rnd.choice([" ", " ", "  ", "\t", ", ", ".\n", "\x0b", " ! "]) for w in words)))
    return out


def test_matches_brute_force(spark):
    docs = texts(250) + [("en", None), ("en", ""), (None, None), ("fr", "no phrase often enough")]
    docs += [("en", "a a a a a a a a a a a a")] * 3 + [("xx", "same line again and again")] * 12
    want = brute(docs)
    assert run(spark, docs) == want and len({r[0] for r in want}) == 4
    assert run(spark, docs, bits=10) == want  # a filter that is nearly full only lets more through
    assert run(spark, docs, least=30, top=7, cover=80) == brute(docs, least=30, top=7, cover=80)


def test_phrases_of_up_to_four_words(spark):
    docs = texts(120, 9)
    assert run(spark, docs, many=4) == brute(docs, many=4)


def test_a_very_long_text_and_words(spark):
    docs = [("en", " ".join(f"w{i % 301} w{i % 7}" for i in range(150_000))), ("en", ("x" * 3000 + " " + "y" * 3000 + "\n") * 15), ("en", "x" * 1_500_000)]
    assert run(spark, docs) == brute(docs)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_summary_keeps_all_that_is_frequent():
    """Merged in any parts, no count falls short by the threshold over SLACK or more."""
    rnd = np.random.default_rng(4)
    for trial in range(30):
        stream = np.concatenate([rnd.integers(0, 1 << 40, 30_000), np.repeat(rnd.integers(0, 1 << 40, 200), rnd.integers(5, 60, 200))]).astype(np.uint64)
        rnd.shuffle(stream)
        least = 20
        summary = co.Summary(co.SLACK * len(stream) // least + 1)
        for part in np.array_split(stream, rnd.integers(1, 40)):
            summary.add(*np.unique(part, return_counts=True))
        keys, counts = np.unique(stream, return_counts=True)
        assert set(keys[counts >= least]) <= set(summary.survivors(least))
        assert summary.taken < least / co.SLACK and len(summary.shrink()[0]) <= summary.capacity


def test_counts_beyond_64_bit_products(spark):
    a = 9 * 10**15
    exact = spark.sql(f"SELECT cast({a}L as decimal(16, 0)) * cast({a}L as decimal(16, 0)) * 1000000 div (cast({a}L as decimal(16, 0)) * cast({a + 7}L as decimal(16, 0))) AS s").first()["s"]
    assert exact == 1_000_000 * a * a // (a * (a + 7))


def test_query_matches_its_sql(spark):
    from strandloom.llm import queries

    sf = "/root/testdata/sf0.001"
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    told = duckdb.sql(catalogue.ORACLES["op11_phrases"])
    got = queries.op11_phrases(spark, sf)
    assert got.columns == told.columns
    assert sorted(map(tuple, got.collect())) == sorted(told.fetchall())
