import random
import re

from pyspark.sql import functions as F

from strandloom.llm import decontaminate as d


def brute(docs, bench):
    find = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())
    out = []
    for doc, text in docs:
        words, hit, ids = find(text), set(), set()
        for item, body in bench:
            w = find(body)
            k = min(10, len(w))
            for i in range(len(w) - k + 1 if w else 0):
                for j in range(len(words) - k + 1):
                    if words[j : j + k] == w[i : i + k]:
                        hit |= set(range(j, j + k))
                        if item is not None:
                            ids.add(str(item))
        out.append((str(doc), len(words), len(hit), sorted(ids)))
    return sorted(out)


def tables():
    rnd = random.Random(3)
    word = lambda: rnd.choice(["a", "b", "the", "of", "É1", "x9"])
    bench = [(i, " ".join(word() for _ in range(rnd.randint(0, 25)))) for i in range(20)] + [(None, "of the x9 a b the"), (7, "É1 É1"), (50, None), (51, "...")]
    docs = []
    for i in range(60):
        text = " ".join(word() for _ in range(rnd.randint(0, 60)))
        if i % 4 == 0:
            text += "... " + (bench[i % 20][1] or "").upper().replace(" ", "-\n") + " end"
        docs.append((i, text))
    return docs + [(60, None), (61, ""), (None, "of the x9 a b the"), (3, docs[3][1]), (3, docs[3][1])], bench


def run(spark, docs, bench, **how):
    left = spark.createDataFrame([(a, b, "mine") for a, b in docs], "doc_id long, text string, n_words string")
    marked = d.mark_hits(left, spark.createDataFrame(bench, "item_id long, text string"), **how)
    rows = marked.select("doc_id", "hits.n_words", d.n_hit("hits").alias("n_hit"), "hits.items", F.col("n_words").alias("own")).collect()
    assert {r["own"] for r in rows} <= {"mine"}
    return sorted((str(r[0]), r[1], r[2], list(r[3])) for r in rows)


def test_matches_brute_force(spark):
    docs, bench = tables()
    assert run(spark, docs, bench) == brute(docs, bench)


def test_blocks_of_the_benchmark(spark):
    docs, bench = tables()
    assert run(spark, docs, bench, block_bytes=200) == brute(docs, bench)


def test_empty_tables(spark):
    docs, bench = tables()
    assert run(spark, docs[:3], []) == brute(docs[:3], [])
    assert run(spark, [], bench[:3]) == []
