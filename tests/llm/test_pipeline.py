"""Each stage on odd rows, and the whole pipeline against the stages' rules by brute force."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from strandloom.llm import mixture, quality, sharding, simhash
from strandloom.llm.decontaminate import words_of

WORDS = "water stone river light paper green table music winter garden letter bridge window market forest silver simple answer morning evening".split()


def text(rnd, n):
    return " ".join(rnd.choice(WORDS) + str(rnd.randint(0, 99)) for _ in range(n)).capitalize() + "."


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rnd = random.Random(4)
    item = [w + "q" for w in text(rnd, 14).lower().strip(".").split()]
    docs = [(i, text(rnd, rnd.randint(30, 80)), f"s{i % 3}") for i in range(60)]
    docs += [(100 + i, "!! $$ ## " * rnd.randint(20, 60), "s1") for i in range(30)]  # junk
    docs += [(200, docs[5][1], "s2"), (201, docs[5][1] + " so", "s0"), (5, docs[5][1], "s2"), (5, docs[5][1], "s2")]  # copies, near copies, repeated rows
    docs += [(300, text(rnd, 20) + " " + " ".join(item[2:13]) + " " + text(rnd, 20), None), (301, None, "s1"), (302, "", None), (None, text(rnd, 40), "s0"), (303, text(rnd, 30_000), "s1"), (None, None, None)]
    rows = [(*d, "en", len(d[1] or ""), 1.5, "k", i, "h", 7) for i, d in enumerate(docs)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long, size double, _key string, row_no int, _hits string, target int")
    labels = [(i, 1, 0) for i in range(0, 60)] + [(100 + i, 0, 1) for i in range(30)] + [(None, 0, 0), (7, None, 0)]
    folder = tmp_path_factory.mktemp("corpus")
    df.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([("b1", " ".join(item)), ("b2", None), (None, "")], "item_id string, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def as_rows(df, columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_stages_one_after_the_other(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns = docs.columns
    # quality: what scores below the threshold goes
    kept = pipeline.quality_stage(spark, docs, tables)
    ranker = quality.train(docs, spark.read.parquet(f"{tables}/labels.parquet"))
    every = docs.collect()
    good = ranker.score(quality.features([r["text"].encode() if r["text"] is not None else None for r in every])) >= quality.ACCEPT
    assert as_rows(kept, columns) == sorted((tuple(r) for r, g in zip(every, good) if g), key=repr)
    left = [r for r, g in zip(every, good) if g]
    assert all(r["doc_id"] is None or not 100 <= r["doc_id"] < 130 for r in left) and sum(r["doc_id"] is not None and r["doc_id"] < 60 for r in left) >= 60
    # near duplicates: one row of each group within the radius
    once = pipeline.near_duplicate_stage(spark, spark.createDataFrame(left, docs.schema), tables).collect()
    prints = {r["text"]: int(r["fp"], 16) for r in simhash.near_duplicates(spark.createDataFrame(left, docs.schema)).select("text_hash", "fingerprint").distinct().join(docs.select("text", F.xxhash64("text").alias("text_hash")).distinct(), "text_hash").select("text", F.col("fingerprint").alias("fp")).collect()}
    prints[None] = 0
    group = list(range(len(left)))
    for i in range(len(left)):
        for j in range(i):
            if (prints[left[i]["text"]] ^ prints[left[j]["text"]]).bit_count() <= simhash.RADIUS and group[i] != group[j]:
                a, b = sorted((group[i], group[j]))
                group = [a if g == b else g for g in group]
    best = {}
    for r, g in zip(left, group):
        best.setdefault(g, []).append(r)
    least = [min((r["doc_id"] is None, r["doc_id"] or 0) for r in rows) for rows in best.values()]
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in once) == sorted(least) and len(once[0]) == len(columns)
    # decontamination: what holds ten words of an item in a row goes
    clean = pipeline.decontamination_stage(spark, spark.createDataFrame(once, docs.schema), tables).collect()
    items = [words_of((r["text"] or "").encode()) for r in spark.read.parquet(f"{tables}/benchmark.parquet").collect()]
    windows = {tuple(w[i : i + 10]) for w in items for i in range(len(w) - 9)}
    holds = lambda t: any(tuple(w[i : i + 10]) in windows for w in [words_of((t or "").encode())] for i in range(len(w) - 9))
    assert sorted(map(repr, clean)) == sorted(repr(r) for r in once if not holds(r["text"])) and len(clean) < len(once)
    # mixing: as often as the operator says
    before = spark.createDataFrame(clean, docs.schema)
    mixed = pipeline.mixing_stage(spark, before, tables)
    assert mixed.columns == columns
    told = mixture.mix(before.select("doc_id", "source", "text")).collect()
    expected = sorted((str(r["doc_id"]), str(r["text"])) for r in told for _ in range(r["copies"]))
    got = mixed.collect()
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in got) == expected
    assert {(r["doc_id"], r["size"], r["target"], r["_key"], r["row_no"]) for r in got} <= {(r["doc_id"], r["size"], r["target"], r["_key"], r["row_no"]) for r in clean}
    # sharding: every row has a place of its own
    placed = pipeline.sharding_stage(spark, mixed, tables).collect()
    n = len(got)
    assert sorted((r["shard"], r["slot"]) for r in placed) == sorted((k % 8, k // 8) for k in range(n))
    assert sorted(str((r["doc_id"], r["row_no"])) for r in placed) == sorted(str((r["doc_id"], r["row_no"])) for r in got)
    assert sharding.SEED


def test_the_whole_pipeline(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    for _, stage in pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, tables).collect(), docs.schema)
    rows = pipeline.run(spark, tables).collect()
    key = lambda r: str((r["doc_id"], r["text"], r["_hits"]))
    assert sorted(map(key, rows)) == sorted(map(key, docs.collect())) and {"shard", "slot"} < set(rows[0].asDict())


def test_empty_tables(spark, tables, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{tables}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert pipeline.run(spark, str(tmp_path)).collect() == []
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    assert pipeline.quality_stage(spark, docs, str(tmp_path)).count() == docs.count()
    assert pipeline.decontamination_stage(spark, docs, str(tmp_path)).count() == docs.count()
