import hashlib

from pyspark.sql import functions as F

from strandloom.llm import linededup as ld

SPACE = " \t\n\x0b\x0c\r"


def brute(docs):
    def key(line):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(SPACE))

    far = 2**63  # after every id
    owner = {}
    for d, t in docs:
        for line in (t or "").split("\n"):
            if len(k := key(line)) >= 10:
                owner[k] = min(owner.get(k, far), far if d is None else d)
    out = []
    for d, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or owner[key(x)] == (far if d is None else d)]
        out.append((str(d), len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out)


def run(spark, docs):
    df = spark.createDataFrame([(d, t, b"x", 1, "of") for d, t in docs], "doc_id long, text string, keep binary, _TEXT int, _of string")
    kept = ld.with_bitmaps(df, ld.keep_bitmaps(df)).select("doc_id", ld.kept_digest(F.col("text").cast("binary"), "keep").alias("d"))
    return sorted((str(r[0]), *r[1]) for r in kept.collect())


def test_matches_brute_force(spark):
    docs = []
    for i in range(80):
        lines = [f"line number {i * j % 23} of all" for j in range(i % 7)] + ["A very common line, everywhere", "short", ""]
        docs.append((i, "\n".join(lines if i % 2 else [x.upper() + " \t" for x in lines])))
    docs += [(200, None), (201, ""), (202, "a very common line, everywhere\n" * 3), (None, "a very common line, everywhere"), (None, "a line without id\nshort")]
    docs += [(3, docs[3][1]), (3, "another text of three"), (90, "Éééééééééé\nÉéééééééé"), (91, "Éééééééééé\néÉéééééééé\nÉéééééééé"), (92, " nine chr \n nine chr ")]
    assert run(spark, docs) == brute(docs)


def test_one_line_over_many_partitions(spark):
    docs = [(i, "the same line in every text\nown line of document %d" % i) for i in range(3000)]
    assert run(spark, docs) == brute(docs)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_ids_beyond_doubles_beside_nulls(spark):
    big = 2**60
    docs = [(big + 1, "a line that two documents share"), (big + 2, "a line that two documents share"), (None, "a line of no document"), (2**63 - 1, "a line of no document"), (None, "a line of no document\nand one more line")]
    got = run(spark, docs)
    assert got == brute(docs) and (str(big + 2), 1, 1, hashlib.sha256(b"").hexdigest()) in got


def test_a_very_long_text(spark):
    long = "\n".join(f"line {i % 5000} of a very long text" for i in range(200_000))
    docs = [(2, long), (1, "line 7 of a very long text\nline 8 of a very long text"), (3, "x" * 2_000_000)]
    assert run(spark, docs) == brute(docs)
