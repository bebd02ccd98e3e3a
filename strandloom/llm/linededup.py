"""Line deduplication over range-partitioned line hashes.

Every line that counts becomes a small row (key's hash, document, position). The rows are
range-partitioned and sorted by hash, document and position, and each task streams its range: the first row
of a hash names the document that keeps the line; rows of later documents are dropped lines. As document and
position are part of the range, a very common line spreads over many partitions. A partition that starts
within such a run learns its first document from one summary row per partition, and emits the run's
rows for that later decision.

The result is a compressed bitmap of kept lines per document, not text.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.llm.common import cut, fresh

SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_CHARS = 10

#: kind 0: a dropped line. 1: a line of the run that a partition starts with. 2: a partition's summary;
#: h1, h2 are its first hash, g1, g2 its last, first_doc the first document of the last one's run.
STREAMED = "kind int, part int, h1 long, h2 long, no_id boolean, doc_id long, text_hash long, n_lines int, pos int, first_none boolean, first_doc long, g1 long, g2 long"


def line_key(line: str) -> Column:
    return F.translate(F.btrim(F.col(line), F.lit(SPACE)), UPPER, LOWER)


def line_rows(docs: DataFrame, least_chars: int) -> DataFrame:
    """(h1, h2, no_id, doc_id, text_hash, n_lines, pos) of every line that is long enough; a null doc_id is 0 with no_id true."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    some = F.coalesce(F.col("doc_id").cast("long"), F.lit(0))
    base = docs.select(F.col("doc_id").isNull().alias("no_id"), some.alias("doc_id"), F.xxhash64("text").alias("text_hash"), lines.alias("lines"))
    flat = base.select("no_id", "doc_id", "text_hash", F.size("lines").alias("n_lines"), F.posexplode("lines").alias("pos", "line"))
    keyed = flat.withColumn("key", line_key("line")).where(F.char_length("key") >= least_chars)
    return keyed.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), F.col("key")).alias("h2"), "no_id", "doc_id", "text_hash", "n_lines", "pos")


def _stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    part = TaskContext.get().partitionId()
    names = [f.split()[0] for f in STREAMED.split(", ")]
    first = last = None  # (h1, h2)
    last_doc, last_none = 0, False

    def rows(pdf: pd.DataFrame, pick: np.ndarray, kind: int, of: np.ndarray, of_none: np.ndarray) -> pd.DataFrame:
        got = pdf[pick].assign(kind=kind, part=part, first_none=of_none[pick], first_doc=of[pick], g1=0, g2=0)
        return got[names]

    for pdf in batches:
        if not len(pdf):
            continue
        h1, h2 = pdf["h1"].to_numpy(), pdf["h2"].to_numpy()
        doc, none = pdf["doc_id"].to_numpy(), pdf["no_id"].to_numpy()
        new = np.concatenate(([last != (h1[0], h2[0])], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])))
        starts = np.flatnonzero(new)
        run = np.cumsum(new)  # 0: the run that the batch before ended in
        of, of_none = np.append(last_doc, doc[starts])[run], np.append(last_none, none[starts])[run]
        if first is None:
            first = (h1[0], h2[0])
        lead = (h1 == first[0]) & (h2 == first[1])
        if lead.any():
            yield rows(pdf, lead, 1, of, of_none)
        if (drop := ((doc != of) | (none != of_none)) & ~lead).any():
            yield rows(pdf, drop, 0, of, of_none)
        last, last_doc, last_none = (h1[-1], h2[-1]), of[-1], of_none[-1]
    if first is not None:
        yield pd.DataFrame([[2, part, *first, False, 0, 0, 0, 0, last_none, last_doc, *last]], columns=names)


def dropped_lines(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """(no_id, doc_id, text_hash, n_lines, pos) of every line that another document, of smaller id, holds as well."""
    order = ["h1", "h2", "no_id", "doc_id", "text_hash", "pos"]
    # written first: sampling for the ranges then doesn't split and hash the texts once more
    placed = cut(line_rows(docs, least_chars), "lines").repartitionByRange(*order).sortWithinPartitions(*order)
    seen = cut(placed.mapInPandas(_stream, STREAMED), "line-runs")
    carried, at, doc = [], None, None  # the run that goes on from one partition to the next
    for s in sorted(seen.where("kind = 2").select("part", "h1", "h2", "g1", "g2", "first_none", "first_doc").collect()):
        head, tail = (s["h1"], s["h2"]), (s["g1"], s["g2"])
        if head == at:
            carried.append((s["part"], *doc))
        if tail != at:
            at, doc = tail, (s["first_none"], s["first_doc"])
    carry = docs.sparkSession.createDataFrame(carried, "part int, carried_none boolean, carried long")
    owner = (F.coalesce("carried_none", "first_none"), F.coalesce("carried", "first_doc"))
    another = (F.col("no_id") != owner[0]) | (F.col("doc_id") != owner[1])
    heads = seen.where("kind = 1").join(F.broadcast(carry), "part", "left").where(another)  # one row per partition
    keep = ["no_id", "doc_id", "text_hash", "n_lines", "pos"]
    return seen.where("kind = 0").select(*keep).union(heads.select(*keep))


@F.pandas_udf(T.BinaryType())
def _bitmap(n_lines: pd.Series, drop: pd.Series) -> pd.Series:
    def pack(n: int, gone: np.ndarray) -> bytes:
        keep = np.ones(n, np.uint8)
        keep[gone] = 0
        return zlib.compress(np.packbits(keep).tobytes())

    return pd.Series([pack(n, g) for n, g in zip(n_lines, drop)])


def keep_bitmaps(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """(doc_id, text_hash, n_lines, keep) of every document that loses lines; all others keep theirs.

    keep is a zlib-compressed bitmap, first line in the highest bit; text_hash is xxhash64(text). A line's key is the
    line without ASCII space at both ends and with A-Z lower-cased; keys under least_chars code points never count.
    Rows of one doc_id are one document; those without doc_id are one, after all others. Equal rows
    share their bitmap. A null or empty text is one empty line.
    """
    gone = dropped_lines(docs, least_chars).groupBy("no_id", "doc_id", "text_hash").agg(F.max("n_lines").alias("n_lines"), F.collect_set("pos").alias("gone"))
    return cut(gone.select(F.when(~F.col("no_id"), F.col("doc_id")).alias("doc_id"), "text_hash", "n_lines", _bitmap("n_lines", "gone").alias("keep")), "bitmaps")


def unpack(keep: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8))[:n].astype(bool)


def with_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """docs with the column keep, which replaces one so named: null where all lines stay."""
    docs = docs.drop("keep")
    of, text = fresh(docs, "of", "text")
    maps = bitmaps.select(F.col("doc_id").alias(of), F.col("text_hash").alias(text), "keep")
    same = docs["doc_id"].eqNullSafe(maps[of]) & (F.xxhash64(docs["text"]) == maps[text])
    return docs.join(maps, same, "left").drop(of, text)


@F.pandas_udf(T.StructType([T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("kept_sha256", T.StringType())]))
def kept_digest(texts: pd.Series, keeps: pd.Series) -> pd.DataFrame:
    out = []
    for text, keep in zip(texts, keeps):
        lines = (text or b"").split(b"\n")
        kept = lines if keep is None else [x for x, stays in zip(lines, unpack(keep, len(lines))) if stays]
        out.append((len(lines), len(lines) - len(kept), hashlib.sha256(b"\n".join(kept)).hexdigest()))
    return pd.DataFrame(out, columns=["n_lines", "n_dropped", "kept_sha256"])
