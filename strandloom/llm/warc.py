"""WARC archives with deduplicated payloads and a two-level capture index.

Writing: one record per page, as plain WARC text files that Spark's text writer makes (a record's two closing line
ends are the writer's line separator). Of equal payloads, the one of the smallest page_id is a response; the
others are revisits that refer to it.

Index: captures are sorted by a reversed-host URL key (and page, so that keys hardly repeat) into compressed
blocks; a sparse directory holds each block's first key. A lookup finds its block by binary search in the
directory, the capture by binary search in the block, and then reads the record's byte range of its archive: captures are
sorted by path and offset, and each task opens the archives of its rows in the shared file system, seeks to the ranges and reads
``READ_BYTES`` at a time, with ranges that lie close to each other in one read. No archive is ever loaded whole. The
directory is broadcast while it has at most ``DIRECTORY_MOST`` entries. Beyond that every k-th entry
is, and the entries between two of these come by a join.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.llm.common import cut, shared_dir

ARCHIVE_BYTES = 32 << 20
BLOCK_LINES = 3000
READ_BYTES = 1 << 20
GAP_BYTES = 1 << 16  # between ranges that are read together
STRETCH = 8 << 20  # of an archive whose captures go to one task
DIRECTORY_MOST = 100_000
END = "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def url_key(url: Column) -> Column:
    """com,example,www)/path?query: the host's labels reversed, no scheme, user, default port or fragment; null is an empty key."""
    url = F.coalesce(url, F.lit(""))
    authority = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?"
    host = F.lower(F.regexp_extract(url, authority + r"([^/?#:]+)", 1))
    port = F.regexp_extract(url, authority + r"[^/?#:]+(:\d+)", 1)
    path = F.regexp_replace(F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*", ""), r"#[\s\S]*$", "")
    key = F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.when(port.isin(":80", ":443"), "").otherwise(port), F.lit(")"), F.when(path == "", "/").otherwise(path))
    return F.when(host == "", url).otherwise(key)


def target_uri(url: Column) -> Column:
    """A URL as records hold it: null is empty, line breaks are escaped."""
    return F.replace(F.replace(F.coalesce(url, F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def capture_key(url: Column, page_id: Column) -> Column:
    """The key of a page's capture, from the URL as its record holds it."""
    return F.concat(url_key(target_uri(url)), F.lit(" "), F.coalesce(page_id.cast("string"), F.lit("-")))


@F.pandas_udf(T.StringType())
def _base32(sha1_hex: pd.Series) -> pd.Series:
    return pd.Series([base64.b32encode(bytes.fromhex(x)).decode() for x in sha1_hex])


def write_archives(pages: DataFrame, least_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> str:
    """Writes pages (page_id, url, html) as WARC files of about archive_bytes (by the pages' mean size) at most; returns their folder.

    Payloads of at least least_bytes are deduplicated. A null html is an empty payload. Rows of the
    smallest page_id are all responses if it repeats; a payload none of whose pages has an id is stored with each.
    """
    payload = F.coalesce("html", F.lit(""))
    base = pages.select("page_id", "url", payload.alias("html"), F.sha1(payload.cast("binary")).alias("sha1"), F.octet_length(payload).alias("n"))
    keys = cut(base.select("page_id", "sha1", "n"), "payloads")
    first = keys.where(F.col("n") >= least_bytes).groupBy("sha1").agg(F.min("page_id").alias("first"), F.count("*").alias("copies"))
    first = cut(first.where("copies > 1").select("sha1", "first"), "copied-payloads")
    rows, total = keys.agg(F.count("*"), F.sum("n")).first()
    per_file = max(1, int(archive_bytes * rows // ((total or 0) + 700 * rows))) if rows else 1
    known = base.join(first, "sha1", "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    http = F.concat(F.lit(HTTP), F.col("n").cast("string"), F.lit(END))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("html")))
    header = F.concat_ws(
        "\r\n",
        F.lit("WARC/1.1"),
        F.when(revisit, F.lit("WARC-Type: revisit")).otherwise(F.lit("WARC-Type: response")),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">")),
        F.concat(F.lit("WARC-Target-URI: "), target_uri(F.col("url"))),
        F.lit(f"WARC-Date: {DATE}"),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), _base32("sha1")),
        F.when(revisit, F.lit(f"WARC-Profile: {REVISIT_PROFILE}")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: <urn:page:"), F.col("first").cast("string"), F.lit(">"))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    )
    folder = f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    known.select(F.concat(header, F.lit(END), block).alias("value")).write.option("lineSep", END).option("maxRecordsPerFile", per_file).text(folder)
    return folder


def parse_record(data: bytes, at: int) -> tuple[dict[str, str], int, int]:
    """(headers, start of the block, end of the record) of the record at an offset."""
    head_end = data.index(b"\r\n\r\n", at)
    lines = data[at:head_end].decode().split("\r\n")
    headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    start = head_end + 4
    return headers, start, start + int(headers["Content-Length"]) + 4


CAPTURES = "page string, url string, path string, offset long, length long"


def storage(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path as Spark tells it, and the file's name there.

    Spark doesn't encode paths, so only scheme and authority are read as a URI; s3a and s3n are s3 here. Schemes that only Hadoop knows need its
    native library on the executors.
    """
    scheme, colon, rest = path.partition(":")
    if not colon or "/" in scheme or scheme == "file":
        return fs.LocalFileSystem(), "/" + (rest if colon else path).lstrip("/")
    authority, _, name = rest.removeprefix("//").partition("/")
    system, base = fs.FileSystem.from_uri(f"{ {'s3a': 's3', 's3n': 's3'}.get(scheme, scheme) }://{authority}/")
    return system, f"{base.rstrip('/')}/{name}"


class Archive:
    """A file of the shared file system, read by ranges."""

    def __init__(self, path: str) -> None:
        system, name = storage(path)
        self.file = system.open_input_file(name)
        self.size, self.at, self.held = self.file.size(), 0, b""

    def read(self, offset: int, length: int, ahead: int = 0) -> bytes:
        """A range's bytes; ahead bytes beyond it are read along if the file is read at all."""
        start = offset - self.at
        if start < 0 or start + length > len(self.held):
            self.held = self.file.read_at(min(length + ahead, self.size - offset), offset)
            self.at, start = offset, 0
        return self.held[start : start + length]


def _records(archive: Archive) -> Iterator[tuple[dict[str, str], int, int]]:
    """(headers, offset, length) of every record, with READ_BYTES of the archive in memory (or one record's head)."""
    at = 0
    while at < archive.size:
        size = 2048
        while (end := (head := archive.read(at, min(size, archive.size - at), READ_BYTES)).find(b"\r\n\r\n")) < 0:
            size *= 2  # a very long URL
        lines = head[:end].decode().split("\r\n")
        headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
        length = end + 4 + int(headers["Content-Length"]) + 4
        yield headers, at, length
        at += length


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["page", "url", "path", "offset", "length"]
    for pdf in batches:
        for path in pdf["path"]:
            rows = []
            for headers, at, length in _records(Archive(path)):
                rows.append((headers["WARC-Record-ID"][10:-1], headers["WARC-Target-URI"], path, at, length))
                if len(rows) == 10_000:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
            yield pd.DataFrame(rows, columns=names)


def scan_captures(spark, folder: str) -> DataFrame:
    """page, url, path, offset and length of every record, from the archives themselves; tasks read them piece by piece."""
    paths = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("path")
    return cut(paths.mapInPandas(_scan, CAPTURES), "captures")


def _pack(batches: Iterator[pd.DataFrame], lines_per_block: int) -> Iterator[pd.DataFrame]:
    part, seq, held = TaskContext.get().partitionId(), 0, []

    def block() -> pd.DataFrame:
        body = "\n".join(json.dumps(x, ensure_ascii=False) for x in held).encode()
        return pd.DataFrame([[part, seq, held[0][0], len(held), zlib.compress(body)]], columns=["part", "seq", "first_key", "n", "data"])

    for pdf in batches:
        for row in pdf.itertuples(index=False):
            held.append(list(row))
            if len(held) == lines_per_block:
                yield block()
                seq, held = seq + 1, []
    if held:
        yield block()


def build_index(captures: DataFrame, lines_per_block: int = BLOCK_LINES) -> DataFrame:
    """Blocks (block, first_key, n, data) of captures (key, page, path, offset, length); block numbers follow the keys' order."""
    order = ["key", "path", "offset"]
    rows = captures.select("key", "page", "path", "offset", "length").repartitionByRange(*order).sortWithinPartitions(*order)
    packed = rows.mapInPandas(lambda it: _pack(it, lines_per_block), "part int, seq int, first_key string, n int, data binary")
    return cut(packed.select((F.shiftleft(F.col("part").cast("long"), 32) + F.col("seq")).alias("block"), "first_key", "n", "data"), "index")


def _span(first_keys: list[bytes], key: bytes) -> range:
    """Places of a sorted directory whose blocks may hold the key: the last that begins below it, and all that begin with it."""
    return range(max(0, bisect.bisect_left(first_keys, key) - 1), bisect.bisect_right(first_keys, key))


def _find_blocks(keys: DataFrame, index: DataFrame, most: int) -> DataFrame:
    """(key, block) for every block that may hold a key."""
    spark, n = keys.sparkSession, index.count()
    stride = -(-n // most) or 1
    listed = index.select("block", "first_key")
    if stride > 1:
        # number the directory in its own order; keep every stride-th entry for the broadcast
        from strandloom.llm.common import number_rows

        listed = number_rows(listed, [F.col("first_key").asc(), F.col("block").asc()], "directory")
        coarse = listed.where(F.col("row_no") % stride == 0).select((F.col("row_no") / stride).cast("long").alias("block"), "first_key")
    else:
        coarse = listed
    # bytes compare as Spark sorts strings
    entries = sorted((r["first_key"].encode(), r["block"]) for r in coarse.collect())
    shared = spark.sparkContext.broadcast(([k for k, _ in entries], [b for _, b in entries]))

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def search(wanted: pd.Series) -> pd.Series:
        first_keys, blocks = shared.value
        return pd.Series([[blocks[i] for i in _span(first_keys, k.encode())] for k in wanted])

    found = keys.select("key", F.explode(search("key")).alias("block"))
    if stride == 1:
        return found
    fine = listed.groupBy(F.expr(f"row_no div {stride}").alias("segment")).agg(F.array_sort(F.collect_list(F.struct("first_key", "block"))).alias("entries"))

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def search_segment(wanted: pd.Series, first_keys: pd.Series, blocks: pd.Series) -> pd.Series:
        return pd.Series([[b[i] for i in _span([x.encode() for x in f], k.encode())] for k, f, b in zip(wanted, first_keys, blocks)])

    within = found.withColumnRenamed("block", "segment").join(fine, "segment")
    return within.select("key", F.explode(search_segment("key", "entries.first_key", "entries.block")).alias("block"))


def _read_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for wanted, data in zip(pdf["wanted"], pdf["data"]):
            lines = [json.loads(x) for x in zlib.decompress(data).split(b"\n")]
            keys, rows = [x[0].encode() for x in lines], []
            for key in wanted:
                k = key.encode()
                rows += lines[bisect.bisect_left(keys, k) : bisect.bisect_right(keys, k)]
            yield pd.DataFrame(rows, columns=["key", "page", "path", "offset", "length"])


def lookup(keys: DataFrame, index: DataFrame, most: int = DIRECTORY_MOST) -> DataFrame:
    """The captures (key, page, path, offset, length) of the different keys (one column, key)."""
    found = _find_blocks(keys.distinct(), index, most)
    wanted = found.groupBy("block", F.pmod(F.xxhash64("key"), F.lit(4)).alias("part")).agg(F.collect_list("key").alias("wanted"))
    return wanted.join(index.select("block", "data"), "block").select("wanted", "data").mapInPandas(_read_blocks, "key string, " + CAPTURES.replace("url string, ", ""))


RECORDS = "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary"


def _parse(data: bytes, with_payload: bool) -> tuple:
    headers, start, end = parse_record(data, 0)
    block = data[start : end - 4]
    http_end = block.index(b"\r\n\r\n") + 4
    page = headers["WARC-Record-ID"][10:-1]
    if headers["WARC-Type"] == "response":
        payload = block[http_end:]
        digest, refers, told = base64.b32encode(hashlib.sha1(payload).digest()).decode(), None, len(payload)
    else:
        payload, digest = None, headers["WARC-Payload-Digest"].removeprefix("sha1:")
        refers = int(headers["WARC-Refers-To"][10:-1])
        told = int(block[:http_end].split(b"Content-Length: ")[1].split(b"\r\n")[0])
    row = (int(page) if page else None, headers["WARC-Target-URI"], headers["WARC-Type"], digest, told, refers)
    return (*row, payload) if with_payload else row


def _ahead(offsets: list[int], lengths: list[int], i: int, stop: int) -> int:
    """How many bytes beyond range i are read along: up to the last of the ranges that follow closely."""
    start, end = offsets[i], offsets[i] + lengths[i]
    last = end
    for k in range(i + 1, stop):
        if offsets[k] - last > GAP_BYTES or offsets[k] + lengths[k] - start > READ_BYTES:
            break
        last = max(last, offsets[k] + lengths[k])
    return last - end


def _read(batches: Iterator[pd.DataFrame], with_payload: bool) -> Iterator[pd.DataFrame]:
    """Reads the ranges of rows sorted by path and offset."""
    columns = [f.split()[0] for f in RECORDS.split(", ")][: None if with_payload else -1]
    path, archive = None, None
    for pdf in batches:
        paths, offsets, lengths = pdf["path"].tolist(), pdf["offset"].tolist(), pdf["length"].tolist()
        rows, held, stop = [], 0, 0
        for i in range(len(paths)):
            if paths[i] != path:
                path, archive = paths[i], Archive(paths[i])
            if i >= stop:
                stop = i + 1
                while stop < len(paths) and paths[stop] == path:
                    stop += 1
            within = archive.at <= offsets[i] and offsets[i] + lengths[i] <= archive.at + len(archive.held)
            rows.append(_parse(archive.read(offsets[i], lengths[i], 0 if within else _ahead(offsets, lengths, i, stop)), with_payload))
            held += lengths[i]
            if held >= STRETCH:  # bounds what one batch of rows holds
                yield pd.DataFrame(rows, columns=columns).astype({"page_id": "Int64", "refers_to": "Int64"})
                rows, held = [], 0
        yield pd.DataFrame(rows, columns=columns).astype({"page_id": "Int64", "refers_to": "Int64"})


def read_records(captures: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records at the captures' byte ranges (path, offset, length); a response's payload and its digest are those of the bytes read.

    Captures of one stretch of an archive go to one task, so a large archive is read by many and a range by one.
    """
    schema = RECORDS if with_payload else RECORDS.replace(", payload binary", "")
    places = captures.select("path", "offset", "length")
    placed = places.repartition("path", F.floor(F.col("offset") / STRETCH)).sortWithinPartitions("path", "offset")
    return placed.mapInPandas(lambda it: _read(it, with_payload), schema)
