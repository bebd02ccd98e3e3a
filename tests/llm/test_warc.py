import base64
import hashlib

from pyspark.sql import functions as F

from strandloom.llm import queries, warc

PAGES = [
    (5, "http://www.example.com/a?x=1#top", "<p>same</p>"),
    (3, "https://user@Sub.Example.COM:8080/b", "<p>same</p>"),
    (9, "https://sub.example.com:443", "<p>other</p>\r\n\r\nWARC/1.1\r\n\r\n"),
    (11, None, None),
    (12, "", ""),
    (13, "not a url\r\nat all", "é" * 5000),
    (None, "http://x.org/", "<p>same</p>"),
    (None, "http://x.org/", "alone"),
    (20, "http://x.org/", "twice"),
    (20, "http://x.org/", "twice"),
]


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def records(spark, pages, least=0, **how):
    df = spark.createDataFrame([(*p, "z") for p in pages], "page_id long, url string, html string, n string")
    folder = warc.write_archives(df, least, **how)
    captures = warc.scan_captures(spark, folder).withColumn("key", F.concat(warc.url_key(F.col("url")), F.lit(" "), F.when(F.col("page") == "", "-").otherwise(F.col("page"))))
    return folder, captures, warc.build_index(captures, lines_per_block=3)


def expected(pages, least=0):
    first = {}
    for p, _, html in pages:
        if p is not None and len((html or "").encode()) >= least:
            first[digest(html)] = min(p, first.get(digest(html), p))
    out = []
    for p, _, html in pages:
        to = first.get(digest(html))
        refers = to if to is not None and to != p else None
        out.append((str(p), len((html or "").encode()), digest(html), "revisit" if refers is not None else "response", refers, None if refers is not None else (html or "").encode()))
    return sorted(out, key=repr)


def test_every_page_is_read_back(spark):
    for least, size, most in ((0, 1 << 20, 1000), (6, 600, 2)):
        folder, captures, index = records(spark, PAGES, least, archive_bytes=size)
        keys = captures.select("key")
        found = warc.lookup(keys.union(keys).union(spark.createDataFrame([("zz absent",), ("",)], "key string")), index, most)
        got = warc.read_records(found).collect()
        rows = [(str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], bytes(r["payload"]) if r["payload"] is not None else None) for r in got]
        assert sorted(rows, key=repr) == expected(PAGES, least)


def test_keys(spark):
    df = spark.createDataFrame(PAGES[:6], "page_id long, url string, html string")
    keys = [r[0] for r in df.select(warc.url_key(F.col("url"))).collect()]
    assert keys == ["com,example,www)/a?x=1", "com,example,sub:8080)/b", "com,example,sub)/", "", "", "not a url\r\nat all"]


def test_empty_table(spark):
    folder, captures, index = records(spark, [])
    assert warc.read_records(warc.lookup(captures.select("key"), index)).collect() == []


def test_ranges_are_read_alone(tmp_path):
    """Sorted ranges far apart: what lies between them isn't read; close ones share a read."""
    data = bytes(range(256)) * 4000
    (tmp_path / "a").write_bytes(data)
    archive = warc.Archive(f"file://{tmp_path}/a")
    assert archive.read(500_000, 10) == data[500_000:500_010] and len(archive.held) == 10
    assert archive.read(0, 5, 100) == data[:5] and archive.read(90, 15) == data[90:105] and len(archive.held) == 105
    assert archive.read(len(data) - 3, 3, 1000) == data[-3:]
    assert warc._ahead([0, 20, 200_000], [10, 10, 10], 0, 3) == 20


def test_query(spark, tmp_path):
    pages = [p for p in PAGES if p[0] != 20] + [(30, "http://long.example/" + "p/" * 3000, "<p>same</p>"), (31, "http://x.org/", "z" * 3_000_000)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = [(str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in queries.op9_warc(spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted((x[:5] for x in expected(pages)), key=repr)


def test_paths_as_spark_tells_them(tmp_path, monkeypatch):
    from pyarrow import fs

    folder = tmp_path / "with space" / "50% ?#"
    folder.mkdir(parents=True)
    (folder / "part-0").write_bytes(b"0123456789")
    for path in (f"file:{folder}/part-0", f"file://{folder}/part-0", f"{folder}/part-0"):
        assert warc.Archive(path).read(3, 4) == b"3456"
    asked = []

    def from_uri(uri):
        asked.append(uri)
        return fs.SubTreeFileSystem(str(tmp_path), fs.LocalFileSystem()), {"s3": "with space", "hdfs": "/with space/"}[uri.split(":")[0]]

    monkeypatch.setattr(warc.fs, "FileSystem", type("F", (), {"from_uri": staticmethod(from_uri)}))
    assert warc.Archive("s3a://bucket/50% ?#/part-0").read(0, 2) == b"01"
    assert warc.Archive("hdfs://host:8020/50% ?#/part-0").read(8, 2) == b"89"
    assert asked == ["s3://bucket/", "hdfs://host:8020/"]
