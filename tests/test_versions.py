"""Publishing as compare-and-set."""

from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from strandloom.sources import versions as v


def numbers(df):
    return sorted(r[0] for r in df.collect())


def test_publishers_at_once_get_different_versions_and_readers_never_mix(spark, tmp_path):
    folder = f"file://{tmp_path}/with space"

    def work(who):
        return [v.publish({"left": spark.range(1).select(F.lit(who * 10 + i).alias("x")), "right": spark.range(1).select(F.lit(who * 10 + i).alias("x"))}, folder) for i in range(3)]

    with ThreadPoolExecutor(4) as pool:
        got = sorted(n for part in pool.map(work, range(4)) for n in part)
    assert got == list(range(1, 13))
    assert v.history(spark, folder).count() == 12
    seen = set()
    for n in got:
        one = v.version(spark, folder, n)
        left, right = numbers(one.read(spark, "left")), numbers(one.read(spark, "right"))
        assert left == right and len(left) == 1
        seen.update(left)
    assert len(seen) == 12


def test_a_file_is_made_once(spark, tmp_path):
    path = f"file://{tmp_path}/v.json"
    with ThreadPoolExecutor(8) as pool:
        won = list(pool.map(lambda i: v.create_only(spark, path, str(i)), range(8)))
    assert sum(won) == 1 and (tmp_path / "v.json").read_text() == str(won.index(True))
    assert not [p for p in tmp_path.iterdir() if p.name.startswith("_")]


def test_failures_leave_what_was_published(spark, tmp_path):
    folder = f"file://{tmp_path}/p"
    assert v.version(spark, folder) is None
    assert v.publish({"a": spark.range(4), "b": spark.range(1)}, folder) == 1
    broken = spark.range(3).select(F.raise_error(F.lit("no")).cast("long").alias("id"))
    with pytest.raises(Exception, match="no"):
        v.publish({"a": spark.range(9), "b": broken}, folder)
    assert v.version(spark, folder).read(spark, "a").count() == 4
    assert v.publish({"a": spark.range(5)}, folder) == 2
    now = v.version(spark, folder)
    assert [now.read(spark, n).count() for n in ("a", "b")] == [5, 1]  # b stays as it was


def test_schemas_names_and_backups(spark, tmp_path):
    folder = f"file://{tmp_path}/p"
    v.publish({"a": spark.range(4)}, folder)
    with pytest.raises(v.NotPublished, match="id missing or of another type"):
        v.publish({"a": spark.range(4).select(F.col("id").cast("string").alias("id"))}, folder)
    with pytest.raises(v.NotPublished, match="safe"):
        v.publish({"../a": spark.range(4)}, folder)
    assert v.publish({"a": spark.range(3).withColumn("more", F.lit("x"))}, folder) == 2
    assert v.publish({"a": spark.range(2).select(F.lit("s").alias("id"))}, folder, force=True) == 3
    assert v.restore(spark, folder, 1) == 4
    assert numbers(v.version(spark, folder).read(spark, "a")) == [0, 1, 2, 3]
    with pytest.raises(v.NotPublished, match="no version 9"):
        v.restore(spark, folder, 9)
