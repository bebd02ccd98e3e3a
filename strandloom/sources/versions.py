"""Publishing tables as numbered versions, by compare-and-set on a folder.

Each version is one small file, ``versions/version-N.json``, that names the version's tables and where their rows lie. It comes into being with all
its content and only if no file of that name exists; of several publishers who want a number one gets it, and the others read what was published and try the next.
Rows are written before, to folders of their own, and never change. So a reader of one version's file sees its tables together, and what was published before stays as a backup.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.sources.documents import safe_name

COMMIT = "version long, parent long, tables map<string,string>, schemas map<string,string>, note string"
DIGITS = 12
TRIES = 100  # lost races in a row before a publisher gives up


class NotPublished(Exception):
    """The tables don't fit what they are to replace, or the race for a version was lost too often."""


@dataclass(frozen=True)
class Version:
    number: int
    tables: dict[str, str]
    schemas: dict[str, str]

    def read(self, spark: SparkSession, name: str) -> DataFrame:
        return spark.read.schema(T.StructType.fromJson(json.loads(self.schemas[name]))).json(self.tables[name])


def _place(spark: SparkSession, path: str):
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def create_only(spark: SparkSession, path: str, text: str) -> bool:
    """Makes a file with this content, all at once; False if there is one already.

    The content goes to a file of another name first. A local file system links it to its name, others rename it without overwriting.
    """
    jvm = spark._jvm
    target, fs = _place(spark, path)
    draft = jvm.org.apache.hadoop.fs.Path(target.getParent(), f"_{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        if fs.getScheme() == "file":
            nio = lambda p: jvm.java.nio.file.Paths.get(p.toUri().getPath(), spark.sparkContext._gateway.new_array(jvm.java.lang.String, 0))
            jvm.java.nio.file.Files.createLink(nio(target), nio(draft))
        else:
            none = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration()).rename(draft, target, none)
    except Py4JJavaError as e:
        if "FileAlreadyExists" in e.java_exception.getClass().getName():
            return False
        raise
    finally:
        fs.delete(draft, False)
    return True


def history(spark: SparkSession, folder: str) -> DataFrame:
    """(version, parent, tables, schemas, note) of all that was published into a folder."""
    where, fs = _place(spark, f"{folder}/versions")
    fs.mkdirs(where)
    return spark.read.schema(COMMIT).json(f"{folder}/versions")


def version(spark: SparkSession, folder: str, number: int | None = None) -> Version | None:
    """A version, the newest by default; None if there is none."""
    rows = history(spark, folder)
    found = (rows if number is None else rows.where(F.col("version") == number)).orderBy(F.desc("version")).first()
    return found and Version(found["version"], found["tables"], found["schemas"])


def _check(name: str, schema: T.StructType, before: Version | None, force: bool) -> None:
    if before and name in before.tables and not force:
        old = T.StructType.fromJson(json.loads(before.schemas[name]))
        new = {f.name: f.dataType for f in schema}
        if lost := [f.name for f in old if new.get(f.name) != f.dataType]:
            raise NotPublished(f"{name}: {', '.join(lost)} missing or of another type than in version {before.number}")


def publish(targets: dict[str, DataFrame], folder: str, force: bool = False, note: str = "") -> int:
    """Publishes tables together as one new version and returns its number; tables of the version before that aren't named stay in it.

    Names must be safe file names. A table must keep the columns that it had, with their types, unless forced. Nothing is published
    if a table fails; its rows then lie unnamed.
    """
    spark = next(iter(targets.values())).sparkSession
    asked = spark.createDataFrame([(n,) for n in targets], "name string").select("name", safe_name(F.col("name")).alias("safe"))
    if bad := [r["name"] for r in asked.collect() if r["name"] != r["safe"]]:
        raise NotPublished(f"no safe names: {bad}")
    before = version(spark, folder)
    for name, rows in targets.items():
        _check(name, rows.schema, before, force)
    paths = {name: f"{folder}/{name}/{uuid.uuid4().hex}" for name in targets}
    for name, rows in targets.items():
        rows.write.json(paths[name])
    return _commit(spark, folder, paths, {n: rows.schema for n, rows in targets.items()}, before, force, note)


def _commit(spark: SparkSession, folder: str, paths: dict[str, str], schemas: dict[str, T.StructType], before: Version | None, force: bool, note: str) -> int:
    for _ in range(TRIES):
        number = before.number + 1 if before else 1
        tables = (before.tables if before else {}) | paths
        kinds = (before.schemas if before else {}) | {n: s.json() for n, s in schemas.items()}
        said = {"version": number, "parent": number - 1, "tables": tables, "schemas": kinds, "note": note}
        if create_only(spark, f"{folder}/versions/version-{number:0{DIGITS}d}.json", json.dumps(said)):
            return number
        before = version(spark, folder)  # another publisher was first: build on what it published
        for name, schema in schemas.items():
            _check(name, schema, before, force)
    raise NotPublished(f"lost the race for a version {TRIES} times")


def restore(spark: SparkSession, folder: str, number: int) -> int:
    """Publishes an earlier version's tables again, as a new version."""
    old = version(spark, folder, number)
    if old is None:
        raise NotPublished(f"no version {number}")
    schemas = {n: T.StructType.fromJson(json.loads(s)) for n, s in old.schemas.items()}
    return _commit(spark, folder, old.tables, schemas, version(spark, folder), True, f"restores version {number}")
