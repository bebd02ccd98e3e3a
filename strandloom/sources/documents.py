"""Reading acquisition and published documents, glossaries and dimensions, and writing results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandloom.functions.names import fresh

ACQUISITION = (
    "schema_version string, source_url string, "
    "metadata struct<video_id:string,title:string,description_raw:string,default_language:string,duration_seconds:double,channel_title:string,view_count:string,like_count:string>, "
    "creator_chapters array<struct<timestamp_text:string,start_seconds:double,end_seconds:double,label:string>>, "
    "transcript struct<status:string,language:string,language_code:string,is_generated:boolean,"
    "items:array<struct<segment_id:string,text:string,start_seconds:double,duration_seconds:double,end_seconds:double,source_type:string>>>, "
    "normalized_utterances array<struct<utterance_id:string>>, script array<struct<utterance_id:string>>"
)


def read_documents(spark: SparkSession, path: str, schema: str = ACQUISITION) -> DataFrame:
    """One row per JSON file, with what couldn't be read in _corrupt and the file's name in file; order by file where the order matters."""
    rows = spark.read.schema(schema + ", _corrupt string").option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return rows.withColumn("file", F.col("_metadata.file_name"))


def document_kind() -> Column:
    """What a document is, by the fields that it has."""
    return (
        F.when(F.col("script").isNotNull(), "published")
        .when(F.col("normalized_utterances").isNotNull(), "preprocessed")
        .when(F.col("transcript.items").isNotNull(), "acquisition")
        .otherwise("unknown")
    )


def segments_of(documents: DataFrame) -> DataFrame:
    """Caption segments with their positions; blank texts and times that aren't finite, non-negative and in order are left out."""
    flat = documents.select(F.col("metadata.video_id").alias("video_id"), F.posexplode("transcript.items").alias("pos", "s"))
    rows = flat.select("video_id", "pos", "s.segment_id", F.trim("s.text").alias("text"), F.col("s.start_seconds").alias("start_s"), F.coalesce("s.end_seconds", F.col("s.start_seconds") + F.col("s.duration_seconds")).alias("end_s"))
    good = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.col(c) >= 0) & (F.col(c) < float("inf"))
    return rows.where((F.col("text") != "") & good("start_s") & good("end_s") & (F.col("end_s") >= F.col("start_s")))


def chapters_of(documents: DataFrame) -> DataFrame:
    """Creator chapters, the first of equal (start, label), each ending where the next begins or with the video."""
    flat = documents.select(F.col("metadata.video_id").alias("video_id"), F.col("metadata.duration_seconds").alias("duration_s"), F.posexplode("creator_chapters").alias("pos", "c"))
    rows = flat.select("video_id", "duration_s", "pos", F.trim("c.label").alias("label"), F.col("c.start_seconds").alias("start_s")).where("start_s >= 0 AND (duration_s IS NULL OR start_s < duration_s)")
    once = rows.groupBy("video_id", "duration_s", "start_s", "label").agg(F.min("pos").alias("pos"))
    w = Window.partitionBy("video_id").orderBy("start_s", "pos")
    return once.select("video_id", (F.row_number().over(w) - 1).alias("idx"), "label", "start_s", F.coalesce(F.lead("start_s").over(w), "duration_s").alias("end_s"))


def lines_with_times(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line, label, start_s) of description lines that begin with a clock time."""
    from strandloom.functions.clock import clock_to_seconds

    lines = texts.select(key, F.posexplode(F.split(text, "\n")).alias("line", "x"))
    stamp = F.regexp_extract("x", r"^\s*[\[(]?(\d{1,3}(?::\d{2}){1,2})[\])]?\s*[-–—:]?\s*(\S.*)$", 1)
    label = F.trim(F.regexp_extract("x", r"^\s*[\[(]?(\d{1,3}(?::\d{2}){1,2})[\])]?\s*[-–—:]?\s*(\S.*)$", 2))
    return lines.select(key, "line", label.alias("label"), clock_to_seconds(stamp).alias("start_s")).where("start_s IS NOT NULL")


def keep_first_by_name(base: DataFrame, extension: DataFrame, name: str = "canonical_name") -> DataFrame:
    """The base dimension, and of the extension what the base has no name of, in any case."""
    known = base.select(F.lower(name).alias("_k")).distinct()
    return base.unionByName(extension.join(known, F.lower(name) == F.col("_k"), "left_anti"))


def unique_lookup(rows: DataFrame, key: str, value) -> DataFrame:
    """The row of a key; more than one is an error when the result is read."""
    found = rows.where(F.col(key) == value)
    (n,) = fresh(rows, "n")
    found = found.withColumn(n, F.count("*").over(Window.partitionBy(key)))
    return found.where(F.when(F.col(n) > 1, F.raise_error(F.concat(F.lit(f"more than one row of {key} "), F.col(key).cast("string")))).otherwise(F.lit(True))).drop(n)


def safe_name(text: Column, most_bytes: int = 180) -> Column:
    """A file name without separators, control characters and leading dots, at most so many UTF-8 bytes long and never empty."""
    clean = F.trim(F.regexp_replace(F.regexp_replace(text, r"[\\/:*?\"<>|\x00-\x1f]+", "_"), r"^\.+", ""))
    ends = F.filter(F.sequence(F.lit(0), F.char_length(clean)), lambda n: F.octet_length(F.substring(clean, F.lit(1), n)) <= most_bytes)
    return F.coalesce(F.nullif(F.trim(F.substring(clean, F.lit(1), F.array_max(ends))), F.lit("")), F.lit("untitled"))


def publish(rows: DataFrame, path: str, force: bool = False) -> None:
    """Writes JSON lines; an existing target is an error unless forced. A job's files appear together, when it commits."""
    rows.write.mode("overwrite" if force else "errorifexists").json(path)


def report_lines(violations: DataFrame, ids: list[str]) -> DataFrame:
    """One text line per id: its rules, sorted."""
    return violations.groupBy(*ids).agg(F.concat_ws("; ", F.array_sort(F.collect_set("rule"))).alias("line"))
