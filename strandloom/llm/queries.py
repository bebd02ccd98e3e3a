"""Thin queries: each applies one operator to its whole table and derives the columns to compare."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm import chat, collocations, decontaminate, hmm, linededup, media, mixture, passages, quality, runs, sharding, simhash, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = decontaminate.mark_hits(docs, table(spark, sf_dir, "benchmark"))
    marked = marked.withColumn("n_hit", decontaminate.n_hit("hits"))
    return marked.select(
        "doc_id",
        F.col("hits.n_words").alias("n_words"),
        "n_hit",
        F.size("hits.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hits.items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op6_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    # what orders the rows is computed here, so that texts stay where they are
    facts = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64("text").alias("text_hash"))
    placed = sharding.assign(facts, by=["doc_id", "text_hash", "text_crc32"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixture.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = linededup.with_bitmaps(docs, linededup.keep_bitmaps(docs))
    digest = linededup.kept_digest(F.col("text").cast("binary"), "keep").alias("d")
    return kept.select("doc_id", digest).select("doc_id", "d.n_lines", "d.n_dropped", "d.kept_sha256")


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = "</s>[INST] ok [/INST]"
    more = spark.sql(f"SELECT -7L AS conv_id, * FROM VALUES (0L, 'user', '{odd}'), (1L, 'assistant', '{odd}') AS t(turn, role, text)")
    windows = chat.read_windows(chat.format_windows(given.unionByName(more)))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    part = windows.select("conv_id", "span", F.size("turns").alias("n"), told.alias("told"), F.array_join("targets", "").alias("loss"), F.char_length("formatted").alias("chars"))
    whole = part.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("span", "told", "loss"))).alias("parts"), F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"))
    loss = F.array_join("parts.loss", "")
    return whole.select(
        "conv_id",
        "n_turns",
        F.sha2(F.array_join("parts.told", ""), 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    folder = warc.write_archives(pages)
    captures = warc.scan_captures(spark, folder)
    keyed = captures.withColumn("key", F.concat(warc.url_key(F.col("url")), F.lit(" "), F.when(F.col("page") == "", "-").otherwise(F.col("page"))))
    index = warc.build_index(keyed)
    found = warc.lookup(pages.select(warc.capture_key(F.col("url"), F.col("page_id")).alias("key")), index)
    read = warc.read_records(found, with_payload=False)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_media_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = media.read_back(media.store(table(spark, sf_dir, "documents")))
    stored = (F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"))
    return read.select("doc_id", "n_bytes", "facts.payload_bytes", "facts.payload_sha256", "facts.tail_crc32", *stored, "facts.feature")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ranker = quality.train(docs, table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), quality.score(F.col("text"), ranker).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= quality.ACCEPT).cast("int"))


def op3_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = passages.passage_classes(table(spark, sf_dir, "documents"))
    covered = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_words", "class_id", F.size("spans").alias("n_spans"), covered.alias("n_repeated_words"), "spans")


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.phrases(table(spark, sf_dir, "documents").select("lang", "text"))


def op12_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    scored = hmm.likelihoods(docs, ~held_out)
    return scored.select("doc_id", (~F.col("learned")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def repeat_planted(doc_id: Column, words: Column) -> Column:
    """The words of a text, joined by blanks, in which those from some place on repeat one block; which texts and where follows from crc32(doc_id)."""
    h, n = F.crc32(doc_id.cast("string").cast("binary")), F.size(words)
    g = F.floor(h / 10)
    a = (g % n).cast("int")
    p = (F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))).cast("int")
    block = F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int"))
    planted = F.concat(F.slice(words, F.lit(1), a), F.slice(F.flatten(block), F.lit(1), n - a))
    return F.when((h % 10 == 0) & (n > 0), F.array_join(planted, " "))


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    due = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0
    split = docs.withColumn("words", F.when(due, F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"))))
    texts = split.select("doc_id", F.coalesce(repeat_planted(F.col("doc_id"), F.col("words")), F.col("text")).alias("text"))
    found = runs.periodic_runs(texts, keep=["doc_id"]).withColumn("best", runs.strongest("runs"))
    told = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    lines = F.concat(F.array_join(told, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
