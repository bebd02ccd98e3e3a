"""Chat formatting into budgeted windows, with DataFrame functions only.

A conversation's turns are cut into spans by the prefix sums of their token estimates: a turn belongs to
the span that its first token falls in, so spans align with turns. Each span becomes a
window: the conversation's first system turn, then as many of the last turns before the span as fit the history budget, then the
span's own turns. Repeated turns are masked: only the span's own assistant texts bear loss, so each is a target
exactly once.

Prefix sums come in two levels, within chunks of turns and over chunks, so that a long conversation
isn't summed in one task.

Template: ``<<SYS>>text<</SYS>>`` for system, ``[INST]text[/INST]`` for user, ``<s>text</s>`` for
assistant and ``[ROLE=name]text[/ROLE]`` for any other role. In texts and names, ``%``, ``[``, ``<`` and ``]``
are written ``%25``, ``%5B``, ``%3C`` and ``%5D``; nothing in a text can then look like a mark, and reading undoes
it exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SPAN_TOKENS = 1024
HISTORY_TOKENS = 256
CHARS_PER_TOKEN = 4
TURN_TOKENS = 4  # for a turn's marks
CHUNK = 32  # turns

OPENING = r"<<SYS>>|\[INST\]|<s>|\[ROLE=[^\]<\[]*\]"


def escape(text: Column) -> Column:
    for raw, coded in (("%", "%25"), ("[", "%5B"), ("<", "%3C"), ("]", "%5D")):
        text = F.replace(text, F.lit(raw), F.lit(coded))
    return text


def unescape(text: Column) -> Column:
    for raw, coded in (("[", "%5B"), ("<", "%3C"), ("]", "%5D"), ("%", "%25")):
        text = F.replace(text, F.lit(coded), F.lit(raw))
    return text


def _marks(role: Column) -> tuple[Column, Column]:
    other = F.concat(F.lit("[ROLE="), escape(role), F.lit("]"))
    before = F.when(role == "system", "<<SYS>>").when(role == "user", "[INST]").when(role == "assistant", "<s>").otherwise(other)
    after = F.when(role == "system", "<</SYS>>").when(role == "user", "[/INST]").when(role == "assistant", "</s>").otherwise("[/ROLE]")
    return before, after


def _same(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """An equi-join in which null matches null."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = [left[k].eqNullSafe(renamed[f"_r_{k}"]) for k in keys]
    return left.join(renamed, on, how).drop(*[f"_r_{k}" for k in keys])


def spans_of(turns: DataFrame, span_tokens: int = SPAN_TOKENS) -> DataFrame:
    """turns with tokens (an estimate, from characters) and span, numbered from 0 with gaps after very long turns."""
    tokens = (F.ceil(F.char_length("text") / CHARS_PER_TOKEN) + TURN_TOKENS).cast("long")
    rows = turns.withColumns({"tokens": tokens, "chunk": F.expr(f"coalesce(turn, -1) div {CHUNK}")})
    order = [F.col("turn").asc_nulls_first(), "role", "text"]
    within = Window.partitionBy("conv_id", "chunk").orderBy(*order)
    rows = rows.withColumn("before", F.sum("tokens").over(within.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("nth", F.row_number().over(within))
    sums = rows.groupBy("conv_id", "chunk").agg(F.sum("tokens").alias("chunk_tokens"))
    over = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("conv_id", "chunk", F.coalesce(F.sum("chunk_tokens").over(over), F.lit(0)).alias("chunk_before"))
    rows = _same(rows, sums, ["conv_id", "chunk"], "inner")
    first_token = F.col("chunk_before") + F.coalesce("before", F.lit(0))
    return rows.withColumn("span", F.floor(first_token / span_tokens)).drop("before", "chunk_before")


def format_windows(conversations: DataFrame, span_tokens: int = SPAN_TOKENS, history_tokens: int = HISTORY_TOKENS) -> DataFrame:
    """One row per window: conv_id, span, formatted, n_repeated (turns before the span's own), loss.

    loss holds the spans (start from 0, length, in code points of formatted) of the own assistant texts as
    they are written, escapes included. A null text is empty, a null role an empty role name. Null turns come
    first; equal turn numbers are ordered by role and text; rows without conv_id are one conversation. A turn
    beyond the budget makes its span that much longer, as turns are never cut.
    """
    turns = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = spans_of(turns, span_tokens)
    before, after = _marks(F.col("role"))
    rows = rows.select("conv_id", "span", "chunk", "nth", "role", "tokens", before.alias("before"), escape(F.col("text")).alias("body"), after.alias("after"))
    # spans of a conversation, and the one that follows each
    spans = rows.groupBy("conv_id", "span").agg(F.count("*").alias("n"))
    spans = spans.withColumn("next", F.lead("span").over(Window.partitionBy("conv_id").orderBy("span")))
    from_end = Window.partitionBy("conv_id", "span").orderBy(F.desc("chunk"), F.desc("nth"))
    rows = rows.withColumn("to_end", F.sum("tokens").over(from_end))
    rows = _same(rows, spans.select("conv_id", "span", "next"), ["conv_id", "span"], "inner")
    piece = F.struct("kind", "chunk", "nth", "role", "before", "body", "after").alias("piece")
    own = rows.select("conv_id", "span", F.lit(2).alias("kind"), "chunk", "nth", "role", "before", "body", "after")
    repeats = (F.col("to_end") <= history_tokens) & F.col("next").isNotNull() & (F.col("role") != "system")
    history = rows.where(repeats).select("conv_id", F.col("next").alias("span"), F.lit(1).alias("kind"), "chunk", "nth", "role", "before", "body", "after")
    place = F.struct("chunk", "nth")
    system = rows.where("role = 'system'").groupBy("conv_id").agg(F.min_by(F.struct("span", "chunk", "nth", "role", "before", "body", "after"), place).alias("s"))
    ahead = _same(spans.select("conv_id", "span"), system, ["conv_id"], "inner").where("span > s.span")
    ahead = ahead.select("conv_id", "span", F.lit(0).alias("kind"), "s.chunk", "s.nth", "s.role", "s.before", "s.body", "s.after")
    pieces = own.unionByName(history).unionByName(ahead).select("conv_id", "span", piece)
    windows = pieces.groupBy("conv_id", "span").agg(F.array_sort(F.collect_list("piece")).alias("pieces"))
    text = F.array_join(F.transform("pieces", lambda p: F.concat(p["before"], p["body"], p["after"])), "")

    def lengths(p: Column) -> Column:
        return F.char_length(p["before"]) + F.char_length(p["body"]) + F.char_length(p["after"])

    # running start of each piece by one fold over the window's pieces
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def step(acc: Column, p: Column) -> Column:
        target = (p["kind"] == 2) & (p["role"] == "assistant")
        span = F.struct((acc["at"] + F.char_length(p["before"])).alias("start"), F.char_length(p["body"]).alias("length"))
        spans_so_far = F.when(target, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"])
        return F.struct((acc["at"] + lengths(p)).alias("at"), spans_so_far.alias("spans"))

    loss = F.aggregate("pieces", empty, step)["spans"]
    repeated = F.size(F.filter("pieces", lambda p: p["kind"] < 2))
    return windows.select("conv_id", "span", text.alias("formatted"), repeated.alias("n_repeated"), loss.alias("loss"))


def read_windows(windows: DataFrame) -> DataFrame:
    """conv_id, span, turns (role, text; the window's own, unescaped) and targets (unescaped text under the loss mask), from the formatted text."""
    mark = F.regexp_extract_all("formatted", F.lit(f"({OPENING})([^<\\[]*)"), F.lit(1))
    body = F.regexp_extract_all("formatted", F.lit(f"({OPENING})([^<\\[]*)"), F.lit(2))

    def turn(m: Column, t: Column) -> Column:
        name = unescape(F.regexp_extract(m, r"^\[ROLE=(.*)\]$", 1))
        role = F.when(m == "<<SYS>>", "system").when(m == "[INST]", "user").when(m == "<s>", "assistant").otherwise(name)
        return F.struct(role.alias("role"), unescape(t).alias("text"))

    turns = F.slice(F.zip_with(mark, body, turn), F.col("n_repeated") + 1, F.lit(2**31 - 1))
    targets = F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"])))
    return windows.select("conv_id", "span", "formatted", turns.alias("turns"), targets.alias("targets"))
