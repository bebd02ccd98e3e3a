"""Column functions on media times, durations, labels and URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clock_to_seconds(text: Column) -> Column:
    """H:MM:SS or MM:SS as seconds; null for anything else."""
    parts = F.transform(F.split(text, ":"), lambda p: p.try_cast("long"))
    total = F.aggregate(parts, F.lit(0).cast("long"), lambda n, p: n * 60 + p)
    return F.when(text.rlike(r"^\d{1,3}(:\d{2}){1,2}$"), total)


def seconds_to_clock(seconds: Column, pad_hours: bool = True) -> Column:
    """HH:MM:SS from an hour on, else MM:SS; without pad_hours the first part has no leading zero."""
    s = F.floor(F.greatest(seconds, F.lit(0))).cast("long")
    h, m, r = F.expr("1"), F.floor(s / 60), s % 60
    h = F.floor(m / 60)
    lead = "%02d" if pad_hours else "%d"
    return F.when(h > 0, F.format_string(f"{lead}:%02d:%02d", h, m % 60, r)).otherwise(F.format_string(f"{lead}:%02d", m, r))


def iso_duration_seconds(text: Column) -> Column:
    """PnDTnHnMnS as seconds."""
    part = lambda u: F.coalesce(F.nullif(F.regexp_extract(text, rf"(\d+){u}", 1), F.lit("")).cast("long"), F.lit(0))
    return F.when(text.rlike(r"^P(?=.)(\d+D)?(T(\d+H)?(\d+M)?(\d+S)?)?$"), part("D") * 86400 + part("H") * 3600 + part("M") * 60 + part("S"))


def timed_url(url: Column, seconds: Column, host: str, lead_in: float = 1.5) -> Column:
    """The url with t=<seconds>s, a little early and never negative, for urls of the host; others stay as they are."""
    t = F.concat(F.lit("t="), F.floor(F.greatest(seconds - lead_in, F.lit(0))).cast("string"), F.lit("s"))
    plain = F.regexp_replace(F.regexp_replace(url, r"([?&])t=[^&#]*&?", "$1"), r"[?&]$", "")
    ours = F.regexp_extract(url, r"^[a-z]+://([^/?#:]+)", 1).endswith(host)
    return F.when(ours, F.concat(plain, F.when(plain.contains("?"), "&").otherwise("?"), t)).otherwise(url)


def video_id(text: Column) -> Column:
    """The 11-character id of a watch, short or embed URL, or of a bare id; else null."""
    forms = (r"^([\w\-]{11})$", r"[?&]v=([\w\-]{11})(?:[&#]|$)", r"youtu\.be/([\w\-]{11})(?:[?&#/]|$)", r"/(?:shorts|live|embed)/([\w\-]{11})(?:[?&#/]|$)")
    return F.coalesce(*[F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in forms])


UNITS = ((100_000_000, "억"), (10_000, "만"), (1000, "천"))


def count_label(n: Column, units: tuple[tuple[int, str], ...] = UNITS) -> Column:
    """Korean short form of a count, in the largest of the units (size, name) that it reaches: hundred millions, ten thousands and thousands by default."""
    label = F.when(F.lit(False), F.lit(""))
    for size, name in units:
        label = label.when(n >= size, F.concat(F.regexp_replace(F.format_string("%.1f", F.floor(n * 10 / float(size)) / 10), r"\.0$", ""), F.lit(name)))
    return label.otherwise(n.cast("string"))


def segment_key(doc: Column, start_ms: Column, end_ms: Column, text: Column) -> Column:
    """First 16 hex digits of SHA-256 over document, start and end with three decimals, and text."""
    s = lambda ms: F.concat(F.floor(ms / 1000).cast("string"), F.lit("."), F.lpad((ms % 1000).cast("string"), 3, "0"))
    return F.substring(F.sha2(F.concat_ws("|", doc, s(start_ms), s(end_ms), text), 256), 1, 16)
