"""Mixing sources to target weights by Pareto order sampling.

Sources, in code-point order with null last, weigh 3, 1, 2, 3, 1, 2, ... and share ``SHARE`` of all
words; no target exceeds ``MOST`` times its source's words, and what is cut off goes to the others by
weight. Each document of a source is taken a whole number of times for certain; the rest of the target is drawn.

Inclusion probabilities are unequal: in proportion to the square root of a document's size, by classes of
doubling size, so long documents, of which there are few, are seldom lost. They are scaled so that the words expected are the rest; classes that would exceed 1
are certain and the others scaled again. Every document gets a random number u from a hash, and the documents of a source
are ranked by u's odds divided by the odds of their inclusion. The sample is the head of that ranking that comes nearest to the
rest in words.

Where the head ends is found without ranking a source in one place: counts of words in 256
intervals of the rank key per source show the interval in which it ends, which is then split
again until few different keys are left in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from strandloom.llm.common import cut, fresh, number_rows

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
SEED = 7
KEY_BITS = 48
FEW = 256


def n_words(text: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, target for sizes (source, source_size): weighted shares, cut off and shared again."""
    numbered = number_rows(sizes, [F.col("source").asc_nulls_last()], "sources")
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("row_no") % len(WEIGHTS) + 1).cast("int"))
    weighed = cut(numbered.select("source", "source_size", weight.cast("double").alias("w")), "weights")
    words, free = weighed.agg(F.sum("source_size"), F.sum("w")).first()
    unit, full = (SHARE * words / free if words else 0.0), 0
    while words:
        above = F.col("source_size") * MOST <= F.lit(unit) * F.col("w")
        n, held, free = weighed.agg(F.count_if(above), F.sum(F.when(above, F.col("source_size") * MOST)), F.sum(F.when(~above, F.col("w")))).first()
        if n == full or not free:
            break
        unit, full = (SHARE * words - (held or 0)) / free, n
    cap = (F.col("source_size") * MOST).cast("double")
    return weighed.select("source", "source_size", F.least(cap, F.lit(unit) * F.col("w")).alias("target"))


def size_class(size: Column) -> Column:
    """0 for sizes 0 and 1, 1 for 2 and 3, 2 for 4 to 7, ...: at most 64 classes."""
    return F.greatest(F.floor(F.log2(F.greatest(size, F.lit(1)) + F.lit(0.5))), F.lit(0)).cast("int")


def inclusion(sizes: DataFrame, plan: DataFrame) -> DataFrame:
    """(source, class, chance) from words per class (source, class, words) and the sources' rests: each chance in proportion to the class's root."""
    root = F.pow(F.lit(2.0), F.col("class") / 2)
    joined = sizes.join(plan.select(F.col("source").alias("of"), "rest"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    joined = joined.withColumns({"root": root, "weight": root * F.col("words")})
    up = W.Window.partitionBy("source").orderBy(F.desc("class"))  # a few dozen rows at most
    certain = F.coalesce(F.sum("words").over(up.rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0))
    others = F.sum("weight").over(up.rowsBetween(W.Window.currentRow, W.Window.unboundedFollowing))
    # scale if all larger classes are certain; it holds from the first class on that it doesn't push beyond 1
    scaled = joined.withColumn("scale", F.when(others > 0, F.greatest(F.col("rest") - certain, F.lit(0.0)) / others).otherwise(F.lit(0.0)))
    scale = F.max(F.when(F.col("scale") * F.col("root") <= 1, F.struct("class", "scale"))).over(W.Window.partitionBy("source"))
    scaled = scaled.withColumn("at", scale)
    chance = F.when(F.col("class") > F.col("at.class"), 1.0).otherwise(F.col("at.scale") * F.col("root"))
    return scaled.select("source", "class", F.coalesce(F.least(chance, F.lit(1.0)), F.lit(1.0)).alias("chance"))


def _rank_key(draw: Column, chance: Column) -> Column:
    """The rank as an integer: odds of the draw over the inclusion odds, mapped from 0..inf to 0..2**KEY_BITS; certain documents rank first."""
    u = (F.shiftrightunsigned(draw, 11) + F.lit(0.5)) / F.lit(2.0**53)
    odds = (u / (1 - u)) / (chance / (1 - chance))
    drawn = F.least(F.floor(odds / (1 + odds) * 2.0**KEY_BITS), F.lit((1 << KEY_BITS) - 1))
    return F.when(chance >= 1, F.lit(0).cast("long")).when(chance > 0, drawn)


def _planned(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """rows (source, size, draw, ...) with the struct p of their source's plan, and their rank key (null: never drawn)."""
    joined = rows.join(plan.select(F.struct(*plan.columns).alias("p")), F.col("source").eqNullSafe(F.col("p.source")))
    return joined.withColumn("key", _rank_key(F.col("draw"), F.try_element_at("p.chances", size_class(F.col("size")))))


def mix(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """docs with size, source_size, target and copies (0, 1 or 2), which replace columns so named.

    A null text has size zero; null is a source of its own. Documents without words are taken about as often as
    the shortest of their source but add no words. The draw depends on doc_id, source and text only, so
    reruns agree; rows equal in all three are drawn together. Very long texts are documents like others, and an empty table gives an empty one.
    """
    docs = docs.drop("size", "source_size", "target", "copies")
    facts = {"source": F.col("source"), "size": n_words("text"), "draw": F.xxhash64(F.lit(seed), "doc_id", "source", "text")}
    small = cut(docs.select(*(c.alias(k) for k, c in facts.items())), "sized")
    classes = cut(small.groupBy("source", size_class(F.col("size")).alias("class")).agg(F.sum("size").alias("words")), "classes")
    plan = targets(classes.groupBy("source").agg(F.sum("words").alias("source_size")))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    plan = cut(plan.withColumn("whole", F.floor(ratio)).withColumn("rest", F.greatest(F.col("target") - F.col("whole") * F.col("source_size"), F.lit(0.0))), "plan")
    chances = inclusion(classes, plan).groupBy(F.col("source").alias("of")).agg(F.map_from_entries(F.collect_list(F.struct("class", "chance"))).alias("chances"))
    plan = plan.join(chances, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    # what lies below lo is in, what lies from hi on is out; before: words below lo
    plan = cut(plan.withColumns({"lo": F.lit(0).cast("long"), "hi": F.lit(1 << KEY_BITS), "before": F.lit(0).cast("long")}), "plan")
    kept = [c for c in plan.columns if c not in ("lo", "hi", "before")]
    for level in range(KEY_BITS // 8):
        step = 1 << (KEY_BITS - 8 * (level + 1))
        within = _planned(small, plan).where("key >= p.lo AND key < p.hi")
        bins = within.groupBy("source", F.floor(F.col("key") / step).alias("bin")).agg(F.sum("size").alias("words"), F.count("*").alias("n"))
        bins = bins.join(plan.select(F.col("source").alias("of"), "rest", "before"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
        below = F.sum("words").over(W.Window.partitionBy("source").orderBy("bin").rowsBetween(W.Window.unboundedPreceding, -1))  # 256 rows at most
        bins = bins.withColumn("start", F.col("before") + F.coalesce(below, F.lit(0)))
        last = bins.where("start <= rest").groupBy(F.col("source").alias("of")).agg(F.max_by(F.struct("bin", "start", "n"), "bin").alias("at"))
        moved = plan.join(last, F.col("source").eqNullSafe(F.col("of")), "left")
        lo = F.coalesce(F.col("at.bin") * step, "lo")
        hi = F.when(F.col("at").isNotNull(), lo + step).otherwise(F.col("hi"))
        plan = cut(moved.select(*kept, lo.alias("lo"), hi.alias("hi"), F.coalesce("at.start", "before").alias("before"), F.coalesce("at.n", F.lit(0)).alias("n")), "plan")
        most = plan.agg(F.max("n")).first()[0] or 0
        plan = plan.drop("n")
        if most <= FEW:
            break
    # the last interval, one row for each different draw: the head ends at (key, draw) "end"
    inside = _planned(small, plan).where("key >= p.lo AND key < p.hi").groupBy("source", "key", "draw").agg(F.sum("size").alias("words"), F.first("p.before").alias("before"), F.first("p.rest").alias("rest"))
    running = F.sum("words").over(W.Window.partitionBy("source").orderBy("key", "draw").rowsBetween(W.Window.unboundedPreceding, -1))
    start = F.col("before") + F.coalesce(running, F.lit(0))
    taken = inside.withColumn("start", start).where("start + words / 2 <= rest")
    ends = taken.groupBy(F.col("source").alias("of")).agg(F.max(F.struct("key", "draw")).alias("end"))
    plan = cut(plan.join(ends, F.col("source").eqNullSafe(F.col("of")), "left").drop("of"), "plan")
    p, draw, key = fresh(docs, "plan", "draw", "key")
    ranked = docs.withColumns({"size": facts["size"], draw: facts["draw"]})
    ranked = ranked.join(plan.select(F.struct(*plan.columns).alias(p)), F.col("source").eqNullSafe(F.col(f"{p}.source")))
    ranked = ranked.withColumn(key, _rank_key(F.col(draw), F.try_element_at(F.col(f"{p}.chances"), size_class(F.col("size")))))
    head = (F.col(key) < F.col(f"{p}.lo")) | (F.col(key) < F.col(f"{p}.hi")) & (F.struct(F.col(key), F.col(draw)) <= F.struct(f"{p}.end.key", f"{p}.end.draw")) & F.col(f"{p}.end").isNotNull()
    copies = F.col(f"{p}.whole") + F.coalesce(head.cast("int"), F.lit(0))
    return ranked.select(*[F.col(f"`{c}`") for c in docs.columns], "size", F.col(f"{p}.source_size").alias("source_size"), F.col(f"{p}.target").alias("target"), copies.cast("int").alias("copies"))
