"""SimHash near-duplicate groups through shard BK-trees.

A document's fingerprint is the bitwise majority over its 4-word shingles' XXH64. Fingerprints link at
a Hamming distance of at most 4; a group is what links reach.

A shard is the set of different fingerprints that agree on one of five blocks of their bits: two
that differ in at most four bits agree on one at least, so every link lies within a shard. Shards
above ``MOST`` members are dealt anew by five blocks of their other bits, ``DEPTH`` times at
most; what is still larger goes through a grid of pieces, each piece against each. A task builds a BK-tree for each of
its shards (children keyed by their distance to the parent) and sends every member down it, along
edges within the radius of its own distance only.

The shards' total grows with the corpus, so a tree reaches its queries by the shuffle that brings
both to the shard's task, and never passes through the driver as a broadcast would.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.llm.common import cut, fresh
from strandloom.llm.graph import connected_components

BLOCKS = 5  # one more than the radius
RADIUS = 4
WIDTH = 4  # words of a shingle
MOST = 4096  # members of a shard
DEPTH = 2  # times that a shard is dealt anew
FRONTIER = 1 << 20  # (query, node) pairs in memory


def fingerprint(data: bytes | None, width: int = WIDTH) -> int:
    """The 64-bit SimHash of a UTF-8 text as a signed integer; zero if it has no words."""
    words = (data or b"").lower().split()  # bytes.lower and bytes.split know A-Z and ASCII space only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        pieces, n = [joined], 1
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate(([0], ends[:-1]))
        n = len(words) - width + 1
        pieces = [joined[a:b] for a, b in zip(starts[:n].tolist(), (ends[width - 1 :] - 1).tolist())]
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 14):
        h = np.array([xxhash.xxh64_intdigest(p, 42) for p in pieces[at : at + (1 << 14)]], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, np.int32)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


@F.pandas_udf(T.LongType())
def fingerprint_udf(texts: pd.Series) -> pd.Series:
    return pd.Series([fingerprint(t) for t in texts], dtype="int64")


def deal(shards: DataFrame) -> DataFrame:
    """Every row (fp, shard, rest, n_bits) five times: by each of five blocks of the n_bits low bits of rest."""
    blocks = []
    for i in range(BLOCKS):
        lo, hi = f"int(n_bits * {i} div {BLOCKS})", f"int(n_bits * {i + 1} div {BLOCKS})"
        above = f"if({hi} >= 64, 0L, shiftrightunsigned(rest, {hi}))"
        value = f"(shiftrightunsigned(rest, {lo}) & (shiftleft(1L, {hi} - {lo}) - 1L))"
        rest = f"((rest & (shiftleft(1L, {lo}) - 1L)) | shiftleft({above}, {lo}))"
        blocks.append(f"struct(xxhash64(shard, {i}, {value}) AS shard, {rest} AS rest, n_bits - ({hi} - {lo}) AS n_bits)")
    return shards.select("fp", F.expr(f"inline(array({', '.join(blocks)}))"))


def _runs(ids: np.ndarray) -> np.ndarray:
    """Where a new value begins in a sorted array."""
    return np.concatenate(([True], ids[1:] != ids[:-1])) if len(ids) else np.zeros(0, bool)


def build_trees(shard: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(root of each member, edges' keys, edges' children) of one BK-tree per shard.

    All trees grow level by level: the first of each set of members becomes a node, the others
    are sorted by their distance to it, and each distance's members are a set of the next level. An edge's
    key is 65 times the parent plus the distance; keys come sorted.
    """
    n = len(fp)
    order = np.argsort(shard, kind="stable")
    head = _runs(shard[order])
    heads = order[head]
    root = np.empty(n, np.int64)
    root[order] = heads[np.cumsum(head) - 1]
    keys, children = [], []
    while True:
        rest = order[~head]
        if not len(rest):
            break
        up = heads[np.cumsum(head) - 1][~head]
        key = up * 65 + np.bitwise_count(fp[rest] ^ fp[up])
        by = np.argsort(key, kind="stable")
        order, key = rest[by], key[by]
        head = _runs(key)
        heads = order[head]
        keys.append(key[head])
        children.append(heads)
    if not keys:
        return root, np.zeros(0, np.int64), np.zeros(0, np.int64)
    all_keys, all_children = np.concatenate(keys), np.concatenate(children)
    by = np.argsort(all_keys, kind="stable")
    return root, all_keys[by], all_children[by]


def search_trees(query: np.ndarray, root: np.ndarray, fp: np.ndarray, keys: np.ndarray, children: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, node) pairs within the radius; query holds members, root the tree that each searches."""
    found_q, found_n, q, node = [], [], query, root
    while len(q):
        d = np.bitwise_count(fp[q] ^ fp[node]).astype(np.int64)
        near = (d <= radius) & (q != node)
        found_q.append(q[near])
        found_n.append(node[near])
        lo = np.searchsorted(keys, node * 65 + np.maximum(d - radius, 0), "left")
        hi = np.searchsorted(keys, node * 65 + np.minimum(d + radius, 64), "right")
        k = hi - lo
        starts = np.repeat(lo - np.concatenate(([0], np.cumsum(k)[:-1])), k)
        node = children[starts + np.arange(len(starts))]
        q = np.repeat(q, k)
    return (np.concatenate(found_q), np.concatenate(found_n)) if found_q else (query, query)


def smallest_reachable(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n members the smallest index that its links reach."""
    label = np.arange(n)
    while len(a):
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def link_members(shard: np.ndarray, side: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what is near within each shard: every linked member and the first one it reaches.

    side is 0 for a shard that is whole. In a grid's cell, 1 and 2 are two pieces: the members of 2
    search the tree of those of 1.
    """
    tree = np.flatnonzero(side < 2)
    root, keys, children = build_trees(shard[tree], fp[tree])
    at = np.searchsorted(shard[tree], shard)  # shards come sorted, side 1 first
    has = (at < len(tree)) & (shard[tree[np.minimum(at, len(tree) - 1)]] == shard) if len(tree) else np.zeros(len(fp), bool)
    asks = np.flatnonzero(has & (side != 1))
    # positions within `tree` for nodes; queries keep their own fingerprints through one joint array
    joint = np.concatenate((fp[tree], fp[asks]))
    size = np.bincount(np.searchsorted(np.unique(shard), shard))
    weight = size[np.searchsorted(np.unique(shard), shard[asks])]
    a, b = [], []
    block = np.cumsum(weight) // FRONTIER
    for k in np.unique(block):
        own = np.flatnonzero(block == k)
        q, node = search_trees(own + len(tree), root[at[asks[own]]], joint, keys, children, radius)
        q = asks[q - len(tree)]
        node = tree[node]
        keep = q != node
        a.append(q[keep])
        b.append(node[keep])
    if not a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    label = smallest_reachable(len(fp), np.concatenate(a), np.concatenate(b))
    linked = np.flatnonzero(label != np.arange(len(fp)))
    return linked, label[linked]


def _link_partition(batches: Iterator[pd.DataFrame], radius: int) -> Iterator[pd.DataFrame]:
    """Sorted (shard, side, fp) rows in, links (a, b) out; holds some whole shards at a time."""

    def links(rows: pd.DataFrame) -> pd.DataFrame:
        fp = rows["fp"].to_numpy().view(np.uint64)
        a, b = link_members(rows["shard"].to_numpy(), rows["side"].to_numpy(), fp, radius)
        own = rows["fp"].to_numpy()
        return pd.DataFrame({"a": own[a], "b": own[b]})

    held: list[pd.DataFrame] = []
    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) < 32_768:
            continue
        rows = pd.concat(held, ignore_index=True)
        last = int(np.searchsorted(rows["shard"].to_numpy(), rows["shard"].iloc[-1]))
        held = [rows.iloc[last:]]
        if last:
            yield links(rows.iloc[:last])
    if held and sum(map(len, held)):
        yield links(pd.concat(held, ignore_index=True))


def near_links(fps: DataFrame, radius: int = RADIUS, most: int = MOST) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of fp within the radius; fp differ from each other."""
    if radius >= BLOCKS:
        raise ValueError(f"a radius of {radius} needs more than {BLOCKS} blocks")
    ready = None
    wide = deal(fps.selectExpr("fp", "0L AS shard", "fp AS rest", "64 AS n_bits"))
    for level in range(DEPTH + 1):
        wide = cut(wide, "shards")
        large = cut(wide.groupBy("shard").count().where(F.col("count") > most), "large-shards")
        some = not large.isEmpty()
        small = wide.join(large.select("shard"), "shard", "left_anti") if some else wide
        small = small.select("shard", F.lit(0).alias("side"), "fp")
        ready = small if ready is None else ready.union(small)
        if not some:
            break
        wide = wide.join(large, "shard")
        if level < DEPTH:
            wide = deal(wide.select("fp", "shard", "rest", "n_bits"))
            continue
        # a grid: piece i of a shard against piece j, i <= j
        n = F.ceil(F.col("count") / most)
        piece = wide.select("fp", "shard", n.alias("n"), F.pmod(F.xxhash64("fp"), n).alias("i"))
        cell = piece.select("fp", "shard", "i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("j"))
        side = F.when(F.col("i") == F.col("j"), 0).when(F.col("i") < F.col("j"), 1).otherwise(2)
        key = F.xxhash64("shard", F.least("i", "j"), F.greatest("i", "j"))
        ready = ready.union(cell.select(key.alias("shard"), side.alias("side"), "fp"))
    dealt = ready.repartition("shard").sortWithinPartitions("shard", "side", "fp")
    return dealt.mapInPandas(lambda it: _link_partition(it, radius), "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id, group and text_hash of every row of docs (doc_id, text).

    component_id is the smallest doc_id that links reach, the row's own included; group is a fingerprint that stands for the
    component, and text_hash is xxhash64(text). A null or empty text has fingerprint zero and links like any other.
    Repeated rows and equal texts share a fingerprint. A null doc_id is carried, but is no candidate for
    component_id, which is null only if all of a component's are. Other columns of docs are left aside.
    """
    prints = docs.select("doc_id", fingerprint_udf(F.col("text").cast("binary")).alias("fp"), F.xxhash64("text").alias("text_hash"))
    prints = cut(prints, "fingerprints")
    kinds = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "kinds")
    labels = connected_components(near_links(kinds.select("fp"), radius), "simhash")
    linked = cut(labels.withColumnRenamed("node", "fp").join(kinds, "fp"), "linked")
    least = cut(linked.groupBy("label").agg(F.min("first").alias("least")), "least")
    of = linked.join(least, "label").select("fp", "label", "least")
    whole = kinds.join(of, "fp", "left").select("fp", F.coalesce("least", "first").alias("component_id"), F.coalesce("label", "fp").alias("group"))
    whole = cut(whole, "components")
    out = prints.join(whole, "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "group", "text_hash")


def one_of_each(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """docs without near-duplicates: of each group the row of smallest doc_id (null last), then smallest text hash, stays.

    Of equal rows one stays. Null and empty texts are a group of their own (fingerprint zero). All columns of docs are kept,
    whatever their names; an empty table stays empty.
    """
    of, text_hash, n = fresh(docs, "of", "hash", "n")
    rank = F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")
    marked = near_duplicates(docs.select("doc_id", "text"), radius).groupBy("group", "doc_id", "text_hash").agg(F.count("*").alias("n"))
    best = marked.groupBy("group").agg(F.min_by(F.struct("doc_id", "text_hash", "n"), rank).alias("k"))
    best = cut(best.select(F.col("k.doc_id").alias(of), F.col("k.text_hash").alias(text_hash), F.col("k.n").alias(n)), "kept")
    same = docs["doc_id"].eqNullSafe(best[of]) & (F.xxhash64(docs["text"]) == best[text_hash])
    kept = docs.join(best, same)
    several = F.col(n) > 1
    if best.where(several).isEmpty():
        return kept.drop(of, text_hash, n)
    once = kept.where(~several).union(kept.where(several).dropDuplicates([of, text_hash]))  # equal rows: the first of them stays
    return once.drop(of, text_hash, n)
