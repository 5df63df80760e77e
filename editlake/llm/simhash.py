"""SimHash near-duplicates with vantage-point trees.

1. Fingerprints: 64 bits over the XXH64 values of word shingles. Equal
   fingerprints are collapsed first (partial aggregate), so a large group of
   copies is one point from here on.
2. A vantage-point tree splits the distinct fingerprints into shards. Every
   node has a vantage point, a radius (the median distance of a bounded sample)
   and a bit mask; the distance is the Hamming distance under the mask. Masks
   on a path are disjoint, so distances add up and so do the triangle bounds:
   a branch whose nearest point must differ by ``cost`` bits under this node's
   mask leaves ``budget - cost`` for the masks below, and a branch without
   budget is pruned. The sample shapes the tree only; every fingerprint is
   placed, and results do not depend on the tree.
3. A fingerprint goes to its home shard and, as a query, to the shards its ball
   of ``max_bits`` overlaps. One direction is enough: queries go to shards
   numbered above their home.
4. In a shard a second tree of rings around vantage points (one mask a level)
   is walked by points and queries together; where a cell is small, distances
   are exact. Links are merged into groups at once and only a spanning forest
   leaves the shard, so a dense group never emits all its pairs.
5. Components of the forests' edges give each document the smallest id that it
   can reach.

Defined results: a text without words (or null) has fingerprint zero and links
like any other. Fewer words than a shingle: the whole sequence is one shingle.
Rows with equal ids each keep their own row. Null ids never name a component
unless no other id is in it. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import slices
from .components import connected_components

SHINGLE, MAX_BITS, SEED = 4, 4, 42
SAMPLE = 20_000         # fingerprints that shape the top tree
SHARD_POINTS = 16_384   # fingerprints at home in a shard, about
EXACT = 1 << 18         # pairs compared at once
HOT_SHARE = 1000        # fingerprints with over 1/HOT_SHARE of all rows: at most HOT_SHARE of them
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


# --- fingerprints -----------------------------------------------------------

def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """A bit is 1 if it is set in over half of the shingles' hashes."""
    found = text.encode().translate(LOWER).split() if text else []
    if not found:
        return 0
    joined = b" ".join(found)
    if len(found) <= shingle:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = np.cumsum([len(w) + 1 for w in found])
    starts = np.concatenate([[0], ends[:-shingle]]).tolist()
    stops = (ends[shingle - 1:] - 1).tolist()
    digest = xxhash.xxh64_digest
    h = b"".join([digest(joined[a:b], seed) for a, b in zip(starts, stops)])
    n = len(starts)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 4096):  # bounded: 64 bytes a hash
        part = np.frombuffer(h, np.uint8, min(4096, n - at) * 8, at * 8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, *, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """``doc_id, copy, fp``: ``copy`` is a hash of the text, telling rows of one id apart."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                fp = np.array([fingerprint(t, shingle, seed) for t in part.column("text").to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("copy"), pa.array(fp.view(np.int64))], ["doc_id", "copy", "fp"])

    text = F.col(f"`{text_col}`")
    return (docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.xxhash64(text).alias("copy"),
                        text.alias("text")).mapInArrow(run, "doc_id bigint, copy bigint, fp bigint"))


# --- the top tree: shards -----------------------------------------------------

class Node(NamedTuple):
    vantage: int
    mask: int
    radius: int
    near: Node | int   # a leaf is its shard number
    far: Node | int


def masks(parts: int) -> list[int]:
    """Disjoint masks of near-equal size over all 64 bits, bits dealt at random."""
    bits = np.random.default_rng(5).permutation(64)
    return [sum(1 << int(b) for b in bits[i::parts]) for i in range(parts)]


def _distance(points: np.ndarray, vantage: int, mask: int) -> np.ndarray:
    return np.bitwise_count((points ^ np.uint64(vantage)) & np.uint64(mask)).astype(np.int64)


def grow(sample: np.ndarray, levels: int) -> Node | int:
    """A tree of ``levels`` levels; shards are numbered from left to right."""
    ms = masks(max(levels, 4))
    rng = np.random.default_rng(6)
    leaves = iter(range(1 << 62))

    def node(points: np.ndarray, level: int):
        if level == levels or len(points) < 2:
            return next(leaves)
        vantage = int(points[rng.integers(len(points))])
        d = _distance(points, vantage, ms[level])
        radius = int(np.median(d))
        if (d <= radius).all():
            radius = max(0, int(d.max()) - 1)
        if (d <= radius).all() or not (d <= radius).any():
            return next(leaves)
        return Node(vantage, ms[level], radius, node(points[d <= radius], level + 1), node(points[d > radius], level + 1))

    return node(sample, 0)


def place(tree: Node | int, points: np.ndarray, budget: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(shard, positions, at_home)``: each point's home and the higher shards its ball overlaps."""
    home = np.empty(len(points), np.int64)

    def settle(node, at):
        if not isinstance(node, Node):
            home[at] = node
            return
        d = _distance(points[at], node.vantage, node.mask)
        settle(node.near, at[d <= node.radius])
        settle(node.far, at[d > node.radius])

    def visit(node, at, left):
        if not len(at):
            return
        if not isinstance(node, Node):
            ahead = home[at] <= node
            if ahead.any():
                yield node, at[ahead], home[at[ahead]] == node
            return
        d = _distance(points[at], node.vantage, node.mask)
        near = left - np.maximum(d - node.radius, 0)
        far = left - np.maximum(node.radius + 1 - d, 0)
        yield from visit(node.near, at[near >= 0], near[near >= 0])
        yield from visit(node.far, at[far >= 0], far[far >= 0])

    everything = np.arange(len(points))
    settle(tree, everything)
    yield from visit(tree, everything, np.full(len(points), budget))


# --- inside a shard -----------------------------------------------------------

class Groups:
    """Union of linked points by smallest label."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        label = self.label
        while len(a):
            la, lb = label[a], label[b]
            open_ = la != lb
            if not open_.any():
                return
            a, b, la, lb = a[open_], b[open_], la[open_], lb[open_]
            np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
            while True:
                up = label[label]
                if (up == label).all():
                    break
                label[:] = up


def link_shard(points: np.ndarray, at_home: np.ndarray, max_bits: int) -> np.ndarray:
    """Smallest linked position of each point, over all links between a point at
    home and any point of the shard."""
    groups = Groups(len(points))
    ms = masks(8)

    def walk(homes: np.ndarray, asks: np.ndarray, left: np.ndarray, level: int) -> None:
        if not len(homes) or not len(asks):
            return
        label = groups.label
        if len(homes) * len(asks) > EXACT:
            one = label[homes[0]]
            if (label[homes] == one).all() and (label[asks] == one).all():
                return  # all linked already
            if level < len(ms):
                vantage = int(points[homes[len(homes) // 2]])
                ring = _distance(points[homes], vantage, ms[level])
                ask_ring = _distance(points[asks], vantage, ms[level])
                for r in np.unique(ring).tolist():
                    rest = left - np.abs(ask_ring - r)
                    near = rest >= 0
                    walk(homes[ring == r], asks[near], rest[near], level + 1)
                return
        step = max(1, EXACT // len(asks))
        p = points[asks]
        for s in range(0, len(homes), step):
            part = homes[s:s + step]
            i, j = np.nonzero(np.bitwise_count(points[part][:, None] ^ p[None, :]) <= max_bits)
            groups.link(part[i], asks[j])

    walk(np.flatnonzero(at_home), np.arange(len(points)), np.full(len(points), max_bits), 0)
    return groups.label


def _link_rows(batches: Iterator[pa.RecordBatch], max_bits: int) -> Iterator[pa.RecordBatch]:
    """Rows of whole shards, sorted by shard, to spanning edges."""

    def edges(points, at_home):
        label = link_shard(points, at_home, max_bits)
        child = np.flatnonzero(label != np.arange(len(points)))
        for a in range(0, len(child), 1 << 16):
            c = child[a:a + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(points[c].view(np.int64)),
                                              pa.array(points[label[c]].view(np.int64))], ["a", "b"])

    shard, parts = None, []
    for batch in batches:
        s = batch.column("shard").to_numpy()
        fp = batch.column("fp").to_numpy().view(np.uint64)
        home = batch.column("home").to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(np.diff(s)) + 1).tolist(), len(s)]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            if shard is not None and s[a] != shard:
                yield from edges(*(np.concatenate(x) for x in zip(*parts)))
                parts = []
            shard = s[a]
            parts.append((fp[a:b].copy(), home[a:b].copy()))
    if parts:
        yield from edges(*(np.concatenate(x) for x in zip(*parts)))


# --- the operator ---------------------------------------------------------------

def link_edges(points: DataFrame, max_bits: int = MAX_BITS, *, shard_points: int = SHARD_POINTS,
               sample: int = SAMPLE) -> DataFrame:
    """Spanning edges ``a, b`` of all links between distinct fingerprints ``fp``."""
    n = points.count()
    every = max(1, n // sample)
    seen = points.where(F.pmod(F.xxhash64("fp"), F.lit(every)) == 0).collect()  # about `sample` fingerprints
    shape = np.array(sorted(r.fp for r in seen), np.int64).view(np.uint64)
    levels = min(16, max(0, int(np.ceil(np.log2(max(1, n / shard_points))))))
    held = points.sparkSession.sparkContext.broadcast(grow(shape, levels))

    def send(batches):
        for batch in batches:
            fp = batch.column("fp").to_numpy()
            for shard, at, home in place(held.value, fp.view(np.uint64), max_bits):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), shard, np.int32)), pa.array(fp[at]), pa.array(home)],
                    ["shard", "fp", "home"])

    sent = points.select("fp").mapInArrow(send, "shard int, fp bigint, home boolean")
    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (sent.repartition(parts, "shard").sortWithinPartitions("shard", "fp")
            .mapInArrow(lambda batches: _link_rows(batches, max_bits), "a bigint, b bigint"))


def near_duplicates(docs: DataFrame, *, shingle: int = SHINGLE, max_bits: int = MAX_BITS, seed: int = SEED,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, copy, fp, component_id``, one row per row of ``docs``."""
    rows = cut_lineage(fingerprints(docs, shingle, seed, id_col=id_col, text_col=text_col))
    points = cut_lineage(rows.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("n")))
    roots = connected_components(link_edges(points.select("fp"), max_bits))
    rooted = (points.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
              .withColumn("root", F.coalesce("root", "fp")))
    smallest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = cut_lineage(rooted.join(smallest, "root").select("fp", "n", "component_id"))
    # fingerprints of many rows: a table of HOT_SHARE lines at most, so it is
    # broadcast; the others meet their rows in a shuffle without hot keys
    total = rows.count()
    hot = named.where(F.col("n") * HOT_SHARE > total).select("fp", "component_id", F.lit(True).alias("hot"))
    met = rows.join(F.broadcast(hot), "fp", "left")
    few = met.where(F.col("hot").isNull()).select("fp", "doc_id", "copy").join(
        named.where(F.col("n") * HOT_SHARE <= total).select("fp", "component_id"), "fp")
    cols = ["doc_id", "copy", "fp", "component_id"]
    return met.where(F.col("hot")).select(*cols).unionAll(few.select(*cols))


def representatives(docs: DataFrame, *, shingle: int = SHINGLE, max_bits: int = MAX_BITS, seed: int = SEED,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs``, one per component: that of the smallest id (then of the
    smallest text hash; of rows equal in both, any one)."""
    found = near_duplicates(docs, shingle=shingle, max_bits=max_bits, seed=seed, id_col=id_col, text_col=text_col)
    first = found.groupBy("component_id", F.when(F.col("component_id").isNull(), F.col("fp")).alias("_g")).agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("i"), F.col("copy").alias("c"))).alias("m"))
    keys = cut_lineage(first.select(F.struct(F.col("m.i").alias("i"), F.col("m.c").alias("c")).alias("k")).distinct())
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                         F.struct(F.col(f"`{id_col}`").cast("bigint").alias("i"),
                                  F.xxhash64(F.col(f"`{text_col}`")).alias("c")).alias("k"))
    return packed.join(keys, "k", "left_semi").dropDuplicates(["k"]).select("row.*")
