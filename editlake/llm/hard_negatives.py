"""Hard-negative mining with anchor spanning-tree bounds.

Scores are integer inner products of vectors whose components x are taken as
floor(scale * x). For an anchor c with parent p in a tree of anchors, and any
row x, the score <c, x> lies within <p, x> +- |c - p| |x|.

1. Rows are made narrow (id, label, integer vector), equal rows are counted
   once, and the anchors are dealt into trees of at most ``TREE`` anchors:
   sorted by label and by the signs of random projections, so that like stands
   by like, and cut into pieces. Each piece gets its minimum spanning tree; its
   root hangs from the origin, whose score with every row is 0.
2. **Positives**: an anchor meets the rows of its label. Walking a tree from
   the root, a row's score with an anchor is bounded by its score (or bounds)
   with the parent. The best rows by upper bound are scored first and give a
   threshold; only rows whose upper bound reaches it are scored.
3. **Negatives**: each positive's score gives a window. On a second walk only
   rows of other labels whose bounds overlap a window of the anchor are scored.

Trees and rows meet in cells: with A anchors and n rows under a key (the
vector length; for positives also the label) there are G x S cells, anchors go
to the S cells of their tree's line and rows to the G cells of their column, so
every pair of a tree and a row meets in exactly one cell. G and S follow from A
and n such that a cell holds about ``CELL_ANCHORS`` anchors and ``CELL_ROWS``
rows, so no cell grows with the table, however large a label is. In a cell,
rows are taken in blocks of ``BLOCK``. The partial results of the cells are cut
to the best few per anchor before they are shuffled.

Defined results: rows with a null id, a null label, a null vector or a null or
non-finite component take no part. Vectors of different lengths are never
compared; each length is a table of its own. Every row is an anchor, positive
and negative of its own, so repeated rows repeat in the result (a row is never
its own positive, its copy may be). Equal scores go by the smaller id. Scores
beyond 64 bits count as the largest number of 64 bits, with their sign.
An empty table gives an empty result. On vectors without structure the bounds
exclude little and every anchor is scored with every row, in blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

TREE, BLOCK = 512, 2048
CELL_ANCHORS, CELL_ROWS = 2048, 16384
FEW_KEYS = 10_000   # rows of the table of cells that are broadcast; more are joined by a shuffle
PLANES = 16
EXACT, LONGEST = float(1 << 53), (1 << 63) - 1
NARROW = "id bigint, label bigint, dim int, vec binary, near int"


# --- vectors -----------------------------------------------------------------

def _pack(row: np.ndarray) -> bytes:
    """Integers as 16-bit numbers where they fit, else as doubles (which hold floor(scale * x) exactly)."""
    small = len(row) == 0 or np.abs(row).max() < 1 << 15
    return row.astype("<i2" if small else "<f8").tobytes()


def _matrix(vecs: list[bytes], dim: int) -> np.ndarray:
    if dim == 0:
        return np.zeros((len(vecs), 0))
    if all(len(v) == 2 * dim for v in vecs):
        return np.frombuffer(b"".join(vecs), "<i2").reshape(-1, dim).astype(np.float64)
    return np.stack([np.frombuffer(v, "<i2" if len(v) == 2 * dim else "<f8").astype(np.float64) for v in vecs])


def _narrow(batches: Iterator[pa.RecordBatch], scale: float) -> Iterator[pa.RecordBatch]:
    planes: dict[int, np.ndarray] = {}
    for batch in batches:
        vec = batch.column("vec")
        flat = vec.flatten()
        sizes = np.diff(vec.offsets.to_numpy())
        values = flat.to_numpy(zero_copy_only=False).astype(np.float64)  # null components become NaN
        at = np.concatenate([[0], np.cumsum(sizes)])
        bad = np.zeros(len(values) + 1, np.int64)
        bad[1:] = np.cumsum(~np.isfinite(values))
        good = np.flatnonzero(bad[at[1:]] == bad[at[:-1]])
        with np.errstate(over="ignore", invalid="ignore"):
            whole = np.floor(scale * values)
        vecs, near = [], []
        for i in good.tolist():
            row = whole[at[i]:at[i + 1]]
            if len(row) not in planes:
                planes[len(row)] = np.random.default_rng(len(row)).standard_normal((len(row), PLANES))
            vecs.append(_pack(row))
            near.append(int(np.packbits(row @ planes[len(row)] > 0).view(">u2")[0]))
        take = pa.array(good)
        yield pa.RecordBatch.from_arrays(
            [batch.column("id").take(take), batch.column("label").take(take), pa.array(sizes[good].astype(np.int32)),
             pa.array(vecs, pa.binary()), pa.array(near, pa.int32())], ["id", "label", "dim", "vec", "near"])


# --- trees -------------------------------------------------------------------

def spanning_tree(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Minimum spanning tree of the rows by distance (Prim): rows in the order in
    which they join, each one's parent (its place in that order, -1: the origin)
    and the length of the edge."""
    n = len(x)
    lengths = np.sqrt((x * x).sum(1))
    order, parent, edge = np.empty(n, np.int64), np.empty(n, np.int64), np.empty(n)
    best, owner, out = lengths.copy(), np.full(n, -1), np.ones(n, bool)
    for k in range(n):
        # the first root is the row nearest to the origin; a later one may hang from it, too
        i = int(np.argmin(np.where(out, best, np.inf))) if np.isfinite(best[out]).any() else int(np.flatnonzero(out)[0])
        order[k], parent[k], edge[k], out[i] = i, owner[i], best[i], False
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        closer = out & (d < best)
        best[closer], owner[closer] = d[closer], k
    return order, parent, edge


def _trees(anchors: DataFrame, by: list[str]) -> DataFrame:
    """``anchors`` with ``tree``, ``ord``, ``parent`` and ``edge``; a tree holds one value of ``by`` and at most ``TREE`` anchors."""
    kept = anchors.columns
    ordered = (anchors.withColumn("_tie", F.xxhash64("rid"))
               .repartitionByRange("dim", "label", "near", "_tie").sortWithinPartitions("dim", "label", "near", "_tie").drop("_tie"))

    def run(batches):
        from pyspark import TaskContext
        tree = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []

        def grown(table: pa.Table) -> pa.RecordBatch:
            nonlocal tree
            x = _matrix(table.column("vec").to_pylist(), table.column("dim")[0].as_py())
            with np.errstate(over="ignore", invalid="ignore"):
                order, parent, edge = spanning_tree(x)
            out = table.take(pa.array(order)).combine_chunks()
            n, tree = len(order), tree + 1
            extra = {"tree": pa.array(np.full(n, tree, np.int64)), "ord": pa.array(np.arange(n, dtype=np.int32)),
                     "parent": pa.array(parent.astype(np.int32)), "edge": pa.array(edge)}
            for name, column in extra.items():
                out = out.append_column(name, column)
            return out.to_batches(max_chunksize=n)[0]

        def cut(rows: pa.Table, last: bool) -> tuple[list[pa.Table], pa.Table]:
            keys = np.stack([rows.column(c).to_numpy() for c in by], 1)
            ends = [*(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
            full, start = [], 0
            for end in ends:
                while end - start > TREE or (end > start and (last or end < len(keys))):
                    n = min(TREE, end - start)
                    full.append(rows.slice(start, n))
                    start += n
            return full, rows.slice(start)

        for batch in batches:
            if batch.num_rows:
                full, rest = cut(pa.Table.from_batches([*held, batch]), False)
                yield from map(grown, full)
                held = rest.combine_chunks().to_batches()
        if held:
            yield from map(grown, cut(pa.Table.from_batches(held), True)[0])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ordered.schema)
    assert ordered.columns == kept
    return ordered.mapInArrow(run, schema + ", tree bigint, ord int, parent int, edge double")


# --- cells -------------------------------------------------------------------

def _cells(anchors: DataFrame, rows: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """Both sides with the cells (``by``, ``g``, ``s``) in which they meet."""
    count = lambda df, name: df.groupBy(*by).agg(F.count(F.lit(1)).alias(name))
    size = lambda n, most: F.ceil(F.col(n) / F.lit(most)).cast("int")
    plan = cut_lineage(count(rows, "_n").join(count(anchors, "_a"), by)
                       .select(*by, size("_a", CELL_ANCHORS).alias("_g"), size("_n", CELL_ROWS).alias("_s")))
    if plan.count() <= FEW_KEYS:
        plan = F.broadcast(plan)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = anchors.join(plan, by).withColumn("g", F.pmod(F.xxhash64("tree"), F.col("_g")).cast("int")).withColumn("s", every("_s"))
    right = rows.join(plan, by).withColumn("s", F.pmod(F.xxhash64("rid"), F.col("_s")).cast("int")).withColumn("g", every("_g"))
    return left.drop("_g", "_s"), right.drop("_g", "_s")


class Rows:
    """A block of rows in a cell."""

    def __init__(self, table: pa.Table, dim: int):
        col = lambda name: table.column(name).to_numpy()
        self.rid, self.id, self.label, self.copies = map(col, ("rid", "id", "label", "copies"))
        self.x = _matrix(table.column("vec").to_pylist(), dim)
        with np.errstate(over="ignore"):
            self.norm = np.sqrt((self.x * self.x).sum(1))
        self.most = float(np.abs(self.x).max(initial=0))


def _exact(v: np.ndarray, x: np.ndarray, plain: bool) -> np.ndarray:
    """Integer inner products: in doubles where every sum stays below 2^53, else in whole numbers."""
    if plain:
        return (x @ v).astype(np.int64)
    one = [int(c) for c in v.tolist()]
    sums = (sum(int(a) * b for a, b in zip(row, one)) for row in x.tolist())
    return np.array([max(-LONGEST, min(LONGEST, s)) for s in sums], np.int64)


def walk(x: np.ndarray, parent: np.ndarray, edge: np.ndarray, rows: Rows,
         choose: Callable[[int, np.ndarray, np.ndarray, Callable], tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple]:
    """Anchors of a tree in order, each with the places and scores that
    ``choose(k, low, high, score)`` scored; what is scored tightens the children's bounds."""
    n, m = len(rows.id), len(x)
    plain = rows.most * float(np.abs(x).max(initial=0)) * max(1, x.shape[1]) < EXACT
    low, high = np.zeros((m, n)), np.zeros((m, n))
    for k in range(m):
        if plain:
            reach = rows.norm * (edge[k] * (1 + 1e-9)) + 1e-6
            if parent[k] >= 0:
                slack = 1e-12 * np.maximum(np.abs(low[parent[k]]), np.abs(high[parent[k]]))
                low[k], high[k] = low[parent[k]] - reach - slack, high[parent[k]] + reach + slack
            else:
                low[k], high[k] = -reach, reach
        else:  # numbers beyond doubles: score all
            low[k], high[k] = -np.inf, np.inf
        at, score = choose(k, low[k], high[k], lambda i, k=k: _exact(x[k], rows.x if len(i) == n else rows.x[i], plain))
        if plain:
            low[k, at] = high[k, at] = score
        yield k, at, score


def _best(rows: Rows, at: np.ndarray, score: np.ndarray, copies: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``k`` by falling score, then rising id; rows as often as they stand in the table."""
    some = copies > 0
    at, score, copies = at[some], score[some], copies[some]
    if len(at) > 4 * k:
        reach = np.partition(score, len(score) - k)[len(score) - k]
        some = score >= reach
        at, score, copies = at[some], score[some], copies[some]
    order = np.lexsort((rows.id[at], -score))
    order = np.repeat(order, np.minimum(copies[order], k))[:k]
    return at[order], score[order]


def _positives(x, parent, edge, tree: dict, rows: Rows, k: int) -> Iterator[tuple]:
    def choose(a, low, high, score):
        copies = np.where(rows.label == tree["label"][a], rows.copies, 0)
        mine = np.flatnonzero(rows.rid == tree["rid"][a])
        copies[mine] -= 1
        at = np.flatnonzero(copies > 0)
        if len(at) > k:
            first = at[np.argpartition(-high[at], k - 1)[:k]]
            least = min(score(first).tolist())
            at = at[high[at] >= least]
        tree["copies_of"] = copies
        return at, score(at)

    for a, at, score in walk(x, parent, edge, rows, choose):
        at, score = _best(rows, at, score, tree["copies_of"][at], k)
        yield a, at, score


def window(score: int, low: int, high: int) -> tuple[int, int]:
    """Whole scores s with low * score <= 100 * s <= high * score."""
    return -(-low * score // 100), high * score // 100


def _negatives(x, parent, edge, tree: dict, rows: Rows, k: int, limits: tuple[int, int]) -> Iterator[tuple]:
    windows = [[window(p, *limits) for p in scores] for scores in tree["scores"]]
    merged = []
    for some in windows:
        joined: list[list[int]] = []
        for a, b in sorted(w for w in set(some) if w[0] <= w[1]):
            if joined and a <= joined[-1][1] + 1:
                joined[-1][1] = max(b, joined[-1][1])
            else:
                joined.append([a, b])
        merged.append(joined)

    def choose(a, low, high, score):
        over = np.zeros(len(low), bool)
        for first, last in merged[a]:
            over |= (high >= first) & (low <= last)
        at = np.flatnonzero(over & (rows.label != tree["label"][a]))
        return at, score(at)

    for a, at, score in walk(x, parent, edge, rows, choose):
        done: dict[tuple[int, int], tuple] = {}
        for rank, w in enumerate(windows[a]):
            if w not in done:
                inside = (score >= w[0]) & (score <= w[1])
                done[w] = _best(rows, at[inside], score[inside], rows.copies[at[inside]], k)
            if len(done[w][0]):
                yield a, rank, *done[w]


def _cell_blocks(left: pa.Table, right: pa.Table) -> Iterator[tuple]:
    """Each tree of a cell with each block of its rows."""
    if not left.num_rows or not right.num_rows:
        return
    dim = left.column("dim")[0].as_py()
    left = left.sort_by([("tree", "ascending"), ("ord", "ascending")])
    trees = left.column("tree").to_numpy()
    cuts = [0, *(np.flatnonzero(trees[1:] != trees[:-1]) + 1).tolist(), len(trees)]
    right = right.sort_by([("rid", "ascending")])
    for start in range(0, right.num_rows, BLOCK):
        rows = Rows(right.slice(start, BLOCK), dim)
        for a, b in zip(cuts, cuts[1:]):
            part = left.slice(a, b - a)
            tree = {c: part.column(c).to_numpy() for c in ("rid", "id", "label")}
            if "scores" in part.column_names:
                tree["scores"] = part.column("scores").to_pylist()
            yield (_matrix(part.column("vec").to_pylist(), dim), part.column("parent").to_numpy(),
                   part.column("edge").to_numpy(), tree, rows)


def _table(columns: list[list[np.ndarray]], names: list[str]) -> pa.Table:
    empty = np.zeros(0, np.int64)
    return pa.table({n: pa.array(np.concatenate([empty, *c]).astype(np.int64)) for n, c in zip(names, columns)})


def _first(found: DataFrame, keys: list[str], k: int, name: str) -> DataFrame:
    """The ``k`` best rows of each key; each task cuts its own share first (window group limit)."""
    best = Window.partitionBy(*keys).orderBy(F.desc("score"), "found", "at")
    return found.withColumn(name, F.row_number().over(best)).where(F.col(name) <= k)


def mine(vectors: DataFrame, is_anchor: Callable[[Column], Column], *, positives: int = 5, negatives: int = 3,
         low: int = 50, high: int = 95, scale: float = 256, id_col: str = "vec_id", vec_col: str = "embedding",
         label_col: str = "label", label: Column | None = None) -> DataFrame:
    """Per anchor, positive and hard negative: ``anchor_id, positive_id, rank,
    negative_id, positive_score, negative_score``. ``low`` and ``high`` are per cent
    of the positive's score. ``label`` may stand in for the column ``label_col``."""
    of_label = F.col(f"`{label_col}`") if label is None else label
    raw = (vectors.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), of_label.cast("bigint").alias("label"),
                          F.col(f"`{vec_col}`").cast("array<double>").alias("vec"))
           .where("id IS NOT NULL AND label IS NOT NULL AND vec IS NOT NULL"))
    rows = (raw.mapInArrow(lambda batches: _narrow(batches, scale), NARROW)
            .groupBy("id", "label", "dim", "vec", "near").agg(F.count(F.lit(1)).alias("copies")))
    rows = cut_lineage(rows.withColumn("rid", F.monotonically_increasing_id()))  # numbers of the written rows
    anchors = rows.where(is_anchor(F.col("id")))
    key = ["dim", "label"]

    def near_of_label(_, left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], []]
        for x, parent, edge, tree, block in _cell_blocks(left, right):
            for a, at, score in _positives(x, parent, edge, tree, block, positives):
                n = len(at)
                for column, v in zip(out, (np.full(n, tree["rid"][a]), block.id[at], score, block.rid[at] * positives + _nth(at))):
                    column.append(v)
        return _table(out, ["rid", "found", "score", "at"])

    trees = cut_lineage(_trees(anchors, key))
    left, right = _cells(trees, rows.drop("near"), key)
    met = (left.groupBy(*key, "g", "s").cogroup(right.groupBy(*key, "g", "s"))
           .applyInArrow(near_of_label, "rid bigint, found bigint, score bigint, at bigint"))
    best = cut_lineage(_first(met, ["rid"], positives, "nth"))

    wanted = best.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("nth", "found", "score"))).alias("p"))  # a few each
    asking = anchors.join(wanted, "rid").select(
        *anchors.columns, F.transform("p", lambda p: p["score"]).alias("scores"), F.transform("p", lambda p: p["found"]).alias("partners"))
    trees = cut_lineage(_trees(asking, ["dim"]))

    def in_windows(_, left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], [], []]
        for x, parent, edge, tree, block in _cell_blocks(left, right):
            for a, nth, at, score in _negatives(x, parent, edge, tree, block, negatives, (low, high)):
                n = len(at)
                for column, v in zip(out, (np.full(n, tree["rid"][a]), np.full(n, nth), block.id[at], score,
                                           block.rid[at] * negatives + _nth(at))):
                    column.append(v)
        return _table(out, ["rid", "nth", "found", "score", "at"])

    left, right = _cells(trees.drop("near", "partners"), rows.drop("near"), ["dim"])
    met = (left.groupBy("dim", "g", "s").cogroup(right.groupBy("dim", "g", "s"))
           .applyInArrow(in_windows, "rid bigint, nth bigint, found bigint, score bigint, at bigint"))
    hard = _first(met, ["rid", "nth"], negatives, "rank")
    named = trees.select("rid", F.col("id").alias("anchor_id"), "copies", "partners", "scores")
    return (hard.join(named, "rid")
            .withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))))
            .select("anchor_id", F.element_at("partners", (F.col("nth") + 1).cast("int")).alias("positive_id"),
                    F.col("rank").cast("int").alias("rank"), F.col("found").alias("negative_id"),
                    F.element_at("scores", (F.col("nth") + 1).cast("int")).alias("positive_score"),
                    F.col("score").alias("negative_score")))


def _nth(at: np.ndarray) -> np.ndarray:
    """Which time a place stands here (copies of a row follow each other)."""
    n = np.arange(len(at))
    new = np.concatenate([[True], at[1:] != at[:-1]])[:len(at)]
    return n - np.maximum.accumulate(np.where(new, n, 0)) if len(at) else n
