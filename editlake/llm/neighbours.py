"""Nearest neighbours by inner product along shifted Hilbert curves.

1. Vectors are scaled by the largest norm and given one more component that
   makes their length 1 (queries: 0), which turns the largest inner product
   into the smallest distance. Each of ``CURVES`` curves rotates them at
   random, keeps ``AXES`` components, shifts them, and takes the Hilbert index
   of the quantised point; the low bits of the key are a hash of the id, so
   equal vectors spread over neighbouring ranges instead of filling one.
2. Quantiles of the keys (an approximate aggregate over all rows) cut each
   curve into ranges of near-equal size. Every row goes to its range on every
   curve. A query also goes to the ranges next to its own, so the windows
   overlap; in a range the query meets the rows in one matrix product.
3. The windows' results merge: the best ``k`` per query, and the score of the
   last of them as its threshold.
4. An exact check follows (``exact``): a range of the first curve is summed up
   by its centre and radius, which bound every inner product in it. A query
   visits the ranges whose bound reaches its threshold and takes what reaches
   it. On clustered vectors few ranges remain; on vectors without structure
   the bound can exclude little, and the visit is a scan in blocks.

There are at most ``MAX_RANGES`` ranges, so quantiles and range summaries have
a fixed bound; a range holds ``max(RANGE_ROWS, n / MAX_RANGES)`` rows. Queries and
rows of a range meet in cells: the queries are cut into blocks of about
``QUERY_BLOCK`` and the rows into blocks of about ``ROW_BLOCK``, by hashes of their
ids, and every pair of blocks is a group of its own. So no task grows with the
table, also where most queries visit one range (one very long vector is enough).

Defined results: vectors that are null, zero, or hold null or non-finite
components take no part, nor do null ids. Of rows with equal ids one takes
part (the smallest vector in byte order). Vectors of another length than most
take no part. Equal scores rank by the smaller id. An empty table gives an
empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage

CURVES, AXES, BITS = 3, 6, 8
TIE_BITS = 63 - AXES * BITS
RANGE_ROWS, MAX_RANGES = 4096, 4096
QUERY_BLOCK, ROW_BLOCK = 1024, 16384
CHUNK = 64      # queries compared at once
SLACK = 1e-9    # relative; matrix products only choose what is scored exactly


# --- curves -------------------------------------------------------------------

def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index of rows of integer coordinates of ``bits`` bits each."""
    x = points.astype(np.uint64).T.copy()
    axes = len(x)
    one = np.uint64(1)
    q = 1 << (bits - 1)
    while q > 1:  # undo excess work of the inverse transform, high bits first
        low, bit = np.uint64(q - 1), np.uint64(q)
        for i in range(axes):
            flip = (x[i] & bit) != 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & low).astype(np.uint64)
            x[0] = np.where(flip, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, axes):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[-1] & np.uint64(q)) != 0, t ^ np.uint64(q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(axes):
            key = key << one | (x[i] >> np.uint64(b) & one)
    return key


def _curve(dim: int, curve: int) -> tuple[np.ndarray, np.ndarray]:
    """Projection and shift of a curve (the same in every task)."""
    rng = np.random.default_rng(1000 + curve)
    basis, _ = np.linalg.qr(rng.normal(size=(dim + 1, min(AXES, dim + 1))))
    return basis, rng.uniform(0, 0.5, min(AXES, dim + 1)) * (curve > 0)


def keys(vectors: np.ndarray, extra: np.ndarray, ids: np.ndarray, curve: int) -> np.ndarray:
    dim = vectors.shape[1]
    basis, shift = _curve(dim, curve)
    at = np.concatenate([vectors, extra[:, None]], 1) @ basis * np.sqrt(dim + 1)
    unit = (np.tanh(at / 2) + 1) / 4 + shift  # in [0, 1)
    cells = np.minimum((unit * (1 << BITS)).astype(np.int64), (1 << BITS) - 1)
    tie = (ids.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - TIE_BITS)
    used = np.uint64(cells.shape[1] * BITS)
    return (hilbert(cells, BITS) << np.uint64(63 - int(used)) | tie).astype(np.int64)


# --- rows -----------------------------------------------------------------------

def _valid(vectors: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which rows take part, their offsets, and all components."""
    values = vectors.values.to_numpy(zero_copy_only=False).astype(np.float64)  # null components become NaN
    off = np.asarray(vectors.offsets, np.int64)
    count = lambda flag: np.diff(np.concatenate([[0], np.cumsum(flag)])[off])
    ok = (count(~np.isfinite(values)) == 0) & (count(values != 0) > 0)
    return ok & ~np.asarray(vectors.is_null()), off, values


def usable(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id, dim, norm, vec`` (doubles as bytes) of the rows that take part."""

    def run(batches):
        for batch in batches:
            ok, off, values = _valid(batch.column("vec"))
            ids = batch.column("id")
            at = np.flatnonzero(ok & np.asarray(ids.is_valid()))
            rows = [values[off[i]:off[i + 1]] for i in at.tolist()]
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(at)), pa.array([len(r) for r in rows], pa.int32()),
                 pa.array([float(np.sqrt(r @ r)) for r in rows], pa.float64()),
                 pa.array([r.astype("<f8").tobytes() for r in rows], pa.binary())], ["id", "dim", "norm", "vec"])

    rows = (table.select(F.col(f"`{id_col}`").cast("bigint").alias("id"),
                         F.col(f"`{vector_col}`").cast(T.ArrayType(T.DoubleType())).alias("vec"))
            .mapInArrow(run, "id bigint, dim int, norm double, vec binary"))
    return rows.groupBy("id").agg(F.min(F.struct("vec", "dim", "norm")).alias("m")).select("id", "m.*")


def _matrix(column, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(-1, dim)


def best(query_ids, queries, ids, rows, k: int, at_least=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(query, row, score)``: per query its best ``k`` rows (or all rows that
    reach ``at_least``), its own id left out. Scores are sums over the products
    from first to last, so equal vectors have equal scores."""
    out_q, out_r, out_s = [], [], []
    for a in range(0, len(queries) if len(rows) else 0, CHUNK):
        q, qi = queries[a:a + CHUNK], query_ids[a:a + CHUNK]
        rough = q @ rows.T
        rough[qi[:, None] == ids[None, :]] = -np.inf
        if at_least is None:
            kth = np.partition(rough, -k, axis=1)[:, -k] if rough.shape[1] > k else np.full(len(q), -np.inf)
        else:
            kth = at_least[a:a + CHUNK]
        slack = SLACK * (1 + np.abs(np.where(np.isfinite(kth), kth, 0)))
        i, j = np.nonzero((rough >= (kth - slack)[:, None]) & (rough > -np.inf))
        score = np.concatenate([np.cumsum(q[i[s:s + 32768]] * rows[j[s:s + 32768]], axis=1)[:, -1]
                                for s in range(0, len(i), 32768)] or [np.zeros(0)])
        order = np.lexsort((ids[j], -score, i))
        i, j, score = i[order], j[order], score[order]
        nth = np.arange(len(i)) - np.searchsorted(i, i)
        keep = nth < k
        out_q.append(qi[i[keep]])
        out_r.append(ids[j[keep]])
        out_s.append(score[keep])
    if not out_q:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return np.concatenate(out_q), np.concatenate(out_r), np.concatenate(out_s)


FOUND = "query_id bigint, vec_id bigint, score double"


def _found(q, r, s) -> pa.Table:
    return pa.table({"query_id": pa.array(q, pa.int64()), "vec_id": pa.array(r, pa.int64()),
                     "score": pa.array(s, pa.float64())})


def _top(found: DataFrame, k: int) -> DataFrame:
    by = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
            .withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k))


def in_cells(asking: DataFrame, rows: DataFrame, by: list[str], in_range: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with the blocks ``g`` (of queries) and ``s`` (of rows) of their
    range in which they meet. ``in_range`` is the number of rows in a range."""
    blocks = max(1, -(-in_range // ROW_BLOCK))
    plan = asking.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / F.lit(QUERY_BLOCK)).cast("int").alias("_g"))  # a line per range
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    left = asking.join(F.broadcast(plan), by).withColumn("g", F.pmod(F.xxhash64("id"), F.col("_g")).cast("int"))
    right = rows.join(F.broadcast(plan), by).withColumn("s", F.pmod(F.xxhash64(F.col("id"), F.lit(1)), F.lit(blocks)).cast("int"))
    return left.withColumn("s", every(F.lit(blocks))).drop("_g"), right.withColumn("g", every(F.col("_g"))).drop("_g")


def search(table: DataFrame, is_query, *, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
           exact: bool = True, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score`` for the rows whose ``id_col`` satisfies
    ``is_query`` (a function of a column)."""
    spark = table.sparkSession
    everything = cut_lineage(usable(table, id_col, vector_col))
    shape = (everything.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.max("norm").alias("top"))
             .orderBy(F.col("n").desc(), "dim").limit(1).collect())
    if not shape:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    dim, n, top = shape[0]
    rows = everything.where(F.col("dim") == dim).select("id", "vec", is_query(F.col("id")).alias("asks"))

    def keyed(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column("id").to_numpy()
            x = _matrix(batch.column("vec"), dim) / top
            length = np.minimum((x * x).sum(1), 1)
            as_row = [keys(x, np.sqrt(1 - length), ids, c) for c in range(CURVES)]
            unit = x / np.sqrt(np.maximum(length, 1e-300))[:, None]
            as_query = [keys(unit, np.zeros(len(x)), ids, c) for c in range(CURVES)]
            pack = lambda cols: pa.FixedSizeListArray.from_arrays(pa.array(np.stack(cols, 1).ravel()), CURVES).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pack(as_row), pack(as_query)],
                                             ["id", "vec", "asks", "keys", "asked"])

    keyed_rows = cut_lineage(rows.mapInArrow(keyed, "id bigint, vec binary, asks boolean, keys array<bigint>, asked array<bigint>"))
    ranges = int(min(MAX_RANGES, max(1, -(-n // range_rows))))
    cuts = [i / ranges for i in range(1, ranges)]
    bounds = (keyed_rows.agg(*[F.percentile_approx(F.col("keys")[c], cuts, 10 * ranges).alias(f"c{c}")
                               for c in range(CURVES)]).first() if cuts else [[]] * CURVES)  # MAX_RANGES values a curve
    bounds = spark.sparkContext.broadcast([np.array(bounds[c] or [], np.int64) for c in range(CURVES)])
    sent = "curve int, part int, id bigint, vec binary"

    def out(batch, curve: int, at: np.ndarray, part: np.ndarray) -> pa.RecordBatch:
        take = pa.array(at)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(at), curve, np.int32)), pa.array(part.astype(np.int32)),
             batch.column("id").take(take), batch.column("vec").take(take)], ["curve", "part", "id", "vec"])

    def send_rows(batches):
        for batch in batches:
            if batch.num_rows:
                mine = np.stack(batch.column("keys").to_numpy(zero_copy_only=False))
                for c in range(CURVES):
                    yield out(batch, c, np.arange(batch.num_rows), np.searchsorted(bounds.value[c], mine[:, c], "right"))

    def send_queries(batches):
        for batch in batches:
            if batch.num_rows:
                asked = np.stack(batch.column("asked").to_numpy(zero_copy_only=False))
                for c in range(CURVES):
                    cut = bounds.value[c]
                    own = np.searchsorted(cut, asked[:, c], "right")
                    for step in (-1, 0, 1):
                        inside = np.flatnonzero((own + step >= 0) & (own + step <= len(cut)))
                        yield out(batch, c, inside, own[inside] + step)

    def meet(_, asking: pa.Table, held: pa.Table) -> pa.Table:
        return _found(*best(asking.column("id").to_numpy(), _matrix(asking.column("vec"), dim),
                            held.column("id").to_numpy(), _matrix(held.column("vec"), dim), k))

    in_range = -(-n // ranges)
    asking, held = in_cells(keyed_rows.where("asks").mapInArrow(send_queries, sent), keyed_rows.mapInArrow(send_rows, sent),
                            ["curve", "part"], in_range)
    cell = ["curve", "part", "g", "s"]
    windows = asking.groupBy(*cell).cogroup(held.groupBy(*cell)).applyInArrow(meet, FOUND)
    merged = _top(windows, k)
    if exact:
        merged = _top(_check(keyed_rows, cut_lineage(merged), bounds, dim, k, in_range), k)
    return merged.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _check(rows: DataFrame, merged: DataFrame, bounds, dim: int, k: int, in_range: int) -> DataFrame:
    """Windows' results and all else that reaches a query's threshold."""
    spark = rows.sparkSession

    def place(batches):
        for batch in batches:
            mine = np.array([x[0] for x in batch.column("keys").to_pylist()], np.int64)
            part = np.searchsorted(bounds.value[0], mine, "right").astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(part), batch.column("id"), batch.column("vec")], ["part", "id", "vec"])

    placed = rows.select("id", "vec", "keys").mapInArrow(place, "part int, id bigint, vec binary")

    def sum_up(group: pa.Table) -> pa.Table:
        x = _matrix(group.column("vec"), dim)
        centre = x.mean(0)
        return pa.table({"part": group.column("part").slice(0, 1), "centre": pa.array([centre.tolist()]),
                         "radius": pa.array([float(np.sqrt(((x - centre) ** 2).sum(1).max()))])})

    parts = placed.groupBy("part").applyInArrow(sum_up, "part int, centre array<double>, radius double").collect()
    held = spark.sparkContext.broadcast((np.array([p.part for p in parts], np.int32),     # MAX_RANGES rows
                                         np.array([p.centre for p in parts]), np.array([p.radius for p in parts])))
    last = merged.groupBy("query_id").agg(F.min("score").alias("low"), F.count(F.lit(1)).alias("n"))
    asking = (rows.where("asks").select("id", "vec").join(last, F.col("id") == F.col("query_id"), "left")
              .select("id", "vec", F.when(F.col("n") >= k, F.col("low")).alias("low")))

    def visit(batches):
        number, centre, radius = held.value
        for batch in batches:
            if not batch.num_rows:
                continue
            q = _matrix(batch.column("vec"), dim)
            low = batch.column("low").to_numpy(zero_copy_only=False).astype(float)
            low = np.where(np.isnan(low), -np.inf, low)
            bound = q @ centre.T + np.sqrt((q * q).sum(1))[:, None] * radius[None, :]
            i, j = np.nonzero(bound * (1 + np.sign(bound) * SLACK) + SLACK >= low[:, None])
            take = pa.array(i)
            yield pa.RecordBatch.from_arrays([pa.array(number[j]), batch.column("id").take(take),
                                              batch.column("vec").take(take), pa.array(low[i])], ["part", "id", "vec", "low"])

    visits = asking.mapInArrow(visit, "part int, id bigint, vec binary, low double")

    def scan(_, asking: pa.Table, held: pa.Table) -> pa.Table:
        return _found(*best(asking.column("id").to_numpy(), _matrix(asking.column("vec"), dim), held.column("id").to_numpy(),
                            _matrix(held.column("vec"), dim), k, asking.column("low").to_numpy()))

    asking, held = in_cells(visits, placed, ["part"], in_range)
    found = asking.groupBy("part", "g", "s").cogroup(held.groupBy("part", "g", "s")).applyInArrow(scan, FOUND)
    return merged.select("query_id", "vec_id", "score").unionAll(found)
