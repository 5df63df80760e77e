"""Training-set assembly: T1-T7.

Pools are long tables ``(pool_id, shard, row_id, pos)`` with a dense 0-based
``pos``: ``pool_id = -1`` is the image pool of a split (every row, typed or
not), ``pool_id = type_id`` is that type's index. Sampling never point-reads:
draws become ``(pool_id, pos)`` keys and meet the pools in one equi-join.
All randomness is the portable hash of ``functions.hashing``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import taxonomy as tx
from ..functions import hashing as H
from ..functions.literal import literal_table
from .ordering import ordered_position
from .select import classified, drop_unnamed, min_support, split_train_val

IMAGE_POOL = -1
SALTED_KEYS = 4096
SYNTH_IDS = [tx.TYPE_ID[n] for n in tx.SYNTHETIC_TYPES]


def build_pools(prepared: DataFrame, split: str, want_val: int = 30,
                min_rows: int = tx.MIN_TYPE_SUPPORT, materialize: bool = False) -> DataFrame:
    """Image pool of ``split`` plus the per-type index after R6.

    ``materialize`` checkpoints the pools into the shared checkpoint folder:
    sampling reads them several times (sizes, draws, validation items), and a
    reliable checkpoint both avoids recomputing the split and positions and
    survives the loss of executors.
    """
    pools = _build_pools(prepared, split, want_val, min_rows, materialize)
    if materialize:
        from ..session import cut_lineage
        return cut_lineage(pools)
    return pools


def _build_pools(prepared: DataFrame, split: str, want_val: int, min_rows: int,
                 materialize: bool) -> DataFrame:
    rows = split_train_val(prepared, want_val).where(F.col("split") == split).drop("shard_rows")
    typed = classified(rows).select("shard", "row_id", "type_id")
    if materialize:
        # Read three times below (support counts, position counts, rows).
        from ..session import cut_lineage
        typed = cut_lineage(typed)
    # Types with enough rows in this split: at most 64 rows, broadcast.
    keep = (typed.where(F.col("type_id").isNotNull()).groupBy("type_id")
            .agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_rows)
            .select(F.col("type_id").alias("pool_id"), F.lit(True).alias("_kept")))
    # Every row is in the image pool, and in its type's pool when the type is
    # kept: one explode, then one ordered-position pass for all pools at once.
    member = typed.select("shard", "row_id", F.explode(F.array(
        F.lit(IMAGE_POOL).cast("bigint"), F.col("type_id"))).alias("pool_id")).where(
        F.col("pool_id").isNotNull())
    kept = (member.join(F.broadcast(keep), "pool_id", "left")
            .where((F.col("pool_id") == IMAGE_POOL) | F.col("_kept")).drop("_kept"))
    pos = ordered_position(kept, ["pool_id"], ["shard"], "row_id", name="pos", total_name="pool_size")
    return pos.select("pool_id", "shard", "row_id", (F.col("pos") - 1).alias("pos"), "pool_size")


def pool_sizes(pools: DataFrame) -> dict[int, int]:
    """Rows per pool. At most 65 entries (image pool + one per type id), so
    this small result is the one thing brought to the driver."""
    rows = pools.groupBy("pool_id").agg(F.max("pool_size").alias("size")).collect()
    return {int(r["pool_id"]): int(r["size"]) for r in rows}


def choice_rows(sizes: dict[int, int]) -> list[tuple]:
    """(kind, idx, type_id, pool_id, size, slot) per sampleable type: kind 0 =
    the 13 synthetic types over the image pool, kind 1 = indexed types in
    ascending id order; ``slot`` is the position in that combined order."""
    image = sizes.get(IMAGE_POOL, 0)
    out = [(0, i, t, IMAGE_POOL, image, i) for i, t in enumerate(SYNTH_IDS)]
    real = sorted(k for k in sizes if k >= 0)
    out += [(1, i, t, t, sizes[t], len(SYNTH_IDS) + i) for i, t in enumerate(real)]
    return out


def choice_table(spark: SparkSession, sizes: dict[int, int]) -> DataFrame:
    return literal_table(spark, choice_rows(sizes),
                         "kind int, idx bigint, type_id bigint, pool_id bigint, size bigint, slot bigint")


def mixture_sample(pools: DataFrame, draws: DataFrame | int, seed: int,
                   synthetic_share: float = 0.25) -> DataFrame:
    """Draws with replacement. With probability ``1 - synthetic_share`` an
    indexed type uniformly, else a synthetic type uniformly (always synthetic
    when no type is indexed); then a row uniformly from that type's pool.

    ``draws`` is a count (``spark.range``) or a DataFrame with ``draw_id``.

    A small pool would meet all draws of its type in a few join keys, so its
    refs are repeated under ``SALTED_KEYS`` keys in total and every draw picks
    one of the copies by its hash; that adds at most ``SALTED_KEYS`` lines a pool.
    """
    sizes = pool_sizes(pools)
    d = _draw_positions(pools.sparkSession, draws, sizes, seed, synthetic_share)
    return _meet(d, pools.select("pool_id", "pos", "shard", "row_id", "pool_size"))


def _draw_positions(spark: SparkSession, draws: DataFrame | int, sizes: dict[int, int], seed: int, synthetic_share: float) -> DataFrame:
    """Per draw its type, pool, the pool's size, and a position in the pool."""
    if isinstance(draws, int):
        draws = spark.range(draws).withColumnRenamed("id", "draw_id")
    k_real = sum(1 for t in sizes if t >= 0)
    u = lambda k: H.uniform(seed, F.col("draw_id"), k)
    kind = F.when(F.lit(k_real > 0) & (u(0) >= synthetic_share), 1).otherwise(0)
    d = draws.select("draw_id").withColumn("kind", kind).withColumn(
        "idx", F.floor(u(1) * F.when(F.col("kind") == 1, F.lit(k_real))
                       .otherwise(F.lit(len(SYNTH_IDS)))).cast("bigint"))
    return (d.join(choice_table(spark, sizes), ["kind", "idx"])
            .withColumn("pos", F.floor(u(2) * F.col("size")).cast("bigint")))


def _meet(d: DataFrame, refs: DataFrame) -> DataFrame:
    """Draws with the rows at their positions; refs of small pools are repeated under salts."""
    copies = lambda size: F.greatest(F.lit(1), F.ceil(F.lit(SALTED_KEYS) / size)).cast("bigint")
    d = d.withColumn("salt", F.pmod(F.xxhash64("draw_id"), copies(F.col("size"))))
    refs = refs.select("pool_id", "pos", "shard", "row_id", F.explode(
        F.sequence(F.lit(0).cast("bigint"), copies(F.col("pool_size")) - 1)).alias("salt"))
    return d.join(refs, ["pool_id", "pos", "salt"]).select("draw_id", "type_id", "pool_id", "shard", "row_id")


BLOCK_BITS = 1 << 15   # rows of a bitmap (Spark's bitmap aggregate holds 4 KB)
STRIDE = 1024          # positions of an entry that leads to bitmaps


def build_index(prepared: DataFrame, split: str, want_val: int = 30, min_rows: int = tx.MIN_TYPE_SUPPORT) -> DataFrame:
    """T1/A10 as bitmaps: per pool, shard and block of row ids one bitmap of the
    pool's rows, their number ``n`` and the rows before them in the pool (``off``).

    Same pools as ``build_pools``, at 4 KB for up to 32,768 rows instead of a
    line for every row; a row is never shuffled, only its task's partial bitmaps
    are. ``row_id`` counts within a shard (a position in a file)."""
    from ..session import cut_lineage
    rows = split_train_val(prepared, want_val).where(F.col("split") == split).drop("shard_rows")
    typed = classified(rows).select("shard", "row_id", "type_id")
    member = typed.select("shard", "row_id", F.explode(F.array(F.lit(IMAGE_POOL).cast("bigint"), F.col("type_id"))).alias("pool_id"))
    blocks = (member.where(F.col("pool_id").isNotNull())
              .groupBy("pool_id", F.struct("shard").alias("at"), F.expr(f"row_id div {BLOCK_BITS}").alias("block"))
              .agg(F.bitmap_construct_agg(F.col("row_id") % BLOCK_BITS).alias("bits")))
    blocks = cut_lineage(blocks.withColumn("n", F.bitmap_count("bits")))
    counts = blocks.select("pool_id", "at", "block", "n")  # from here on without the bitmaps
    before = Window.partitionBy("pool_id").orderBy("at", "block").rowsBetween(Window.unboundedPreceding, -1)
    counts = (counts.withColumn("off", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("bigint"))
              .withColumn("pool_size", F.sum("n").over(Window.partitionBy("pool_id")).cast("bigint"))
              .where((F.col("pool_id") == IMAGE_POOL) | (F.col("pool_size") >= min_rows)))
    return blocks.drop("n").join(counts, ["pool_id", "at", "block"])


def rows_at(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows at positions of pools: ``wanted`` (``pool_id, pos``, distinct) ->
    ``pool_id, pos, shard, row_id, pool_size``.

    A position meets the entry of its stride, which lists the blocks that the
    stride runs through (one row each at least, so ``STRIDE`` + 1 at most); the
    positions of a block (its rows at most) then meet its bitmap once, and the
    k-th set bit is the row."""
    import numpy as np
    import pyarrow as pa

    places = index.select("pool_id", "pool_size", F.struct("off", "n", "at", "block").alias("b"), F.explode(
        F.sequence(F.expr(f"off div {STRIDE}"), F.expr(f"(off + n - 1) div {STRIDE}"))).alias("stride"))
    strides = places.groupBy("pool_id", "stride").agg(F.collect_list("b").alias("blocks"), F.max("pool_size").alias("pool_size"))
    met = wanted.withColumn("stride", F.expr(f"pos div {STRIDE}")).join(strides, ["pool_id", "stride"])
    of = F.element_at(F.filter("blocks", lambda b: (b["off"] <= F.col("pos")) & (F.col("pos") < b["off"] + b["n"])), 1)
    located = met.select("pool_id", "pool_size", "pos", of.alias("b")).select(
        "pool_id", "pool_size", "b.at", "b.block", F.struct((F.col("pos") - F.col("b.off")).alias("k"), "pos").alias("p"))
    asked = located.groupBy("pool_id", "pool_size", "at", "block").agg(F.collect_list("p").alias("p"))
    both = asked.join(index.select("pool_id", "at", "block", "bits"), ["pool_id", "at", "block"]).select(
        "pool_id", "pool_size", F.col("at.shard").alias("shard"), "block", "p", "bits")

    def select(batches):
        for batch in batches:
            pools, sizes, shards, rows, places = [], [], [], [], []
            for pool, size, shard, block, asked, bits in zip(*(batch.column(c).to_pylist() for c in batch.schema.names)):
                ones = np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little"))
                k = np.array([a["k"] for a in asked], np.int64)
                rows.append(block * BLOCK_BITS + ones[k])
                places.append(np.array([a["pos"] for a in asked], np.int64))
                pools += [pool] * len(k)
                sizes += [size] * len(k)
                shards += [shard] * len(k)
            none = np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(pools, pa.int64()), pa.array(np.concatenate([none, *places])), pa.array(shards, pa.int64()),
                 pa.array(np.concatenate([none, *rows])), pa.array(sizes, pa.int64())],
                names=["pool_id", "pos", "shard", "row_id", "pool_size"])

    return both.mapInArrow(select, "pool_id bigint, pos bigint, shard bigint, row_id bigint, pool_size bigint")


def mixture_sample_indexed(index: DataFrame, draws: DataFrame | int, seed: int, synthetic_share: float = 0.25) -> DataFrame:
    """T2 from the bitmap index: the same draws as ``mixture_sample``, but only
    the rows that are drawn ever become lines, and they alone meet the draws."""
    sizes = pool_sizes(index)
    d = _draw_positions(index.sparkSession, draws, sizes, seed, synthetic_share)
    return _meet(d, rows_at(index, d.select("pool_id", "pos").distinct()))


def val_items(pools: DataFrame, val_pairs: int) -> DataFrame:
    """For k in 0..val_pairs-1 and every sampleable type (synthetic first,
    then indexed ids ascending): the row at ``k mod size`` of its pool."""
    spark = pools.sparkSession
    choices = choice_table(spark, pool_sizes(pools))
    items = (choices.withColumn("k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(val_pairs - 1).cast("bigint"))))
             .withColumn("pos", (F.col("k") % F.col("size")).cast("bigint")))
    refs = pools.select("pool_id", "pos", "shard", "row_id")
    return items.join(refs, ["pool_id", "pos"]).select(
        "k", "slot", "type_id", "pool_id", "shard", "row_id")


def cond_dropout(draws: DataFrame, seed: int, p_type: float, p_image: float) -> DataFrame:
    """T4: independent masks: the type becomes null (0) with ``p_type``, the
    input image is dropped (zeros) with ``p_image``."""
    td = H.uniform(seed, F.col("draw_id"), 3) < p_type
    idr = H.uniform(seed, F.col("draw_id"), 4) < p_image
    return (draws.withColumn("type_dropped", td).withColumn("image_dropped", idr)
            .withColumn("type_in", F.col("type_id"))
            .withColumn("type_id", F.when(td, F.lit(tx.TYPE_ID[tx.NULL_TYPE_NAME]).cast("bigint"))
                        .otherwise(F.col("type_id"))))


def flip_augment(draws: DataFrame, seed: int, train: bool = True) -> DataFrame:
    """T5: mirror both images with p = 0.5, train split only."""
    flag = (H.uniform(seed, F.col("draw_id"), 5) < 0.5) if train else F.lit(False)
    return draws.withColumn("flipped", flag)


def exposure_report(draws: DataFrame, pools: DataFrame, synthetic_share: float) -> DataFrame:
    """Expected and actual share per type of a sampled set."""
    sizes = pool_sizes(pools)
    k_real = sum(1 for t in sizes if t >= 0)
    rows = []
    for kind, _, type_id, _, _, _ in choice_rows(sizes):
        if k_real == 0:
            share = 1.0 / len(SYNTH_IDS)
        elif kind == 1:
            share = (1.0 - synthetic_share) / k_real
        else:
            share = synthetic_share / len(SYNTH_IDS)
        rows.append((type_id, share))
    expected = literal_table(draws.sparkSession, rows, "type_id bigint, expected double")
    counts = draws.groupBy("type_id").agg(F.count(F.lit(1)).alias("n"))
    # The count table has one row per type id (taxonomy-bounded), so the
    # total over it is a window over at most 64 rows.
    actual = counts.withColumn("actual", F.col("n") / F.sum("n").over(Window.partitionBy()))
    return (expected.join(actual, "type_id", "full")
            .select("type_id", F.round(F.coalesce("expected", F.lit(0.0)), 6).alias("expected"),
                    F.round(F.coalesce("actual", F.lit(0.0)), 6).alias("actual"),
                    F.coalesce("n", F.lit(0)).cast("bigint").alias("n")))


GREY = 128  # stored byte of a dropped image: the zero of normalised pixels


def materialize_examples(draws: DataFrame, corpus_images: DataFrame) -> DataFrame:
    """Refs -> (before, after, type). ``after`` is the exact edit for
    synthetic types (stored rounded) and the stored after-image otherwise;
    flips mirror both images, and a dropped input image is all grey.

    Rows of the corpus are keyed by (shard, row_id), the position in a file.
    ``corpus_images`` has (shard, row_id, px, after_px, res). One join brings
    the pixels to the draws and one Arrow job edits, flips and drops; a row
    drawn very often is a hot key of that join, which AQE splits.
    """
    import numpy as np
    import pyarrow as pa

    from .images import EDITS, bounded, normalize_u8, stored_u8, _binary_matrix

    imgs = corpus_images.select("shard", "row_id", "px", "after_px", "res")
    joined = draws.select("draw_id", "shard", "row_id", "type_id", "type_in", "flipped", "image_dropped").join(
        imgs, ["shard", "row_id"]).drop("shard", "row_id")
    names = {tx.TYPE_ID[n]: n for n in tx.SYNTHETIC_TYPES}

    def run(batches):
        for b in bounded(batches):
            n = b.num_rows
            if n == 0:
                continue
            res = np.asarray(b.column("res").fill_null(0).to_numpy(zero_copy_only=False), np.int64)
            kind = np.asarray(b.column("type_in").fill_null(-1).to_numpy(zero_copy_only=False), np.int64)
            flips = np.asarray(b.column("flipped").fill_null(False).to_numpy(zero_copy_only=False), bool)
            drops = np.asarray(b.column("image_dropped").fill_null(False).to_numpy(zero_copy_only=False), bool)
            has_px, has_after = (np.asarray(b.column(c).is_valid()) for c in ("px", "after_px"))
            before, after = [None] * n, [None] * n
            for r in np.unique(res[res > 0]).tolist():
                width = 3 * r * r
                for name, store, have in (("px", before, has_px), ("after_px", after, has_after)):
                    edited = np.isin(kind, list(names)) if name == "after_px" else np.zeros(n, bool)
                    rows = np.flatnonzero((res == r) & have & ~edited)
                    if len(rows):
                        stack = _binary_matrix(b.column(name), width, rows).reshape(-1, 3, r, r)
                        _place(store, rows, stack, flips, drops if name == "px" else None)
                for t in np.unique(kind[res == r]).tolist():
                    rows = np.flatnonzero((res == r) & (kind == t) & has_px) if t in names else []
                    if len(rows):
                        x = normalize_u8(_binary_matrix(b.column("px"), width, rows)).reshape(-1, 3, r, r)
                        _place(after, rows, stored_u8(EDITS[names[t]](x)), flips, None)
            yield pa.RecordBatch.from_arrays(
                [b.column("draw_id"), b.column("type_id"), b.column("res"),
                 pa.array(before, pa.binary()), pa.array(after, pa.binary()),
                 b.column("flipped"), b.column("image_dropped")],
                names=["draw_id", "type_id", "res", "before", "after", "flipped", "image_dropped"])

    def _place(store, rows, stack, flips, drops):
        mirrored = flips[rows]
        stack[mirrored] = stack[mirrored][..., ::-1].copy()
        if drops is not None:
            stack[drops[rows]] = GREY
        for i, image in zip(rows, stack):
            store[i] = image.tobytes()

    schema = ("draw_id bigint, type_id bigint, res int, before binary, after binary, "
              "flipped boolean, image_dropped boolean")
    return joined.mapInArrow(run, schema)
