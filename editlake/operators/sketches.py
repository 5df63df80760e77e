"""Mergeable sketches: U2 over many slices, and A4/A8 over many shards.

**Overlap of slices** (theta sketches). One sketch per slice is made in one
pass and stored beside it; sizes, unions and intersections of any slices then
follow from the sketches alone, without reading a slice again. Up to ``2^lg``
distinct values a sketch is exact; beyond, it keeps a hash sample and the
estimates carry an error that ``sketch_overlap`` reports.

**Heads of shards** (frequent-items sketches). One sketch per shard (and group)
names the items that can be frequent; sketches of new shards are added, old
ones are never read again. Only the items they name are counted over the rows,
so the result is exact: an item that no sketch names occurs in at most
``MISSED * rows / tracked`` rows, and where the ``k``-th count does not exceed
that bound the group is counted in full. What is counted is one row per named
item, not one per distinct item.

Null values are no items: they count neither as distinct values nor as heads.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

LG_NOMINAL = 14
TRACKED = 10_000
#: Share of the rows, in units of 1 / tracked items, that an unnamed item can
#: have: 3.5 / 0.75 of the sketch's error bound, twice, as named items must
#: exceed the error themselves.
MISSED = 2 * 3.5 * 0.75


# --- distinct values of slices ---------------------------------------------------

def slice_sketches(slices: dict[str, DataFrame], col: str = "instruction", lg: int = LG_NOMINAL) -> DataFrame:
    """One row per slice: ``slice, sketch, lg``. A slice without values has an empty sketch."""
    out = None
    for name, df in slices.items():
        one = df.agg(F.theta_sketch_agg(F.col(col), F.lit(lg)).alias("sketch")).select(
            F.lit(name).alias("slice"), "sketch", F.lit(lg).alias("lg"))
        out = one if out is None else out.unionAll(one)
    return out


def store_sketches(sketches: DataFrame, folder: str) -> None:
    """Write the sketches of some slices; those of other slices in the folder stay."""
    (sketches.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("slice").parquet(folder))


def stored_sketches(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("sketch binary, lg int, slice string").parquet(folder)


def sketch_overlap(sketches: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """For pairs of slices: distinct values of each, shared values, the share of
    the smaller slice that they cover, and the error (two standard deviations;
    0 where the sketches are exact) of ``shared``."""
    spark = sketches.sparkSession
    asked = spark.createDataFrame(list(pairs), "slice_a string, slice_b string")
    side = lambda s: sketches.select(F.col("slice").alias(f"slice_{s}"), F.col("sketch").alias(f"_{s}"), F.col("lg").alias(f"_lg_{s}"))
    both = asked.join(side("a"), "slice_a").join(side("b"), "slice_b")
    size = lambda c: F.theta_sketch_estimate(c)
    found = both.select("slice_a", "slice_b", size("_a").cast("bigint").alias("distinct_a"), size("_b").cast("bigint").alias("distinct_b"),
                        size(F.theta_intersection("_a", "_b")).cast("bigint").alias("shared"),
                        F.pow(F.lit(2.0), F.least("_lg_a", "_lg_b")).alias("_k"))
    smaller = F.least("distinct_a", "distinct_b")
    # of n values with a share theta = k / n kept, the shared ones are a binomial sample
    spare = F.greatest(F.greatest("distinct_a", "distinct_b") / F.col("_k") - 1, F.lit(0.0))
    return found.select("slice_a", "slice_b", "distinct_a", "distinct_b", "shared",
                        F.round(F.when(smaller > 0, F.col("shared") / smaller), 6).alias("share_of_smaller"),
                        F.round(2 * F.sqrt((F.col("shared") + 1) * spare), 1).alias("shared_error"))


# --- frequent items of shards ----------------------------------------------------

def head_sketches(rows: DataFrame, item: str, shard: str = "shard", groups: Sequence[str] = (), tracked: int = TRACKED) -> DataFrame:
    """One row per shard and group: ``sketch`` of the items and ``n``, the rows with one."""
    return (rows.where(F.col(item).isNotNull()).groupBy(shard, *groups)
            .agg(F.expr(f"approx_top_k_accumulate(`{item}`, {int(tracked)})").alias("sketch"), F.count(F.lit(1)).alias("n")))


def top_heads(rows: DataFrame, item: str, k: int, *, groups: Sequence[str] = (), shard: str = "shard",
              sketches: DataFrame | None = None, tracked: int = TRACKED) -> DataFrame:
    """The ``k`` most frequent items of each group, exactly: ``groups, item, n, rank``
    (ties by the smaller item). ``sketches`` of all shards of ``rows`` may be handed in."""
    groups = list(groups)
    if sketches is None:
        sketches = head_sketches(rows, item, shard, groups, tracked)
    # a constant key where there are no groups: Spark can't combine no sketches at all
    merged = sketches.groupBy(*(groups or [F.lit(0).alias("_all")])).agg(F.expr(f"approx_top_k_combine(sketch, {int(tracked)})").alias("sketch"),
                                           F.sum("n").alias("_rows"))
    named = merged.select(*groups, "_rows", F.explode(F.expr(f"approx_top_k_estimate(sketch, {int(tracked)})")).alias("_e"))
    named = cut_lineage(named.select(*groups, "_rows", F.col("_e.item").alias(item)))
    key = [*groups, item]
    # at most ``tracked`` items a group; null-safe on the groups through one struct
    fold = lambda df: df.withColumn("_key", F.struct(*key))
    counts = (fold(rows.where(F.col(item).isNotNull()).select(*key)).join(fold(named).select("_key", "_rows"), "_key")
              .groupBy("_key", "_rows").agg(F.count(F.lit(1)).alias("n")))
    counts = cut_lineage(counts.select("_key.*", "_rows", "n"))
    best = Window.partitionBy(*groups).orderBy(F.col("n").desc(), F.col(item).asc())
    ranked = counts.withColumn("rank", F.row_number().over(best).cast("bigint"))
    state = (ranked.groupBy(*groups, "_rows").agg(F.sum("n").alias("_counted"), F.min(F.when(F.col("rank") == k, F.col("n"))).alias("_last"))
             .withColumn("_whole", (F.col("_counted") == F.col("_rows"))
                         | F.coalesce(F.col("_last") > F.lit(MISSED / tracked) * F.col("_rows"), F.lit(False))))
    # groups whose sketches name nothing have no row in ``state``: they are open, too
    seen = merged.select(*groups, "_rows").join(state.select(F.struct(*groups, F.lit(0)).alias("_g"), "_whole"),
                                                F.struct(*groups, F.lit(0)) == F.col("_g"), "left")
    open_groups = [r for r in seen.where(~F.coalesce("_whole", F.lit(False))).select(*groups, "_rows").collect()]  # one row a group
    done = ranked.where(F.col("rank") <= k).select(*key, "n", "rank")
    if not open_groups:
        return done
    is_open = F.lit(True)
    if groups:
        is_open = F.lit(False)
        for r in open_groups:
            same = F.lit(True)
            for g in groups:
                same = same & F.col(g).eqNullSafe(F.lit(r[g]))
            is_open = is_open | same
    full = rows.where(F.col(item).isNotNull() & is_open).groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    full = full.withColumn("rank", F.row_number().over(best).cast("bigint")).where(F.col("rank") <= k)
    return done.where(~is_open).unionByName(full.select(*key, "n", "rank"))
