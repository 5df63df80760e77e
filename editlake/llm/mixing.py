"""Mixing sources to target weights (DataFrame functions only).

1. Every row gets a hash-random key (60 bits of md5 of seed and id). The top
   bits of the key cut each source's key space into equal ranges; as keys are
   uniform the ranges hold equal shares, however large the source, so no
   sampling pass is needed and no source is ever sorted in one task.
2. Word counts are summed per (source, range) with a partial aggregate; a
   running sum over those small tables is the distributed prefix sum.
3. Targets: sources in code-point order (null last) share all words by weight;
   a target stops at ``cap`` times its source and the excess is shared again
   by weight. That is a water level, found with one running sum over the
   sources ordered by the level at which each is full.
4. Whole epochs are ``target div size``. What is left is cut in key order: only
   the one range of each source that holds the budget's end is sorted to find
   the cut row. A row belongs to the last, partial epoch when its midpoint in
   the prefix sum lies within the budget, so the words taken miss the target
   by at most half of one document. Rows that share the cut key (equal in id,
   source and text) are counted first, and only as many of them are taken as
   fit; where they do not all fit they are numbered in blocks of bounded size.

All that a row needs (level of its source, cut point) is one line per source.
The sources are counted: up to ``FEW_SOURCES`` lines are broadcast, so rows (and
their texts) stay where they are; more meet the rows in a shuffled join in which
every source is spread over ``SALTS`` keys.

Defined results: null text has size 0; a null source is a source of its own,
last in order; a null id is allowed. Rows equal in id, source and text share a
key and are interchangeable. A source of size 0 has target 0. Size 0 rows are
repeated like others but take 0 words. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordering import ordered_position
from ..session import cut_lineage

WORDS_PATTERN = r"[^\x20\x09-\x0D]+"
RANGE_BITS = 12
KEY_BITS = 60
WEIGHTS = (5, 2, 1)
FEW_SOURCES, SALTS = 20_000, 64


def _narrow(ident: Column, text: Column, source: Column, seed: str) -> list[Column]:
    """id, source, size, key with tie-breaks, and key range of a row."""
    key = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(ident.cast("string"), F.lit("null")))),
                             1, KEY_BITS // 4), 16, 10).cast("bigint")
    return [ident.alias("_id"), F.struct(source.alias("s")).alias("_src"),
            F.coalesce(F.regexp_count(text, F.lit(WORDS_PATTERN)), F.lit(0)).cast("bigint").alias("_size"),
            F.struct(key.alias("k"), ident.alias("i"), F.md5(text).alias("t")).alias("_ord"),
            F.shiftright(key, KEY_BITS - RANGE_BITS).cast("int").alias("_rng")]


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = 3) -> DataFrame:
    """``sizes`` (``_src`` struct, ``source_size``) plus ``target``: one row per
    source, so the single-partition windows here hold sources, never rows."""
    w = F.element_at(F.array(*[F.lit(int(x)) for x in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    everything = Window.partitionBy()
    by_name = Window.partitionBy().orderBy(F.col("_src.s").asc_nulls_last())
    full_at = F.col("_cap").cast("double") / F.col("_w")
    before = (Window.partitionBy().orderBy(full_at, F.col("_rank"))
              .rowsBetween(Window.unboundedPreceding, -1))
    t = (sizes.withColumn("_rank", F.row_number().over(by_name) - 1)
         .withColumn("_w", w.cast("bigint"))
         .withColumn("_cap", F.col("source_size") * cap)
         .withColumn("_num", F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0)))
         .withColumn("_den", F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0))))
    open_ = full_at > F.col("_num").cast("double") / F.col("_den")
    # the first source that the level leaves open fixes the level
    level = F.min(F.when(open_, F.struct(full_at.alias("f"), F.col("_rank").alias("r"),
                                         F.col("_num").alias("n"), F.col("_den").alias("d")))).over(everything)
    share = F.col("_w") * F.col("_lvl.n").cast("double") / F.col("_lvl.d")
    return (t.withColumn("_lvl", level)
            .select("_src", "source_size",
                    F.coalesce(F.least(F.col("_cap").cast("double"), share),
                               F.col("_cap").cast("double")).alias("target")))


def _plan(rows: DataFrame, weights: Sequence[int], cap: int) -> DataFrame:
    """One row per source: size, target, whole epochs, range and cut point of the partial epoch."""
    ranges = rows.groupBy("_src", "_rng").agg(F.sum("_size").alias("_n"))
    sizes = ranges.groupBy("_src").agg(F.sum("_n").alias("source_size"))
    plan = source_targets(sizes, weights, cap)
    budget = F.floor("target").cast("bigint")
    some = F.col("source_size") > 0
    plan = (plan.withColumn("_epochs", F.when(some, F.expr("cast(floor(target) as bigint) div source_size")).otherwise(0))
            .withColumn("_rest", F.when(some, budget % F.col("source_size")).otherwise(0)))
    before = (Window.partitionBy("_src").orderBy("_rng").rowsBetween(Window.unboundedPreceding, -1))
    cut_range = (ranges.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0)))
                 .join(plan.select("_src", "_rest"), "_src").where(F.col("_off") <= F.col("_rest"))
                 .groupBy("_src", "_rest").agg(F.max(F.struct("_rng", "_off")).alias("_c"))
                 .select("_src", "_rest", F.col("_c._rng").alias("_rng"), F.col("_c._off").alias("_off")))
    in_range = (Window.partitionBy("_src", "_rng").orderBy("_ord").rowsBetween(Window.unboundedPreceding, -1))
    keys = (rows.select("_src", "_rng", "_ord", "_size").join(cut_range, ["_src", "_rng"])
            .groupBy("_src", "_rng", "_rest", "_off", "_ord", "_size").agg(F.count(F.lit(1)).alias("_same"))
            .withColumn("_before", F.col("_off") + F.coalesce(F.sum(F.col("_same") * F.col("_size")).over(in_range), F.lit(0))))
    # copy j of a key ends at _before + j * _size and is in when its midpoint lies within _rest
    left = 2 * (F.col("_rest") - F.col("_before"))
    fit = (F.when(left < F.col("_size"), 0)
           .when(F.col("_size") == 0, F.col("_same"))
           .otherwise(F.least("_same", F.expr("(2 * (_rest - _before) + _size) div greatest(2 * _size, 1)"))))
    cut = (keys.withColumn("_fit", fit).where(F.col("_fit") > 0)
           .groupBy("_src").agg(F.max(F.struct("_ord", "_fit", "_same")).alias("_c"))
           .select("_src", F.col("_c._ord").alias("_cut"), F.col("_c._fit").alias("_fit"),
                   (F.col("_c._fit") < F.col("_c._same")).alias("_split")))
    return (plan.join(cut_range.select("_src", F.col("_rng").alias("_cut_rng")), "_src", "left")
            .join(cut, "_src", "left")
            .select("_src", "source_size", "target", "_epochs", "_cut_rng", "_cut", "_fit", "_split"))


def _beside(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Every row with the line of its source."""
    if plan.count() <= FEW_SOURCES:
        return rows.join(F.broadcast(plan), "_src")
    salted = plan.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64("_ord"), F.lit(SALTS)).cast("int")).join(salted, ["_src", "_salt"]).drop("_salt")


def _with_copies(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``rows`` (with ``_src``, ``_rng``, ``_ord``) joined with ``plan``, plus ``copies``."""
    whole = ((F.col("_rng") < F.col("_cut_rng"))
             | ((F.col("_rng") == F.col("_cut_rng")) & (F.col("_ord") <= F.col("_cut"))))
    copies = lambda partial: (F.col("_epochs") + F.coalesce(partial, F.lit(False)).cast("bigint")).cast("bigint")
    joined = _beside(rows, plan)
    if plan.where("_split").isEmpty():
        return joined.withColumn("copies", copies(whole))
    split = F.coalesce(F.col("_split") & (F.col("_ord") == F.col("_cut")), F.lit(False))
    # rows of a cut key are told apart by their place, which is fixed before they are numbered
    some = cut_lineage(joined.where(split).withColumn("_part", F.spark_partition_id())
                       .withColumn("_at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)))
    nth = ordered_position(some, ["_src"], ["_part"], "_at", name="_nth")
    return (joined.where(~split).withColumn("copies", copies(whole))
            .unionByName(nth.withColumn("copies", copies(F.col("_nth") <= F.col("_fit"))).drop("_part", "_at", "_nth")))


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: Sequence[int] = WEIGHTS, cap: int = 3, seed: str = "mix") -> DataFrame:
    """Per row: ``id_col``, ``size``, ``source_size``, ``target``, ``taken`` and ``copies``."""
    cols = [F.col(f"`{c}`") for c in (id_col, text_col, source_col)]
    rows = cut_lineage(docs.select(*_narrow(*cols, seed)))  # narrow; texts are read and counted once
    out = _with_copies(rows, cut_lineage(_plan(rows, weights, cap)))
    return out.select(F.col("_id").alias(id_col), F.col("_size").alias("size"), "source_size", "target",
                      (F.col("copies") * F.col("_size")).alias("taken"), "copies")


def mixed_rows(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
               weights: Sequence[int] = WEIGHTS, cap: int = 3, seed: str = "mix") -> DataFrame:
    """The mix itself: rows of ``docs``, each as often as it is taken.

    Texts are not shuffled (up to ``FEW_SOURCES`` sources): the plan (one line
    per source) comes from narrow rows and is broadcast to the whole rows.
    """
    cols = [F.col(f"`{c}`") for c in (id_col, text_col, source_col)]
    plan = cut_lineage(_plan(cut_lineage(docs.select(*_narrow(*cols, seed))), weights, cap))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    out = _with_copies(docs.select(row, *_narrow(*cols, seed)), plan).where(F.col("copies") > 0)
    return out.select("row", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies")))).select("row.*")
