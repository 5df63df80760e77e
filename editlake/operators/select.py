"""Row selection: R2-R6, J6, U1-U3, and the classified view of a corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import taxonomy as tx
from ..functions import text as T
from ..functions.literal import literal_table
from ..session import cut_lineage
from .ordering import DEFAULT_BLOCK_ROWS, ordered_position
from .shards import shard_semi_join


def classified(corpus: DataFrame, strict_article: bool = False) -> DataFrame:
    """C5 + J2: add ``type_name`` and ``type_id`` (null when unnamed)."""
    name = T.classify_edit(F.col("edit_type"), F.col("instruction"), strict_article)
    dim = tx.type_dimension(corpus.sparkSession).select(
        F.col("name").alias("type_name"), "type_id")
    return corpus.withColumn("type_name", name).join(dim, "type_name", "left")


def wanted_types_only(corpus: DataFrame, quota: DataFrame) -> DataFrame:
    """``edit_type IN (<quota types>)`` as a literal predicate.

    A broadcast join alone is not pushed into the Parquet scan; this literal
    list is (the quota table is a handful of rows), so row-group min/max
    statistics on ``edit_type`` skip row groups of unwanted types, which on
    nearly homogeneous shards is most of them.
    """
    types = sorted({r["edit_type"] for r in quota.where(F.col("quota") > 0).select("edit_type").collect()})
    return corpus.where(F.col("edit_type").isin(*types))


def quota_rows(corpus: DataFrame, quota: DataFrame, shards: DataFrame | None = None,
               block_rows: int = DEFAULT_BLOCK_ROWS) -> DataFrame:
    """R2: the first ``quota[type]`` decodable rows per type in (shard, row) order.

    Unwanted types and undecodable rows are dropped before positions are
    taken, so positions count decodable rows only; only rows of the chosen
    shards are read when ``shards`` is given. Whole blocks that start beyond
    the quota are dropped before the row shuffle.
    """
    rows = wanted_types_only(corpus, quota).join(F.broadcast(quota.where(F.col("quota") > 0)),
                                                 "edit_type")
    if shards is not None:
        rows = shard_semi_join(rows, shards)
    rows = rows.where(F.col("decodable"))
    pos = ordered_position(rows, ["edit_type", "quota"], ["shard"], "row_id", name="type_pos",
                           block_rows=block_rows, keep_block=lambda o: o["_off"] < o["quota"])
    return pos.where(F.col("type_pos") <= F.col("quota"))


def slice_rows(corpus: DataFrame, k: int, n: int) -> DataFrame:
    """Rows ``[k*n, (k+1)*n)`` of the ordered corpus, then bad rows dropped.

    Slicing on the raw row id (not on good rows) keeps slices disjoint for
    any number of bad rows. The range is a plain predicate, so it reaches the
    Parquet scan as a pushed filter.
    """
    lo, hi = k * n, (k + 1) * n
    return corpus.where((F.col("row_id") >= lo) & (F.col("row_id") < hi) & F.col("decodable"))


def slice_of_shards(corpus: DataFrame, k: int, n: int, good: Column | None = None, rows: DataFrame | None = None) -> DataFrame:
    """R3 for a corpus keyed by (shard, row_id) with ids counted per file, as
    ``scan_corpus`` gives them: rows ``[k*n, (k+1)*n)`` in (shard, row) order,
    then rows that are not ``good`` (default: ``decodable``) dropped.

    Each shard's offset is a running sum over one count per shard; the slice is
    then a row-id range per shard, so no row is ranked or shuffled. Rows of a
    null shard are a shard of their own, the first. ``rows`` (shard, rows) spares
    the count of the corpus where its files tell it (``sources.corpus.shard_rows``).
    """
    lo, hi = k * n, (k + 1) * n
    before = Window.partitionBy().orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    key = F.struct("shard").alias("_key")  # null-safe in a plain join
    sizes = (corpus.groupBy("shard").agg(F.max("row_id").alias("_last")) if rows is None
             else rows.select("shard", (F.col("rows") - 1).alias("_last"))).withColumn("_key", key)
    ranges = (sizes.withColumn("_off", F.coalesce(F.sum(F.col("_last") + 1).over(before), F.lit(0)))
              .where((F.col("_off") < hi) & (F.col("_off") + F.col("_last") >= lo)).select("_key", "_off"))
    ranges = cut_lineage(ranges)  # at most n shards; kept, so the corpus is not counted again
    first, last, null = ranges.select(F.col("_key.shard").alias("s")).agg(
        F.min("s"), F.max("s"), F.coalesce(F.bool_or(F.col("s").isNull()), F.lit(False))).first()
    near = F.col("shard").between(first, last) if first is not None else F.lit(False)
    if null:
        near = near | F.col("shard").isNull()
    pos = F.col("row_id") + F.col("_off")
    good = F.col("decodable") if good is None else good
    # the bounds of the shards prune the files of a corpus whose shards are files
    return (corpus.where(near).withColumn("_key", key).join(ranges, "_key").where((pos >= lo) & (pos < hi) & good)
            .drop("_off", "_key"))


def slice_index(corpus: DataFrame, n: int) -> DataFrame:
    """R3 for all slices at once: ``k = row_id div n``, bad rows dropped."""
    return corpus.withColumn("k", F.expr(f"row_id div {int(n)}")).where(F.col("decodable"))


def val_count(n: Column, want_val: int) -> Column:
    """S7 rule: ``val_n = least(want_val, n div 10)``."""
    return F.least(F.lit(want_val).cast("bigint"), F.floor(n / 10).cast("bigint"))


def split_cutoffs(corpus: DataFrame, want_val: int,
                  block_rows: int = DEFAULT_BLOCK_ROWS) -> DataFrame:
    """Per shard: ``shard_rows`` and the row id of its first val row
    (``val_cut``, null when the shard has no val rows).

    Only counts per (shard, row block) and the one block per shard that
    holds the cut are ever ranked; no corpus row is shuffled.
    """
    blk = corpus.select("shard", "row_id").withColumn(
        "_blk", F.expr(f"row_id div {int(block_rows)}"))
    counts = blk.groupBy("shard", "_blk").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("shard").orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    c = (counts.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0)))
         .withColumn("shard_rows", F.sum("_n").over(Window.partitionBy("shard")).cast("bigint")))
    c = c.withColumn("_k", F.col("shard_rows") - val_count(F.col("shard_rows"), want_val))
    # The block holding position _k + 1 (1-based), i.e. the first val row.
    edge = c.where((F.col("_off") <= F.col("_k")) & (F.col("_k") < F.col("_off") + F.col("_n"))) \
        .select("shard", "_blk", "_off", "_k")
    ranked = blk.join(edge, ["shard", "_blk"]).withColumn(
        "_rn", F.row_number().over(Window.partitionBy("shard", "_blk").orderBy("row_id")))
    cut = ranked.where(F.col("_off") + F.col("_rn") == F.col("_k") + 1).select(
        "shard", F.col("row_id").alias("val_cut"))
    sizes = c.groupBy("shard").agg(F.max("shard_rows").alias("shard_rows"))
    return sizes.join(cut, "shard", "left")


def split_train_val(corpus: DataFrame, want_val: int) -> DataFrame:
    """Within each shard the first ``n - val_n`` rows (in row order) are
    train, the rest val, with ``val_n = least(want_val, n div 10)``.

    Each row only meets its shard's cut-off (a table of one row per shard,
    which AQE broadcasts when small), so labelling never shuffles the corpus.
    """
    cuts = split_cutoffs(corpus, want_val)
    out = corpus.join(cuts, "shard")
    return out.withColumn("split", F.when(F.col("val_cut").isNull() | (F.col("row_id") < F.col("val_cut")),
                                          F.lit("train")).otherwise(F.lit("val"))).drop("val_cut")


def drop_unnamed(df: DataFrame) -> DataFrame:
    """Rows whose classification is null are dropped."""
    return df.where(F.col("type_id").isNotNull())


def min_support(df: DataFrame, min_rows: int = tx.MIN_TYPE_SUPPORT,
                keys: tuple[str, ...] = ("split", "type_id")) -> DataFrame:
    """Keep types with at least ``min_rows`` rows, counted per split.

    The (split, type) count table has at most 2 x 64 rows (the taxonomy
    bounds it), so it is broadcast into a semi join.
    """
    keep = (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
            .where(F.col("_n") >= min_rows).drop("_n"))
    return df.join(F.broadcast(keep), list(keys), "left_semi")


KEY = ("shard", "row_id")


def overlap_anti(a: DataFrame, b: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """Rows of slice ``a`` whose key is not in slice ``b``."""
    return a.join(b.select(*key), list(key), "left_anti")


def slice_union(slices: dict[str, DataFrame]) -> DataFrame:
    """Logical concatenation of slices, each tagged with its name."""
    out = None
    for name, df in slices.items():
        tagged = df.withColumn("slice", F.lit(name))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def slice_overlap(a: DataFrame, b: DataFrame, col: str = "instruction",
                  key: tuple[str, ...] = KEY) -> DataFrame:
    """Distinct values shared by two slices, the share of the smaller
    slice they cover, and total vs unique rows across both."""
    # One pass: tag rows by side, aggregate per value (partial + final), then
    # fold the per-value flags into one row. Each row id carries one value, so
    # distinct ids per value add up to the distinct ids overall.
    tagged = (a.select(col, *key, F.lit(1).alias("_a"), F.lit(0).alias("_b"))
              .unionByName(b.select(col, *key, F.lit(0).alias("_a"), F.lit(1).alias("_b"))))
    per_val = tagged.groupBy(col).agg(
        F.max("_a").alias("ha"), F.max("_b").alias("hb"),
        F.sum("_a").alias("ra"), F.sum("_b").alias("rb"),
        F.count_distinct(F.struct(*key)).alias("uk"))
    one = per_val.agg(
        F.sum("ra").alias("rows_a"), F.sum("rb").alias("rows_b"),
        F.count_if(F.col("ha") == 1).alias("distinct_a"),
        F.count_if(F.col("hb") == 1).alias("distinct_b"),
        F.count_if((F.col("ha") == 1) & (F.col("hb") == 1)).alias("shared"),
        F.sum("uk").alias("unique_rows"))
    smaller = F.least("distinct_a", "distinct_b")
    return one.select(
        F.col("rows_a").cast("bigint"), F.col("rows_b").cast("bigint"),
        F.col("distinct_a").cast("bigint"), F.col("distinct_b").cast("bigint"),
        F.col("shared").cast("bigint"),
        F.round(F.when(smaller > 0, F.col("shared") / smaller), 6).alias("share_of_smaller"),
        (F.col("rows_a") + F.col("rows_b")).cast("bigint").alias("total_rows"),
        F.col("unique_rows").cast("bigint"))


def slices_overlap(slices: dict[str, DataFrame], col: str = "instruction") -> DataFrame:
    """U2 over k slices: per set of slices the distinct values found in exactly
    those slices. One row per value and slice reaches the shuffle; no pairs of
    slices or of rows are formed."""
    names = sorted(slices)
    held = None
    for name in names:
        one = slices[name].select(col, F.lit(name).alias("slice")).distinct()
        held = one if held is None else held.unionAll(one)
    per_value = held.groupBy(col).agg(F.array_join(F.array_sort(F.collect_set("slice")), ",").alias("slices"))
    return per_value.groupBy("slices").agg(F.count(F.lit(1)).alias("distinct_values"))


def slice_except(newer: DataFrame, older: DataFrame) -> DataFrame:
    """Rows of the newer slice not in the older one (multiset difference)."""
    return newer.exceptAll(older)


def quota_rows_decoded(corpus: DataFrame, quota: DataFrame, cell_col: str | tuple = "image_file",
                       keep: tuple[str, ...] = ("row_id", "shard", "edit_type"),
                       slack: float = 0.05, decoder=None, finish=None,
                       block_rows: int = DEFAULT_BLOCK_ROWS) -> DataFrame:
    """R2 when decodability is only known after decoding (two-phase quota).

    Keys are ranked per type in (shard, row) order without decoding. Round by
    round the next candidates of each type that is still short are decoded,
    ``quota + slack`` first and then as many again as are missing plus twice
    the slack; a round decodes new candidates only. It ends when every type has
    its quota or no candidate is left, so the result is exactly the first
    ``quota`` decodable rows per type.

    ``cell_col`` may name several cells (e.g. before and after); a row counts
    only when all of them decode. ``finish(decoded, keep)`` may shrink the
    decoded rows (e.g. resize) and must return ``keep`` columns and its own;
    what it returns is written once to the shared folder and met again by key
    for the rows that are taken. Only keys are ranked or shuffled by type.

    Returns keep columns, ``type_pos`` (position among decodable rows) and,
    without ``finish``, per cell ``<prefix>px``/``height``/``width``, with no
    prefix for a single cell and ``c0_``, ``c1_``, ... otherwise.
    """
    import uuid

    from ..session import cut_lineage, ensure_checkpoint_dir
    from .images import decode_images

    spark = corpus.sparkSession
    quota = quota.where(F.col("quota") > 0)
    cells = (cell_col,) if isinstance(cell_col, str) else tuple(cell_col)
    prefixes = [""] if len(cells) == 1 else [f"c{i}_" for i in range(len(cells))]
    keys = tuple(dict.fromkeys(tuple(keep) + ("row_id", "shard", "edit_type")))
    rows = wanted_types_only(corpus, quota).join(F.broadcast(quota), "edit_type")
    ranked = cut_lineage(ordered_position(rows.select("row_id", "shard", "edit_type", "quota"), ["edit_type", "quota"],
                                          ["shard"], "row_id", name="_cand", block_rows=block_rows))
    totals = {r["edit_type"]: int(r["n"]) for r in  # one entry per wanted type
              ranked.groupBy("edit_type").agg(F.max("_cand").alias("n")).collect()}
    want = {r["edit_type"]: int(r["quota"]) for r in quota.collect()}
    more = {t: max(1, int(q * slack)) for t, q in want.items()}
    done = dict.fromkeys(want, 0)
    limit = {t: min(totals.get(t, 0), q + more[t]) for t, q in want.items()}
    got = dict.fromkeys(want, 0)
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/decoded-{uuid.uuid4().hex}"
    payload = rows.select(*keys, *cells)
    key = F.struct("shard", "row_id", "edit_type")  # equal where its fields are, nulls too
    while True:
        window = literal_table(spark, [(t, done[t], limit[t]) for t in want], "edit_type string, _from bigint, _to bigint")
        due = (ranked.join(F.broadcast(window), "edit_type")
               .where((F.col("_cand") > F.col("_from")) & (F.col("_cand") <= F.col("_to")))
               .select("shard", "row_id", "edit_type"))
        dec = payload.withColumn("_key", key).join(due.select(key.alias("_key")), "_key", "left_semi").drop("_key")
        for i, (cell, pre) in enumerate(zip(cells, prefixes)):
            made = tuple(f"{p}{k}" for p in prefixes[:i] for k in ("height", "width", "px"))
            dec = decode_images(dec, cell, keep=keys + made + cells[i + 1:], decoder=decoder, prefix=pre)
            dec = dec.where(F.col(f"{pre}ok")).drop(f"{pre}ok")
        (finish(dec, keys) if finish else dec).write.mode("append").parquet(folder)
        stored = spark.read.parquet(folder)
        got |= {r["edit_type"]: int(r["n"]) for r in
                stored.groupBy("edit_type").agg(F.count(F.lit(1)).alias("n")).collect()}
        done = dict(limit)
        short = [t for t in want if got[t] < want[t] and limit[t] < totals.get(t, 0)]
        if not short:
            break
        for t in short:
            more[t] *= 2
            limit[t] = min(totals[t], limit[t] + want[t] - got[t] + more[t])
    good = stored.select("shard", "row_id", "edit_type").join(F.broadcast(quota), "edit_type")
    taken = ordered_position(good, ["edit_type", "quota"], ["shard"], "row_id", name="type_pos", block_rows=block_rows,
                             keep_block=lambda o: o["_off"] < o["quota"]).where(F.col("type_pos") <= F.col("quota"))
    out = stored.withColumn("_key", key).join(taken.select(key.alias("_key"), "type_pos"), "_key")
    own = [c for c in stored.columns if c not in keys]
    return out.select(*keep, "type_pos", *own)
