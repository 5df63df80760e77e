"""Shard metadata and shard planning: S2, S3, R1, R7, J5, A13.

The shard map is metadata (one row per shard and edit type), so the windows
here run over a table the size of the file listing, never over corpus rows.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.literal import literal_table

SHARD_ENTRY_SCHEMA = "struct<rows: bigint, types: map<string, bigint>>"
SHARD_MAP_SCHEMA = "map<string, struct<rows: bigint, types: map<string, bigint>>>"


def quota_table(spark: SparkSession, quota: Mapping[str, int]) -> DataFrame:
    """``{type: rows}`` (the ``TYPE=COUNT`` words) as a tiny broadcast table."""
    rows = [(t, int(n)) for t, n in quota.items()]
    return literal_table(spark, rows, "edit_type string, quota bigint")


def parse_quota_words(words) -> dict[str, int]:
    """``["add=60000", "tune_transfer=60000"]`` -> ``{"add": 60000, ...}``."""
    out = {}
    for kv in words:
        t, n = kv.split("=")
        out[t] = int(n)
    return out


def shard_type_counts(corpus: DataFrame) -> DataFrame:
    """(shard, edit_type, n): rows per shard and type (partial + final aggregate)."""
    return corpus.groupBy("shard", "edit_type").agg(F.count(F.lit(1)).cast("bigint").alias("n"))


def build_shard_map(corpus: DataFrame) -> DataFrame:
    """S3: one JSON document per shard, ``{"rows": n, "types": {type: n}}``.

    The map of a shard holds at most one entry per edit type, so the
    ``collect_list`` is bounded by the taxonomy, not by the data.
    """
    counts = shard_type_counts(corpus)
    per_shard = counts.groupBy("shard").agg(
        F.sum("n").cast("bigint").alias("rows"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("edit_type", "n")))).alias("types"))
    return per_shard.select(
        "shard", "rows", F.size("types").cast("bigint").alias("n_types"),
        F.to_json(F.struct("rows", "types")).alias("entry_json"))


def read_shard_map(shard_json: DataFrame, key_col: str = "shard",
                   json_col: str = "entry_json") -> DataFrame:
    """Per-shard JSON entries -> long form (shard, edit_type, n).

    Shard keys become integers so that shard order is numeric, not textual.
    """
    e = shard_json.select(F.col(key_col).cast("bigint").alias("shard"),
                          F.from_json(F.col(json_col), SHARD_ENTRY_SCHEMA).alias("e"))
    return e.select("shard", F.explode(F.coalesce(F.col("e.types"),
                                                   F.create_map().cast("map<string,bigint>")))
                    .alias("edit_type", "n"))


def read_shard_map_document(doc: DataFrame, json_col: str = "value") -> DataFrame:
    """S2 for the single-document form ``{"<shard>": {"rows":..,"types":{..}}}``
    (one JSON object for the whole corpus, e.g. read with ``wholetext``)."""
    m = doc.select(F.explode(F.from_json(F.col(json_col), SHARD_MAP_SCHEMA)).alias("key", "entry"))
    return read_shard_map(m.select(F.col("key").alias("shard"),
                                   F.to_json("entry").alias("entry_json")))


def pick_shards(shard_map: DataFrame, quota: DataFrame, skip_shards: int = 0) -> DataFrame:
    """Shards covering a per-type quota, after skipping ``skip_shards``
    useful shards.

    Walk semantics: in numeric shard order, a shard is useful when it holds a
    wanted type whose rows taken so far are below its quota; the first
    ``skip_shards`` useful shards are passed over without counting rows; every
    later useful shard is taken with all its useful types.

    Closed form: before any shard is taken every wanted type is below quota,
    so the skipped shards are simply the first ``skip_shards`` shards holding a
    wanted type. After that, a type is useful in a shard exactly when the
    rows of that type in earlier post-skip shards sum to less than its quota
    (a shard that is not taken only holds types already at quota, so adding
    it to the running sum changes no decision).

    Returns (shard, edit_type, n, taken_before, quota) for every useful
    (shard, type); the shards are the distinct ``shard`` values and the
    projected rows per type are ``sum(n)``.
    """
    spark = shard_map.sparkSession
    wanted = (shard_map.join(F.broadcast(quota.where(F.col("quota") > 0)), "edit_type")
              .select("shard", "edit_type", "n", "quota"))
    if skip_shards > 0:
        # The cut is one number: the last of the first `skip_shards` wanted shards.
        first = (wanted.select("shard").distinct().orderBy("shard").limit(int(skip_shards))
                 .agg(F.max("shard").alias("cut"), F.count(F.lit(1)).alias("k")).first())
        if first is None or first["k"] < skip_shards:
            return spark.createDataFrame(
                [], "shard bigint, edit_type string, n bigint, taken_before bigint, quota bigint")
        wanted = wanted.where(F.col("shard") > F.lit(first["cut"]))
    w = (Window.partitionBy("edit_type").orderBy("shard")
         .rowsBetween(Window.unboundedPreceding, -1))
    ranked = wanted.withColumn("taken_before",
                               F.coalesce(F.sum("n").over(w), F.lit(0)).cast("bigint"))
    return (ranked.where(F.col("taken_before") < F.col("quota"))
            .select("shard", "edit_type", "n", "taken_before", "quota"))


def projected_rows(picked: DataFrame) -> DataFrame:
    """Projected rows per type of a pick (the walk's ``got``)."""
    return picked.groupBy("edit_type").agg(F.sum("n").cast("bigint").alias("projected"),
                                           F.count(F.lit(1)).cast("bigint").alias("n_shards"))


def taken_shards(picked: DataFrame) -> DataFrame:
    return picked.select("shard").distinct()


def shard_semi_join(corpus: DataFrame, shards: DataFrame) -> DataFrame:
    """Only rows of the chosen shards.

    The shard list has one row per file; AQE broadcasts it when it has measured
    it small. On a corpus partitioned by ``shard`` it also becomes a dynamic
    partition-pruning filter, and unchosen files are never opened.
    """
    return corpus.join(shards.select("shard").distinct(), "shard", "left_semi")


def remaining_stock(shard_map: DataFrame, quota: DataFrame, consumed: DataFrame) -> DataFrame:
    """Wanted (shard, type) entries not already consumed by earlier slices."""
    wanted = shard_map.join(F.broadcast(quota), "edit_type").select("shard", "edit_type", "n")
    return wanted.join(consumed.select("shard").distinct(), "shard", "left_anti")


def require_nonempty(df: DataFrame, what: str) -> DataFrame:
    """An empty plan is an error, not a finished job."""
    if df.limit(1).count() == 0:
        raise ValueError(f"{what}: nothing left to take")
    return df


def counts_progress(taken_rows: DataFrame) -> DataFrame:
    """Running per-type totals of taken rows after each shard."""
    per = taken_rows.groupBy("shard", "edit_type").agg(F.count(F.lit(1)).cast("bigint").alias("n"))
    w = Window.partitionBy("edit_type").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    return per.withColumn("running", F.sum("n").over(w).cast("bigint"))
