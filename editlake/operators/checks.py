"""Validators: V1-V6. Each returns rows ``(check, shard, ok, expected, actual)``
(plus check-specific columns), so failures are data, not log lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import taxonomy as tx


def check_lengths(corpus: DataFrame, meta: DataFrame) -> DataFrame:
    """V1: per shard, prompts = types = images = the ``n`` of its meta record.

    One aggregate per shard counts every sidecar at once and meets the meta
    table (``shard, n``; one row per shard) in a full join, so a shard without
    a record, or a record without rows, fails too.
    """
    per = corpus.groupBy("shard").agg(
        F.count("instruction").alias("prompts"),
        F.count("edit_type_nullable").alias("types"),
        F.count_if(F.col("decodable")).alias("images"))
    both = per.join(meta.select("shard", F.col("n").alias("n")), "shard", "full")
    long = both.select("shard", F.coalesce("n", F.lit(0)).alias("n"), F.expr(
        "stack(3, 'prompts', coalesce(prompts, 0), 'types', coalesce(types, 0), 'images', coalesce(images, 0)) "
        "as (part, actual)"))
    return long.select(F.concat(F.lit("lengths:"), F.col("part")).alias("check"), "shard",
                       (F.col("actual") == F.col("n")).alias("ok"),
                       F.col("n").cast("bigint").alias("expected"),
                       F.col("actual").cast("bigint").alias("actual"))


def check_nonempty(quota: DataFrame, taken: DataFrame) -> DataFrame:
    """V3: a quota shortfall or zero rows is a failure even when the job ended
    cleanly. One row per quota type."""
    got = taken.groupBy("edit_type").agg(F.count(F.lit(1)).alias("actual"))
    j = quota.join(got, "edit_type", "left")
    actual = F.coalesce(F.col("actual"), F.lit(0)).cast("bigint")
    return j.select(F.concat(F.lit("nonempty:"), F.col("edit_type")).alias("check"),
                    F.lit(None).cast("bigint").alias("shard"),
                    ((actual >= F.col("quota")) & (actual > 0)).alias("ok"),
                    F.col("quota").cast("bigint").alias("expected"), actual.alias("actual"))


def check_uniform_res(res_by_shard: DataFrame) -> DataFrame:
    """V4: one resolution across all shards."""
    n = res_by_shard.agg(F.count_distinct("res").alias("actual"))
    return n.select(F.lit("uniform_res").alias("check"), F.lit(None).cast("bigint").alias("shard"),
                    (F.col("actual") == 1).alias("ok"), F.lit(1).cast("bigint").alias("expected"),
                    F.col("actual").cast("bigint").alias("actual"))


def check_disjoint(slices: DataFrame, key: str = "row_id", slice_col: str = "slice") -> DataFrame:
    """V5: row ids held by more than one slice, counted per shard."""
    shared = (slices.groupBy(key, "shard").agg(F.count_distinct(slice_col).alias("k"))
              .where(F.col("k") > 1))
    per = shared.groupBy("shard").agg(F.count(F.lit(1)).alias("actual"))
    return per.select(F.lit("disjoint").alias("check"), F.col("shard").cast("bigint"),
                      F.lit(False).alias("ok"), F.lit(0).cast("bigint").alias("expected"),
                      F.col("actual").cast("bigint"))


def check_taxonomy_append_only(stored: DataFrame, id_col: str = "type_id",
                               name_col: str = "type_name") -> DataFrame:
    """V6: every (id, name) pair found in stored data still holds in the
    current type dimension (ids are positions; names may only be appended)."""
    pairs = stored.select(id_col, name_col).where(F.col(id_col).isNotNull()).distinct()
    dim = tx.type_dimension(stored.sparkSession).select(
        F.col("type_id").alias(id_col), F.col("name").alias("current_name"))
    j = pairs.join(dim, id_col, "left")
    return j.select(F.lit("taxonomy_append_only").alias("check"), F.col(id_col).cast("bigint"),
                    F.col(name_col).alias("stored_name"), "current_name",
                    F.coalesce(F.col("current_name") == F.col(name_col), F.lit(False)).alias("ok"))


def check_sizes(spark, root: str, res: int, counts: DataFrame | None = None) -> DataFrame:
    """V2: every packed images file is ``n * 2 * 3 * res * res`` bytes.

    Uses the ``binaryFile`` source for the file length only (the content
    column is never selected, so no file is read). ``counts`` has (prefix, n),
    one row per file; without it, the file must hold whole records.
    """
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "*_images.bin")
             .option("recursiveFileLookup", "true").load(root).select("path", "length"))
    rec = 2 * 3 * res * res
    out = files.select(F.lit("sizes").alias("check"), "path",
                       F.col("length").cast("bigint").alias("actual"),
                       (F.col("length") % rec == 0).alias("whole_records"),
                       (F.col("length") / rec).cast("bigint").alias("records"))
    if counts is not None:
        exp = counts.select("prefix", (F.col("n") * rec).cast("bigint").alias("expected"))
        out = out.withColumn("prefix", F.regexp_extract("path", r"([^/]*)_images\.bin$", 1)).join(exp, "prefix", "left")
        return out.withColumn("ok", F.coalesce(F.col("expected") == F.col("actual"), F.lit(False)))
    return out.withColumn("ok", F.col("whole_records"))
