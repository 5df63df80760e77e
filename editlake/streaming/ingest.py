"""G1: incremental ingest of arriving shards with per-type quotas.

Shards arrive as Parquet files. Each micro-batch keeps decodable rows of the
wanted types and writes them into its own ``batch_id`` partition, so a replayed
batch replaces its output and never counts twice.

With a shard plan (``shards``), a batch keeps all decodable rows of planned
shards, and the quota is cut on reading: the result equals the batch job
``quota_rows`` over the planned shards whatever the order of arrival. Without a
plan every batch is cut at once to the quota still open (rows taken by earlier
batches, from the small progress table), which depends on the order of arrival.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.literal import literal_table
from ..operators.ordering import ordered_position
from ..operators.select import quota_rows
from ..operators.shards import quota_table, shard_semi_join
from ..session import cut_lineage


def progress_path(target: str) -> str:
    return target.rstrip("/") + "_progress"


def _taken_before(spark: SparkSession, target: str, batch_id: int) -> dict[str, int]:
    """Rows per type taken by earlier batches, from the small progress table
    (one row per batch and type), never by scanning the target."""
    from ..sources.corpus import path_exists
    if not path_exists(spark, progress_path(target)):
        return {}  # first batch: nothing taken yet; an unreadable table is an error
    p = spark.read.schema("edit_type string, n bigint, batch_id bigint").parquet(progress_path(target))
    rows = (p.where(F.col("batch_id") < batch_id).groupBy("edit_type")
            .agg(F.sum("n").alias("n")).collect())
    return {r["edit_type"]: int(r["n"]) for r in rows}


def make_batch_writer(target: str, quota: Mapping[str, int]):
    """The ``foreachBatch`` function: quota-cut append, idempotent per batch.

    Data and progress are written into the ``batch_id`` partition with dynamic
    partition overwrite, so a replayed batch replaces its own output instead
    of adding to it; the open quota comes from earlier batches only.
    """

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        counts = _taken_before(spark, target, batch_id)
        left = {t: q - counts.get(t, 0) for t, q in quota.items() if q - counts.get(t, 0) > 0}
        if not left:
            return
        remaining = literal_table(spark, list(left.items()), "edit_type string, remaining bigint")
        rows = batch.where(F.col("decodable")).join(F.broadcast(remaining), "edit_type")
        ranked = ordered_position(rows, ["edit_type", "remaining"], ["shard"], "row_id", name="_k",
                                  keep_block=lambda o: o["_off"] < o["remaining"])
        take = (ranked.where(F.col("_k") <= F.col("remaining")).select(*batch.columns)
                .withColumn("batch_id", F.lit(batch_id).cast("bigint")))
        take.write.mode("overwrite").option("partitionOverwriteMode", "dynamic") \
            .partitionBy("batch_id").parquet(target)
        written = spark.read.schema(take.schema).parquet(target).where(F.col("batch_id") == batch_id)
        (written.groupBy("batch_id", "edit_type").agg(F.count(F.lit(1)).cast("bigint").alias("n"))
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("batch_id").parquet(progress_path(target)))

    return write_batch


def make_candidate_writer(target: str, quota: Mapping[str, int], shards: DataFrame):
    """The ``foreachBatch`` function of a planned ingest: decodable rows of the
    wanted types in planned shards, into the batch's own partition."""
    wanted = [t for t, q in quota.items() if q > 0]

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        rows = batch.where(F.col("decodable") & F.col("edit_type").isin(*wanted))
        (shard_semi_join(rows, shards).withColumn("batch_id", F.lit(batch_id).cast("bigint"))
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(target))

    return write_batch


def stream_ingest(spark: SparkSession, source_dir: str, target: str, checkpoint: str,
                  quota: Mapping[str, int], schema, files_per_trigger: int = 1, shards: DataFrame | None = None):
    """Run the ingest over everything available now and stop.

    ``schema`` is the corpus schema (streaming reads need it up front). Returns
    the rows taken so far; with ``shards`` (the plan's shard list) cut to the
    quota in (shard, row) order.
    """
    if shards is not None:
        shards = cut_lineage(shards)  # planned once, not in every batch
    writer = make_batch_writer(target, quota) if shards is None else make_candidate_writer(target, quota, shards)
    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
              .parquet(source_dir))
    q = (stream.writeStream.foreachBatch(writer)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    from ..sources.corpus import path_exists
    fields = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in schema)}, batch_id bigint"
    table = spark.read.schema(fields)
    taken = table.parquet(target) if path_exists(spark, target) else spark.createDataFrame([], fields)
    return taken if shards is None else quota_rows(taken, quota_table(spark, quota)).drop("type_pos", "quota")
