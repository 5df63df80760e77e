"""G1 with keyed state: the quota left of each edit type lives in the stream's
own state store, so no progress table is read back.

``transformWithState`` holds one number per edit type (rows taken so far) in
RocksDB, checkpointed with the stream. Of a micro-batch a type takes the first
rows by (shard, row_id) until its quota is met; rows of earlier batches come
first. So ties by arrival are defined, and if shards arrive in order the result
equals the batch quota, wherever the batches are cut. A restart goes on with
the state of the last committed batch, and the file sink keeps what a replayed
batch has already committed, so nothing counts twice.

A task holds at most the rows that are still open for a type: a batch's rows
are merged piece by piece and cut to the open quota at once. All rows of a type
in one micro-batch pass through one task; ``files_per_trigger`` bounds them.
"""

from __future__ import annotations

from collections.abc import Mapping

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from ..operators.shards import shard_semi_join

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ORDER = ["shard", "row_id"]


class QuotaLeft(StatefulProcessor):
    """Rows of one edit type until its quota is met."""

    def __init__(self, quota: Mapping[str, int]):
        self.quota = dict(quota)

    def init(self, handle) -> None:
        self.taken = handle.getValueState("taken", "n bigint")

    def handleInputRows(self, key, rows, timerValues):
        before = self.taken.get()[0] if self.taken.exists() else 0
        left = self.quota.get(key[0], 0) - before
        kept = None
        for part in rows:
            if left > 0:
                both = part if kept is None else pd.concat([kept, part], ignore_index=True)
                kept = both.sort_values(ORDER, kind="stable").head(left)
        if kept is not None and len(kept):
            self.taken.update((before + len(kept),))
            yield kept

    def close(self) -> None:
        pass


def _carried(schema: T.StructType) -> list[str]:
    """Columns that travel as text through the stateful step: pandas would turn
    whole numbers with nulls into doubles, and nulls of doubles into NaN."""
    plain = (T.StringType, T.BinaryType)
    for f in schema:
        if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            raise ValueError(f"column {f.name} is nested; flatten it or take it from the corpus by key")
    return [f.name for f in schema if f.name not in ORDER and not isinstance(f.dataType, plain)]


def stateful_ingest(spark: SparkSession, source_dir: str, target: str, checkpoint: str, quota: Mapping[str, int],
                    schema: T.StructType, files_per_trigger: int = 1, shards: DataFrame | None = None) -> DataFrame:
    """Ingest all files that are there and stop; returns the rows taken so far.

    ``schema`` is the corpus schema with ``edit_type``, ``decodable``, ``shard``
    and ``row_id`` (the last two are never null); ``shards`` a shard plan.
    """
    texts = _carried(schema)
    wanted = [t for t, q in quota.items() if q > 0]
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(source_dir)
    rows = stream.where(F.col("decodable") & F.col("edit_type").isin(*wanted))
    if shards is not None:
        rows = shard_semi_join(rows, shards)
    rows = rows.select(*[F.col(f.name).cast("string").alias(f.name) if f.name in texts else F.col(f.name) for f in schema])
    out_schema = T.StructType([T.StructField(f.name, T.StringType() if f.name in texts else f.dataType) for f in schema])
    taken = rows.groupBy("edit_type").transformWithStateInPandas(
        QuotaLeft(quota), outputStructType=out_schema, outputMode="Append", timeMode="None")
    taken = taken.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:  # a query keeps the settings that it starts with
        query = (taken.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint)
                 .outputMode("append").trigger(availableNow=True).start())
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)
    query.awaitTermination()
    return spark.read.schema(schema).parquet(target)
