"""J1 repeated: images, prompts, types and vectors bucketed by position.

A join by (shard, position) that runs again and again (every epoch, every new
set of vectors) should not shuffle again and again. ``write_bucketed`` deals a
table once into buckets of (shard, position), one sorted file a bucket; tables
with equal bucket counts then join bucket by bucket, without an exchange. One
side can be written anew (re-embedding) and the others stay as they are.

A shard is spread over all buckets, so a large shard is no hot key.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

KEY = ("shard", "pos")


def write_bucketed(df: DataFrame, folder: str, buckets: int, key: Sequence[str] = KEY) -> None:
    """Write ``df`` bucketed and sorted by ``key`` (its columns must not be null)."""
    name = f"bucketed_{uuid.uuid4().hex}"
    (df.repartition(buckets, *key).write.mode("overwrite").option("path", folder)
     .bucketBy(buckets, *key).sortBy(*key).saveAsTable(name))
    df.sparkSession.sql(f"DROP TABLE {name}")  # the folder stays; readers name buckets and key again


def read_bucketed(spark: SparkSession, folder: str, buckets: int, key: Sequence[str] = KEY, schema: StructType | None = None) -> DataFrame:
    """A written table with its buckets known to the planner. Without its ``schema`` it must have rows."""
    name = f"bucketed_{uuid.uuid4().hex}"
    schema = schema or spark.read.parquet(folder).schema
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    keys = ", ".join(f"`{k}`" for k in key)
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {int(buckets)} BUCKETS "
              f"LOCATION '{folder}'")
    out = spark.table(name)
    out.schema  # resolved while the name exists
    spark.sql(f"DROP TABLE {name}")
    return out


def join_by_position(images: DataFrame, prompts: DataFrame, types: DataFrame | None = None, vectors: DataFrame | None = None,
                     key: Sequence[str] = KEY) -> DataFrame:
    """Images with their prompts; types (missing: '') and vectors (missing: null) where given."""
    out = images.join(prompts, list(key))
    if types is not None:
        out = out.join(types, list(key), "left").withColumn("edit_type", F.coalesce("edit_type", F.lit("")))
    return out if vectors is None else out.join(vectors, list(key), "left")
