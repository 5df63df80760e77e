"""Small literal tables built JVM-side.

``spark.createDataFrame(python_list)`` plans a Python RDD scan (a Python
worker and an extra job to broadcast it). Fixed tables of a few dozen rows
(the type dimension, rule and quota tables) are written as an inline
``VALUES`` relation instead: a LocalRelation that Catalyst can fold,
broadcast for free and never leave the JVM for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _sql_value(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, int):
        return f"CAST({v} AS BIGINT)"
    if isinstance(v, float):
        return f"CAST({repr(v)} AS DOUBLE)"
    return "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"


def literal_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """``rows`` as a broadcastable inline table with the given DDL schema."""
    fields = [f.strip().split()[0] for f in schema.split(",")]
    types = [" ".join(f.strip().split()[1:]) for f in schema.split(",")]
    if not rows:
        return spark.createDataFrame([], schema)
    body = ", ".join("(" + ", ".join(_sql_value(v) for v in r) + ")" for r in rows)
    df = spark.sql(f"SELECT * FROM VALUES {body} AS t({', '.join(fields)})")
    return F.broadcast(df.select(*[F.col(n).cast(t).alias(n) for n, t in zip(fields, types)]))
