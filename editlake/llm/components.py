"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over edges ``a > b``.

    Large: every vertex links its larger neighbours to its smallest neighbour
    (itself included). Small: the same for its smaller neighbours and itself.
    The minimum is a partial aggregate, and the neighbours meet it in a join
    whose large keys AQE splits; no neighbour list is gathered.
    """
    if large:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(
            edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        out = both.where(F.col("v") > F.col("u")).join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        low = edges.groupBy("a").agg(F.min("b").alias("m"))
        met = edges.join(low, "a")
        out = met.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
    return out.where(F.col("a") > F.col("b")).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every vertex of edges ``a, b`` (bigint): root is the
    smallest vertex of its component. Runs until nothing changes; each round
    ends in a reliable checkpoint."""
    low, high = F.least("a", "b"), F.greatest("a", "b")
    now = cut_lineage(edges.select(high.alias("a"), low.alias("b")).where(F.col("a") > F.col("b")).distinct())
    state = _state(now)
    while True:
        now = cut_lineage(_star(_star(now, True), False))
        new = _state(now)
        if new == state:
            break
        state = new
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
