"""Plan checks: pruning, pushdown, broadcast of bounded tables, bounded windows."""
import os

from pyspark.sql import functions as F

from editlake import fixtures as fx
from editlake.operators import select as S
from editlake.operators import shards as SH
from editlake.sources import corpus as SC

SF = "/root/testdata/sf0.01"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def formatted(df):
    import contextlib
    import io
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def test_scan_corpus_prunes_columns(spark, scratch):
    path = os.path.join(scratch, "corpus")
    df = spark.range(10).select(
        F.col("id").alias("row_id"), F.lit("add").alias("edit_type"), F.lit("add a hat").alias("edit_instruction"),
        F.struct(F.lit(b"x").alias("bytes"), F.lit(None).cast("string").alias("path")).alias("image_file"),
        F.struct(F.lit(b"y").alias("bytes"), F.lit(None).cast("string").alias("path")).alias("edited_file"),
        F.lit("caption in").alias("input"), F.lit("caption out").alias("output"))
    df.coalesce(1).write.parquet(os.path.join(path, "train-00007-of-00383.parquet"))
    s = SC.scan_corpus(spark, os.path.join(path, "*.parquet"))
    p = plan(s)
    assert "input" not in p.split("ReadSchema")[1].split("\n")[0]
    rows = s.collect()
    assert {r.shard for r in rows} == {7}
    assert sorted(r.row_id for r in rows) == list(range(10))


def test_slice_filter_pushed_to_scan(spark):
    # A corpus read straight from Parquet (the large-input case): the slice
    # range must reach the scan as pushed filters.
    corpus = fx.table(spark, SF, "orders").selectExpr(
        "o_orderkey as row_id", "o_custkey as shard", "(o_orderkey % 97) <> 0 as decodable")
    s = S.slice_rows(corpus, 2, 1000)
    txt = formatted(s)
    assert "GreaterThanOrEqual(o_orderkey,2000)" in txt and "LessThan(o_orderkey,3000)" in txt


def test_quota_types_reach_parquet_scan(spark, scratch):
    path = os.path.join(scratch, "typed")
    fx.pairs(spark, SF).select("row_id", "shard", "edit_type", "decodable").write.parquet(path)
    corpus = spark.read.parquet(path)
    r = S.quota_rows(corpus, SH.quota_table(spark, {"add": 50, "replace": 5}))
    txt = formatted(r)
    assert "In(edit_type, [add,replace])" in txt


def test_quota_semi_join_broadcasts_shard_list(spark):
    p = fx.pairs(spark, SF)
    picked = SH.pick_shards(SH.shard_type_counts(p), SH.quota_table(spark, {"add": 500}))
    r = S.quota_rows(p, SH.quota_table(spark, {"add": 500}), SH.taken_shards(picked))
    r.collect()
    txt = plan(r)
    assert "BroadcastHashJoin" in txt and "LeftSemi" in txt


def test_top_k_is_take_ordered(spark):
    from editlake.operators import profile as P
    txt = plan(P.object_histogram(fx.pairs(spark, SF)))
    assert "TakeOrderedAndProject" in txt


def test_head_hist_uses_window_group_limit(spark):
    from editlake.operators import profile as P
    df = P.head_hist_per_type(fx.pairs(spark, SF))
    df.collect()
    assert "WindowGroupLimit" in plan(df)


def test_shard_semi_join_prunes_partitions(spark, scratch):
    path = os.path.join(scratch, "by_shard")
    fx.pairs(spark, SF).select("row_id", "shard", "edit_type", "decodable").write.partitionBy("shard").parquet(path)
    corpus = spark.read.parquet(path)
    picked = SH.pick_shards(SH.shard_type_counts(corpus), SH.quota_table(spark, {"add": 300}))
    rows = SH.shard_semi_join(corpus, SH.taken_shards(picked))
    rows.collect()
    txt = formatted(rows)
    assert "dynamicpruning" in txt.lower()


def test_files_without_a_shard_number_keep_their_rows(spark, scratch):
    path = os.path.join(scratch, "parts")
    cell = "struct<bytes: binary, path: string>"
    rows = [("add", f"p{i}", (b"x", None), (b"y", None)) for i in range(30)]
    spark.createDataFrame(rows, f"edit_type string, edit_instruction string, image_file {cell}, edited_file {cell}") \
        .repartition(3).write.parquet(path)  # Spark's own file names
    c = SC.scan_corpus(spark, path)
    assert c.where("shard is null or shard >= 0").count() == 0 and c.select("shard", "row_id").distinct().count() == 30
    got = [[r.edit_instruction for r in S.slice_of_shards(c, k, 12, F.lit(True)).collect()] for k in range(3)]
    assert [len(g) for g in got] == [12, 12, 6] and sorted(sum(got, [])) == sorted(r[1] for r in rows)
    typed = spark.createDataFrame([(None, i) for i in range(5)] + [(0, i) for i in range(5)], "shard bigint, row_id bigint")
    got = [sorted(map(repr, map(tuple, S.slice_of_shards(typed, k, 6, F.lit(True)).collect()))) for k in range(2)]
    assert got == [sorted(["(0, 0)"] + [f"(None, {i})" for i in range(5)]), [f"(0, {i})" for i in range(1, 5)]]
