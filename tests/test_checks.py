"""Validators must fail on damaged or overlapping inputs (FIXTURES 2.3)."""
from pyspark.sql import functions as F

from editlake import fixtures as fx
from editlake.operators import checks as CK
from editlake.operators import select as S
from editlake.operators import shards as SH

SF = "/root/testdata/sf0.01"


def _slice(spark, quota, skip=0):
    p = fx.pairs(spark, SF)
    picked = SH.pick_shards(SH.shard_type_counts(p), SH.quota_table(spark, quota), skip)
    return S.quota_rows(p, SH.quota_table(spark, quota), SH.taken_shards(picked))


def test_uniform_res_fails_on_two_resolutions(spark):
    df = spark.createDataFrame([(0, 8), (1, 8), (2, 16)], "shard bigint, res bigint")
    r = CK.check_uniform_res(df).first()
    assert not r.ok and r.actual == 2
    assert CK.check_uniform_res(df.where("res = 8")).first().ok


def test_nonempty_reports_shortfall(spark):
    quota = {"add": 4000, "replace": 100}
    r = {x.check: x for x in CK.check_nonempty(SH.quota_table(spark, quota), _slice(spark, quota)).collect()}
    assert not r["nonempty:add"].ok and r["nonempty:add"].actual < 4000
    assert r["nonempty:replace"].ok and r["nonempty:replace"].actual == 100


def test_disjoint_finds_overlapping_slices(spark):
    a = _slice(spark, {"add": 1000, "tune_transfer": 1000}).select("row_id", "shard")
    b = _slice(spark, {"add": 500, "style_change": 500}).select("row_id", "shard")
    found = CK.check_disjoint(S.slice_union({"a": a, "b": b})).collect()
    assert found and all(not r.ok and r.actual > 0 for r in found)
    shared = a.join(b, ["row_id", "shard"]).count()
    assert sum(r.actual for r in found) == shared


def test_lengths_flag_missing_types(spark):
    rows = CK.check_lengths(fx.pairs(spark, SF), fx.pairs(spark, SF).groupBy("shard").agg(F.count("*").alias("n"))).where(F.col("check") == "lengths:types").collect()
    assert any(not r.ok for r in rows)
    assert all(r.ok for r in CK.check_lengths(fx.pairs(spark, SF), fx.pairs(spark, SF).groupBy("shard").agg(F.count("*").alias("n"))).where(
        F.col("check") == "lengths:prompts").collect())
