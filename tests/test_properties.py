"""Hypothesis property tests: block-based split and quota cut against brute force."""
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from editlake.operators import select as S
from editlake.operators import shards as SH

TYPES = ["add", "tune_transfer", "style_change"]

corpora = st.lists(
    st.tuples(st.integers(0, 6), st.sampled_from(TYPES), st.booleans()),
    min_size=1, max_size=120)


def _df(spark, rows):
    data = [(i * 3 + (i % 2), s, t, d) for i, (s, t, d) in enumerate(rows)]
    return spark.createDataFrame(data, "row_id bigint, shard bigint, edit_type string, decodable boolean"), data


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(rows=corpora, want_val=st.integers(0, 5))
def test_split_matches_brute_force(spark, rows, want_val):
    df, data = _df(spark, rows)
    cuts = S.split_cutoffs(df, want_val, block_rows=4)
    got = {r.row_id: r.split for r in df.join(cuts, "shard").select(
        "row_id", F.when(F.col("val_cut").isNull() | (F.col("row_id") < F.col("val_cut")), "train")
        .otherwise("val").alias("split")).collect()}
    want = {}
    by_shard = {}
    for rid, s, _, _ in data:
        by_shard.setdefault(s, []).append(rid)
    for s, ids in by_shard.items():
        ids.sort()
        n = len(ids)
        cut = n - min(want_val, n // 10)
        for i, rid in enumerate(ids):
            want[rid] = "train" if i < cut else "val"
    assert got == want


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(rows=corpora, q_add=st.integers(0, 40), q_tune=st.integers(1, 40))
def test_quota_rows_matches_brute_force(spark, rows, q_add, q_tune):
    df, data = _df(spark, rows)
    quota = {"add": q_add, "tune_transfer": q_tune}
    got = sorted(r.row_id for r in S.quota_rows(df, SH.quota_table(spark, quota), block_rows=4)
                 .select("row_id").collect())
    taken, want = {t: 0 for t in quota}, []
    for rid, s, t, d in sorted(data, key=lambda x: (x[1], x[0])):
        if t in quota and d and taken[t] < quota[t]:
            taken[t] += 1
            want.append(rid)
    assert got == sorted(want)
