"""R1 windows against a test-only greedy walk; ordered positions against
row_number; quota rows; slices."""
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from editlake import fixtures as fx
from editlake.operators import select as S
from editlake.operators import shards as SH
from editlake.operators.ordering import ordered_position


def greedy_walk(smap, quota, skip):
    """Brute-force R1 from its definition, as a plain loop."""
    filled = dict.fromkeys(quota, 0)
    chosen, passed_over = [], 0
    for shard in sorted(smap):
        if all(filled[t] >= quota[t] for t in quota):
            break
        open_here = {t for t in smap[shard] if t in quota and filled[t] < quota[t]}
        if not open_here:
            continue
        if passed_over < skip:
            passed_over += 1
            continue
        chosen.append((shard, open_here))
        for t in open_here:
            filled[t] += smap[shard][t]
    return chosen, filled


def test_pick_shards_matches_walk(spark):
    rng = random.Random(7)
    types = ["add", "tune", "style", "bg", "mix"]
    for trial in range(25):
        smap = {}
        for s in range(rng.randint(5, 40)):
            k = rng.choice([1, 1, 1, 2])
            smap[s] = {t: rng.randint(1, 50) for t in rng.sample(types, k)}
        quota = {t: rng.randint(1, 300) for t in rng.sample(types[:4], rng.randint(1, 3))}
        skip = rng.randint(0, 6)
        taken, got = greedy_walk(smap, quota, skip)
        rows = [(s, t, n) for s, d in smap.items() for t, n in d.items()]
        sm = spark.createDataFrame(rows, "shard bigint, edit_type string, n bigint")
        picked = SH.pick_shards(sm, SH.quota_table(spark, quota), skip).collect()
        by_shard = {}
        for r in picked:
            by_shard.setdefault(r.shard, set()).add(r.edit_type)
        assert sorted(by_shard.items()) == sorted(taken), (trial, smap, quota, skip)
        proj = {t: 0 for t in quota}
        for r in picked:
            proj[r.edit_type] += r.n
        assert proj == got


def test_ordered_position_equals_row_number(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", "c"]), rng.randint(0, 9), i) for i in rng.sample(range(5000), 3000)]
    df = spark.createDataFrame(rows, "g string, shard bigint, row_id bigint")
    got = ordered_position(df, ["g"], ["shard"], "row_id", block_rows=64, total_name="tot")
    w = Window.partitionBy("g").orderBy("shard", "row_id")
    want = df.withColumn("pos", F.row_number().over(w).cast("bigint")).withColumn(
        "tot", F.count("*").over(Window.partitionBy("g")).cast("bigint"))
    assert sorted(got.select("g", "shard", "row_id", "pos", "tot").collect()) == \
        sorted(want.select("g", "shard", "row_id", "pos", "tot").collect())


def test_ordered_position_keeps_null_groups(spark):
    rows = [(None, 0, i) for i in range(5)] + [("a", 0, i) for i in range(5, 8)]
    df = spark.createDataFrame(rows, "g string, shard bigint, row_id bigint")
    got = sorted((r.g or "", r.pos) for r in ordered_position(df, ["g"], ["shard"], "row_id").collect())
    assert got == [("", 1), ("", 2), ("", 3), ("", 4), ("", 5), ("a", 1), ("a", 2), ("a", 3)]


def test_quota_rows_counts_decodable_only(spark):
    p = fx.pairs(spark, "/root/testdata/sf0.01")
    q = SH.quota_table(spark, {"add": 500, "replace": 10})
    out = S.quota_rows(p, q)
    counts = {r.edit_type: r.c for r in out.groupBy("edit_type").agg(F.count("*").alias("c")).collect()}
    assert counts == {"add": 500, "replace": 10}
    assert out.where(~F.col("decodable")).count() == 0
    # the taken add rows are exactly the first 500 decodable ones in (shard, row) order
    first = (p.where("edit_type = 'add' and decodable").orderBy("shard", "row_id").limit(500)
             .select("row_id").collect())
    assert sorted(r.row_id for r in first) == sorted(
        r.row_id for r in out.where("edit_type = 'add'").select("row_id").collect())


def test_slices_disjoint_and_complete(spark):
    p = fx.pairs(spark, "/root/testdata/sf0.001")
    n = 250
    parts = [S.slice_rows(p, k, n) for k in range(6)]
    ids = [set(r.row_id for r in s.select("row_id").collect()) for s in parts]
    for i in range(len(ids)):
        for j in range(i + 1, len(ids)):
            assert not ids[i] & ids[j]
    good = set(r.row_id for r in p.where("decodable").select("row_id").collect())
    assert set().union(*ids) == good


def test_split_parts_disjoint_and_complete(spark):
    p = fx.pairs(spark, "/root/testdata/sf0.001")
    s = S.split_train_val(p, 30)
    assert s.count() == p.count()
    per = s.groupBy("shard", "split").count().collect()
    val = {r.shard: r["count"] for r in per if r.split == "val"}
    assert all(v == 10 for v in val.values())


def test_shard_map_roundtrip(spark):
    p = fx.pairs(spark, "/root/testdata/sf0.001")
    sm = SH.build_shard_map(p)
    back = SH.read_shard_map(sm)
    want = SH.shard_type_counts(p)
    assert sorted(back.collect()) == sorted(want.collect())
    doc = sm.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(
        F.col("shard").cast("string"), F.from_json("entry_json", SH.SHARD_ENTRY_SCHEMA))))).alias("value"))
    assert sorted(SH.read_shard_map_document(doc).collect()) == sorted(want.collect())


def test_quota_rows_decoded_widens_until_met(spark):
    good = bytes(range(192))
    data = []
    for i in range(60):
        bad = i % 3 == 0          # a third of the cells cannot be decoded
        data.append((i, i // 10, "add" if i % 2 else "tune_transfer", (good[:7] if bad else good, None)))
    df = spark.createDataFrame(data, "row_id bigint, shard bigint, edit_type string, "
                                     "image_file struct<bytes: binary, path: string>")
    quota = SH.quota_table(spark, {"add": 12, "tune_transfer": 25})
    out = S.quota_rows_decoded(df, quota, slack=0.0, block_rows=8).collect()
    want = []
    for t, q in (("add", 12), ("tune_transfer", 25)):
        ok = [i for i in range(60) if (i % 2 == (1 if t == "add" else 0)) and i % 3 != 0]
        want += ok[:q]          # tune has only 20 decodable rows: all of them
    assert sorted(r.row_id for r in out) == sorted(want)
    assert all(len(r.px) == 192 for r in out)


def test_quota_words_and_empty_plan(spark):
    import pytest
    assert SH.parse_quota_words(["add=60000", "tune_transfer=5"]) == {"add": 60000, "tune_transfer": 5}
    empty = spark.createDataFrame([], "shard bigint")
    with pytest.raises(ValueError):
        SH.require_nonempty(empty, "next slice")
    from editlake.functions import text as T
    ids = spark.createDataFrame([("add_hat",), ("nope",)], "n string").select(
        T.type_id_of(F.col("n")).alias("i")).collect()
    assert [r.i for r in ids] == [56, None]
