"""Sketches, bucketed joins, keyed-state ingest, versioned vectors, null shards, equal file names."""
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from editlake import fixtures as fx
from editlake.operators import select as S
from editlake.operators import shards as SH
from editlake.operators import sketches as SK
from editlake.operators import vectors as V
from editlake.operators.ordering import ordered_position
from editlake.sources import bucketed as BK
from editlake.sources import corpus as SC
from editlake.streaming.quota_state import stateful_ingest

SF = "/root/testdata/sf0.001"


# --- sketches --------------------------------------------------------------------

def test_overlap_estimates_within_their_error(spark, scratch):
    ids = lambda a, b: spark.range(a, b).select(F.concat(F.lit("prompt "), "id").alias("instruction"))
    slices = {"a": ids(0, 200_000), "b": ids(150_000, 250_000), "c": ids(400_000, 400_500).unionAll(ids(400_000, 400_500)),
              "none": ids(0, 0), "nulls": ids(0, 3).select(F.lit(None).cast("string").alias("instruction"))}
    folder = scratch + "/sk"
    for name, df in slices.items():
        SK.store_sketches(SK.slice_sketches({name: df}), folder)
    SK.store_sketches(SK.slice_sketches({"c": slices["c"]}), folder)  # a rerun replaces its own sketch only
    got = {(r.slice_a, r.slice_b): r for r in SK.sketch_overlap(
        SK.stored_sketches(spark, folder), [("a", "b"), ("a", "c"), ("c", "c"), ("a", "none"), ("none", "none"), ("c", "nulls")]).collect()}
    assert len(got) == 6
    ab = got["a", "b"]
    assert abs(ab.shared - 50_000) <= 1.5 * ab.shared_error and 0 < ab.shared_error < 2_500
    assert abs(ab.distinct_a - 200_000) < 6_000 and abs(ab.distinct_b - 100_000) < 3_000
    assert (got["a", "c"].shared, got["c", "c"].shared, got["c", "c"].shared_error) == (0, 500, 0.0)
    assert got["none", "none"].distinct_a == 0 and got["none", "none"].share_of_smaller is None and got["c", "nulls"].distinct_b == 0


def heads(spark, pairs):
    return spark.createDataFrame(pairs, "shard bigint, kind string, head string")


def brute_top(pairs, k):
    n = {}
    for _, g, h in pairs:
        if h is not None:
            n[g, h] = n.get((g, h), 0) + 1
    out = []
    for g in {g for g, _ in n}:
        best = sorted(((-c, h) for (gg, h), c in n.items() if gg == g))[:k]
        out += [(g, h, -c, r + 1) for r, (c, h) in enumerate(best)]
    return sorted(out, key=repr)


def test_top_heads_exact_with_small_sketches(spark):
    rng = np.random.default_rng(1)
    skewed = [(int(i % 7), "x" if i % 3 else None, f"h{min(int(rng.zipf(1.6)), 400)}") for i in range(6000)]
    flat = [(int(i % 7), "flat", f"w{i % 900}") for i in range(2700)]  # no head stands out: counted in full
    few = [(1, "few", "only"), (2, "few", None), (3, "nothing", None)]
    pairs = skewed + flat + few
    df = heads(spark, pairs)
    got = SK.top_heads(df, "head", 5, groups=["kind"], tracked=64)
    assert sorted(((r.kind, r["head"], r.n, r["rank"]) for r in got.collect()), key=repr) == brute_top(pairs, 5)
    one = SK.top_heads(df, "head", 5, tracked=64)
    all_in_one = [(s, 0, h) for s, _, h in pairs]
    assert [(r["head"], r.n) for r in one.orderBy("rank").collect()] == [(h, n) for _, h, n, _ in sorted(brute_top(all_in_one, 5), key=lambda r: r[3])]
    assert SK.top_heads(heads(spark, [(1, "a", None)]), "head", 3).collect() == []


def test_sketches_of_new_shards_are_added(spark, scratch):
    old = heads(spark, [(0, "k", "a")] * 30 + [(0, "k", "b")] * 20)
    new = heads(spark, [(1, "k", "b")] * 25 + [(1, "k", "c")])
    folder = scratch + "/heads"
    for part in (old, new):
        SK.head_sketches(part, "head").write.mode("append").parquet(folder)
    got = SK.top_heads(old.unionAll(new), "head", 2, sketches=spark.read.parquet(folder))
    assert [(r["head"], r.n) for r in got.orderBy("rank").collect()] == [("b", 45), ("a", 30)]


# --- bucketed positional join -----------------------------------------------------

def test_bucketed_join_has_no_exchange(spark, scratch):
    place = lambda name, step: spark.range(600).select(
        (F.col("id") % 5).alias("shard"), F.expr("id div 5").alias("pos"), F.col("id").cast("string").alias(name)).where(F.col("id") % step == 0)
    frames = {"images": place("image", 1), "prompts": place("instruction", 1), "types": place("edit_type", 2), "vectors": place("v", 3)}
    read = {}
    for name, df in frames.items():
        BK.write_bucketed(df, f"{scratch}/{name}", 4)
        read[name] = BK.read_bucketed(spark, f"{scratch}/{name}", 4)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = BK.join_by_position(**read)
        plan = joined._jdf.queryExecution().executedPlan().toString()
        rows = joined.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert plan.count("SortMergeJoin") == 3 and "Exchange" not in plan
    assert len(rows) == 600
    for r in rows:
        k = r.pos * 5 + r.shard
        assert (r.image, r.instruction) == (str(k), str(k))
        assert r.edit_type == (str(k) if k % 2 == 0 else "") and r.v == (str(k) if k % 3 == 0 else None)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("bucketed_")]
    BK.write_bucketed(place("v", 6), f"{scratch}/vectors", 4)  # one table written anew
    assert BK.read_bucketed(spark, f"{scratch}/vectors", 4).count() == 100


# --- keyed-state ingest ------------------------------------------------------------

QUOTA = {"add": 120, "tune_transfer": 70, "replace": 0}


def arrive(p, folder, shards):
    """One file per shard, in the order given."""
    for i, s in enumerate(shards):
        p.where(F.col("shard") == s).coalesce(1).write.mode("append").parquet(folder)
        for name in os.listdir(folder):
            path = os.path.join(folder, name)
            if name.endswith(".parquet") and os.path.getmtime(path) > 1e9 + 1e6:
                os.utime(path, (1e9 + i, 1e9 + i))


def keys(df):
    return sorted((r.edit_type, r.shard, r.row_id) for r in df.select("edit_type", "shard", "row_id").collect())


def test_keyed_state_equals_batch_over_restarts(spark, scratch):
    p = fx.pairs(spark, SF).withColumn("extra", F.when(F.col("row_id") % 3 == 0, F.lit(2**60) + F.col("row_id"))).withColumn(
        "score", F.when(F.col("row_id") % 4 == 1, F.col("row_id") / 7))
    shards = sorted(r.shard for r in p.select("shard").distinct().collect())
    src, out, ck = (os.path.join(scratch, n) for n in ("in", "out", "ck"))
    half = len(shards) // 2
    arrive(p, src, shards[:half])
    first = stateful_ingest(spark, src, out, ck, QUOTA, p.schema, files_per_trigger=2)
    assert keys(first) == keys(S.quota_rows(p.where(F.col("shard").isin(shards[:half])), SH.quota_table(spark, QUOTA)))
    again = stateful_ingest(spark, src, out, ck, QUOTA, p.schema, files_per_trigger=2)  # nothing new: nothing counts twice
    assert keys(again) == keys(first)
    arrive(p, src, shards[half:])
    done = stateful_ingest(spark, src, out, ck, QUOTA, p.schema, files_per_trigger=3)
    want = S.quota_rows(p, SH.quota_table(spark, QUOTA))
    assert keys(done) == keys(want)
    whole = {r.row_id: (r.extra, r.score, r.decodable, r.instruction) for r in p.collect()}
    assert all(whole[r.row_id] == (r.extra, r.score, r.decodable, r.instruction) for r in done.collect())  # nulls and large numbers stay


def test_a_lost_commit_is_replayed(spark, scratch):
    p = fx.pairs(spark, SF)
    shards = sorted(r.shard for r in p.select("shard").distinct().collect())
    src, out, ck = (os.path.join(scratch, n) for n in ("in", "out", "ck"))
    arrive(p, src, shards)
    stateful_ingest(spark, src, out, ck, QUOTA, p.schema, files_per_trigger=4)
    want = keys(spark.read.schema(p.schema).parquet(out))
    last = max(int(n) for n in os.listdir(f"{ck}/commits") if n.isdigit())
    for name in (f"{last}", f".{last}.crc"):  # the driver died before it noted the last batch as done
        if os.path.exists(f"{ck}/commits/{name}"):
            os.remove(f"{ck}/commits/{name}")
    assert keys(stateful_ingest(spark, src, out, ck, QUOTA, p.schema, files_per_trigger=4)) == want
    assert want == keys(S.quota_rows(p, SH.quota_table(spark, QUOTA)))


def test_nested_columns_are_refused(spark, scratch):
    schema = spark.range(1).select(F.lit("add").alias("edit_type"), F.lit(True).alias("decodable"), F.col("id").alias("shard"),
                                   F.col("id").alias("row_id"), F.array("id").alias("list")).schema
    with pytest.raises(ValueError, match="nested"):
        stateful_ingest(spark, scratch, scratch + "/o", scratch + "/c", QUOTA, schema)


# --- versioned vectors ---------------------------------------------------------------

def test_versions_switch_at_once(spark, scratch):
    p = fx.pairs(spark, SF).select("shard", "row_id", "instruction")
    meta = SC.write_meta(fx.pairs(spark, SF), 30, 8, "orders")
    root = scratch + "/vec"
    with pytest.raises(ValueError, match="no version"):
        V.read_version(spark, root)
    V.refresh_version(p, meta, root, dim=4, encoder="one")
    held = V.read_version(spark, root)[0]

    class Broken:
        def encode(self, texts):
            raise RuntimeError("encoder broke")

    with pytest.raises(Exception, match="encoder broke"):
        V.refresh_version(p, meta, root, dim=4, encoder="two", encoder_factory=lambda: Broken())
    vectors, records = V.read_version(spark, root)
    assert vectors.count() == p.count() and records.where("meta_json like '%\"encoder\":\"one\"%'").count() == meta.count()
    with pytest.raises(ValueError, match="its meta says"):
        V.refresh_version(p.where("row_id <> 5"), meta, root, dim=4)
    with pytest.raises(ValueError, match="has None prompts"):
        V.refresh_version(p.where("shard <> 2"), meta, root, dim=4)
    V.refresh_version(p, meta, root, dim=6, encoder="three")
    vectors, records = V.read_version(spark, root)
    assert {r.d for r in vectors.select(F.size(F.element_at("vectors", 1)).alias("d")).collect()} == {6}
    assert records.where("meta_json like '%three%'").count() == meta.count()
    assert held.count() == p.count()  # a reader of the version before still can
    V.refresh_version(p, meta, root, dim=2, encoder="four")
    assert len([n for n in os.listdir(root) if n.startswith("v-")]) == 2


def test_encoder_cut_and_mean():
    long = " ".join(f"w{i}" for i in range(40))
    mean, cut = (V.HashedTokenEncoder(dim=8, seq_len=32, cut=c) for c in (False, True))
    a, b, short = cut.encode([long]), mean.encode([long]), " ".join(f"w{i}" for i in range(32))
    np.testing.assert_array_equal(a, cut.encode([short]))
    np.testing.assert_array_equal(a[0, :31], b[0, :31])
    assert np.abs(a[0, 31] - b[0, 31]).max() > 0.01
    np.testing.assert_array_equal(mean.encode([short, ""]), cut.encode([short, ""]))


# --- null shards and equal file names --------------------------------------------------

def test_positions_keep_null_majors(spark):
    rows = [("a", None, 3), ("a", None, 9), ("a", 1, 0), (None, None, 1), (None, 2, 5), ("a", 2, 4)]
    df = spark.createDataFrame(rows, "g string, shard bigint, row_id bigint")
    got = ordered_position(df, ["g"], ["shard"], "row_id", total_name="total", block_rows=4)
    assert sorted(map(repr, ((r.g, r.shard, r.row_id, r.pos, r.total) for r in got.collect()))) == sorted(map(repr, [
        ("a", None, 3, 1, 4), ("a", None, 9, 2, 4), ("a", 1, 0, 3, 4), ("a", 2, 4, 4, 4), (None, None, 1, 1, 2), (None, 2, 5, 2, 2)]))


def test_decoded_quota_keeps_null_shards(spark):
    cell = "struct<bytes: binary, path: string>"
    good, bad = (bytes(12), None), (b"x", None)
    rows = [(k, None if k % 2 else 1, "add", bad if k % 5 == 0 else good) for k in range(20)]
    df = spark.createDataFrame(rows, f"row_id bigint, shard bigint, edit_type string, image_file {cell}")
    got = S.quota_rows_decoded(df, SH.quota_table(spark, {"add": 12}), "image_file", slack=0.01)
    ranked = sorted((r for r in rows if r[3] is good), key=lambda r: (r[1] is not None, r[1] or 0, r[0]))[:12]
    assert sorted((r.type_pos, r.row_id, r.shard) for r in got.collect()) == [(i + 1, r[0], r[1]) for i, r in enumerate(ranked)]


def test_equal_shard_numbers_are_refused(spark, scratch):
    cell = "struct<bytes: binary, path: string>"
    rows = spark.createDataFrame([("add", "x", (b"1", None), (b"2", None))] * 3, f"edit_type string, edit_instruction string, image_file {cell}, edited_file {cell}")
    for folder in ("add", "replace"):
        rows.coalesce(1).write.parquet(f"{scratch}/tmp-{folder}")
        os.makedirs(f"{scratch}/c/{folder}")
        part = next(n for n in os.listdir(f"{scratch}/tmp-{folder}") if n.endswith(".parquet"))
        os.rename(f"{scratch}/tmp-{folder}/{part}", f"{scratch}/c/{folder}/00000-of-00010.parquet")
    both = [f"{scratch}/c/add", f"{scratch}/c/replace"]
    with pytest.raises(ValueError, match="two files are shard 0"):
        SC.scan_corpus(spark, both)
    keyed = SC.scan_corpus(spark, both, shard_of="path").select("shard", "row_id").collect()
    assert len({(r.shard, r.row_id) for r in keyed}) == 6 and all(r.shard < 0 for r in keyed)
    assert {r.shard for r in SC.scan_corpus(spark, both[0]).collect()} == {0}


# --- bitmap index ------------------------------------------------------------------------

def test_bitmap_index_draws_equal_pool_draws(spark, monkeypatch):
    from editlake.operators import assemble as AS
    p = fx.pairs(spark, SF).where("decodable")
    sparse = p.withColumn("row_id", F.col("row_id") * 977 + 5)  # many blocks, few rows each
    sparse = sparse.withColumn("shard", F.when(F.col("shard") % 4 > 0, F.col("shard")))  # a null shard holds rows of many
    for corpus, block in ((p, 1 << 15), (sparse, 1 << 15), (p, 256)):
        monkeypatch.setattr(AS, "BLOCK_BITS", block)
        monkeypatch.setattr(AS, "STRIDE", 64)
        pools = AS.build_pools(corpus, "train", 30, min_rows=20, materialize=True)
        index = AS.build_index(corpus, "train", 30, min_rows=20)
        assert AS.pool_sizes(index) == AS.pool_sizes(pools)
        got, want = AS.mixture_sample_indexed(index, 3000, 7), AS.mixture_sample(pools, 3000, 7)
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
        every = pools.select("pool_id", "pos")
        assert sorted(map(repr, AS.rows_at(index, every).select("pool_id", "pos", "shard", "row_id").collect())) == sorted(
            map(repr, pools.select("pool_id", "pos", "shard", "row_id").collect()))


def test_index_is_small_and_few_draws_touch_few_rows(spark):
    from editlake.operators import assemble as AS
    rows = spark.range(200_000).select(
        (F.col("id") % 3).alias("shard"), F.expr("id div 3").alias("row_id"), F.lit("style_change").alias("edit_type"), F.lit("x").alias("instruction"),
        F.lit("x").alias("caption"), F.lit(True).alias("decodable"))
    index = AS.build_index(rows, "train", 30)
    assert index.count() <= 2 * 3 * 3 and index.agg(F.max(F.octet_length("bits"))).first()[0] == 4096
    few = AS.mixture_sample_indexed(index, 25, 3)
    assert few.count() == 25
    assert AS.rows_at(index, few.select("pool_id", F.col("draw_id").alias("pos")).distinct()).count() <= 25
