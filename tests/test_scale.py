"""Steps that must not grow with the corpus in the driver, in files or in repeated work."""
import os
import time
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from editlake import fixtures as fx
from editlake.functions import pixels as PX
from editlake.functions import text as T
from editlake.operators import images as IM
from editlake.operators import select as S
from editlake.operators import vectors as V
from editlake.plans import catalog_more as C
from editlake.session import CLEANUP_CONF
from editlake.sources import corpus as SC
from editlake.sources import packed as PK

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("made", [C.corpus_images, C.q_pair_error])
def test_images_are_never_broadcast(spark, made):
    p = plan(made(spark, SF))
    assert "SortMergeJoin" in p and "BroadcastHashJoin" not in p


def test_deviation_takes_the_mean_once(spark):
    df = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(30000)), lambda v: v.cast("double")).alias("x"))
    t = time.time()
    assert df.select(F.round(PX.array_std(F.col("x")), 3)).first()[0] == 8660.398
    assert time.time() - t < 10


def test_quantile_with_nulls(spark):
    df = spark.createDataFrame([(1, [3.0, None, -4.0, 1.0]), (2, [None, None]), (3, [-2.0])], "id int, x array<double>")
    got = {r.id: (r.low, r.high) for r in df.select("id", PX.abs_quantile(F.col("x"), 0.0).alias("low"), PX.abs_quantile(F.col("x"), 1.0).alias("high")).collect()}
    assert got == {1: (1.0, None), 2: (None, None), 3: (2.0, 2.0)}  # nulls last


@pytest.mark.parametrize("query", [C.q_pack_chw, C.q_normalize, C.q_flip_pairs])
def test_long_form_makes_an_image_once(spark, query):
    assert optimized(query(spark, SF)).count("zip_with(") == 1


def test_long_form_leaves_out_null_and_empty_images(spark):
    df = spark.createDataFrame([(1, [5, 6]), (2, []), (3, None), (4, [None])], "img_id bigint, a array<int>")
    assert sorted((r.img_id, r.pos, r.value) for r in C._long(df, "a").collect()) == [(1, 0, 5), (1, 1, 6), (4, 0, None)]


def test_rounding_without_decimals(spark):
    values = [0.5, 1.5, 2.5, -0.5, -2.5, 0.49999999999999994, -0.49999999999999994, 1e6 + 0.5, 123456.49999999999, 0.0, -0.0, 1e15, 3.0]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    assert all(r[0] == r[1] for r in df.select(PX.half_away(F.col("v")), F.round("v", 0).cast("bigint")).collect())
    small = df.union(spark.range(256).selectExpr("id / 127.5D - 1")).union(spark.createDataFrame([(5e-7,), (1.5e-6,), (-2.5e-6,), (float("nan"),)], "v double"))
    assert all(repr(r[0]) == repr(r[1]) for r in small.select(PX.rounded(F.col("v"), 6), F.round("v", 6)).collect())


def test_pixel_digest_is_that_of_the_arrays(spark):
    df = spark.createDataFrame([(1, [0.25, -1.0, 0.1234565]), (3, None), (4, [1.0, None]), (5, [1.0])], "id int, x array<double>")
    s1, s2 = PX.digest(F.col("x"))
    got = df.select("id", IM.pixel_digest()("x").alias("d"), s1.alias("s1"), s2.alias("s2")).collect()
    assert all((r.d.s1, r.d.s2) == (r.s1, r.s2) for r in got) and len(got) == 4


def test_edit_functions_take_sizes_and_nulls(spark):
    IM.register_edits(spark, "t_")
    df = spark.createDataFrame([(1, [1.0] * 3, 1), (2, None, 1), (3, [0.5] * 12, 2), (4, [0.5] * 3, None)], "id int, x array<double>, side int").coalesce(1)
    got = {r.id: r.y for r in df.selectExpr("id", "t_inverted(x, side) as y").collect()}
    assert got == {1: [-1.0] * 3, 2: None, 3: [-0.5] * 12, 4: None}
    with pytest.raises(Exception, match="not 3 x 2 x 2"):
        df.selectExpr("t_inverted(x, 2)").collect()
    made = C.q_register_edits(spark, SF)
    assert "transform(" not in optimized(made).split("ArrowEvalPython")[0]  # digests in the workers, not value by value


def test_sql_edits_agree_on_one_image(spark):
    x = [i / 13.0 - 0.9 for i in range(12)]
    df = spark.createDataFrame([(x,)], "x array<double>")
    for name in PX.SQL_EDITS:
        got = df.select(PX.synthetic_sql(F.col("x"), name, 2)).first()[0]
        want = IM.EDITS[name](pa.array(x).to_numpy().reshape(1, 3, 2, 2)).reshape(-1).tolist()
        assert got == pytest.approx(want, abs=1e-12), name


def test_stream_batches_do_not_grow_with_shards(spark, scratch, monkeypatch):
    monkeypatch.setattr(C, "_scratch", lambda spark, name: f"{scratch}/{name}")
    C.q_stream_ingest(spark, "/root/testdata/sf0.01")  # 150 shards
    batches = [n for n in os.listdir(f"{scratch}/stream/ckpt/commits") if n.isdigit()]
    assert 2 <= len(batches) <= 4


def test_corpus_files_are_written_in_place(spark, scratch):
    rows = spark.range(25000).selectExpr("format_string('train-%05d-of-00003', id % 3) as file", "id as row_id", "cast(id as string) as caption")
    n = SC.write_files(rows.repartition("file").sortWithinPartitions("file", "row_id"), scratch, "file")
    assert n == 3 and sorted(os.listdir(scratch)) == [f"train-{k:05d}-of-00003.parquet" for k in range(3)]
    back = spark.read.parquet(scratch).selectExpr("row_id", "_metadata.row_index as at", "_metadata.file_name as f")
    assert back.count() == 25000 and back.where("at <> row_id div 3 or cast(substr(f, 7, 5) as int) <> row_id % 3").count() == 0
    assert SC.write_files(rows.limit(0), scratch + "/none", "file") == 0


def test_slice_of_shards_counts_the_corpus_once(spark):
    c = fx.pairs(spark, "/root/testdata/sf0.01").selectExpr("shard", "row_id % 100 as row_id", "instruction", "decodable")
    out = S.slice_of_shards(c, 1, 300)
    assert "Window" not in plan(out) and {r.shard for r in out.select("shard").collect()} == {3, 4, 5}
    null = c.where("shard < 2").withColumn("shard", F.when(F.col("shard") > 0, F.col("shard")))
    assert {r.shard for r in S.slice_of_shards(null, 0, 150).collect()} == {None, 1}
    assert S.slice_of_shards(c, 1000, 300).count() == 0


def test_vectors_are_not_a_folder_a_shard(spark, scratch):
    p = spark.range(300).selectExpr("id as shard", "0L as row_id", "concat('add hat ', id) as instruction")
    meta = p.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).select("shard", "n", F.to_json(F.struct("n")).alias("meta_json"))
    assert V.refresh_version(p, meta, scratch, dim=4).select("shard").distinct().count() == 300
    found = [f for _, _, names in os.walk(scratch) for f in names if f.endswith(".parquet")]
    assert len(found) < 100


def test_raised_digits_are_word_characters(spark):
    df = spark.createDataFrame([(" add ²add add",), ("add a hat",)], "t string")
    got = df.select(T.head_noun_v1(F.col("t"), "add"), T.addition_head(F.col("t")), T.looks_like_addition(F.col("t"))).collect()
    assert [tuple(r) for r in got] == [(None, None, False), ("hat", "hat", True)]


def test_offsets_of_positions_are_not_broadcast(spark):
    from editlake.operators.ordering import ordered_position
    rows = spark.range(600).selectExpr("id % 3 as g", "id div 100 as shard", "id as row_id")
    made = ordered_position(rows, ["g"], ["shard"], "row_id")
    got = {(r.g, r.row_id): r.pos for r in made.collect()}
    assert got == {(i % 3, i): i // 3 + 1 for i in range(600)}
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan  # they grow with the shards


# ------------------------------------------------------- round 4: packed pairs with vectors

ORDERS = [k * 7 for k in range(300)] + [21] * 40 + [None] * 3
PARTS = [*range(15), 3, 3, None, 99]
VECTORS = [0, 1, 2, 2, None, 40]


def vector_tables(spark, folder):
    """Few rows: ids of pairs, images and vectors repeat, have gaps and are null."""
    spark.createDataFrame([(k,) for k in ORDERS], "o_orderkey bigint").repartition(3).write.parquet(f"{folder}/orders.parquet")
    spark.createDataFrame([(k, i % 50) for i, k in enumerate(PARTS)], "p_partkey bigint, p_size int").write.parquet(f"{folder}/part.parquet")
    spark.createDataFrame([(k, [float(100 * i + j) for j in range(64)]) for i, k in enumerate(VECTORS)],
                          "vec_id bigint, embedding array<float>").write.parquet(f"{folder}/embeddings.parquet")


def pairs_with_vectors(held=lambda k: True):
    """(first, middle, last) of every packed row, counted."""
    out = Counter()
    for k in ORDERS:
        if k is not None and k % 97 and held(k):
            copies = PARTS.count(k % len(PARTS)) * PARTS.count((k + 1) % len(PARTS))
            for i, v in enumerate(VECTORS):
                if v == k % len(VECTORS):
                    out[100.0 * i, 100.0 * i + 36, 100.0 * i + 63] += copies
    return +out


def shuffle_files(spark):
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for name in (found.apply(i).getName() for i in range(found.size())) if name.startswith("shuffle_")}


def test_row_slices_take_every_row_once(spark):
    df = spark.createDataFrame([(k,) for k in ORDERS], "row_id bigint")
    slices = PK.row_slices(df, 50)
    taken = [Counter(r.row_id for r in df.where(s).collect()) for s in slices]
    assert len(slices) > 4 and sum(taken, Counter()) == Counter(ORDERS) and max(t.total() for t in taken) < 150
    assert all(not a.keys() & b.keys() for i, a in enumerate(taken) for b in taken[:i])
    for few in (df.limit(0), df.where("row_id is null"), df.where("row_id = 21")):
        assert sum(few.where(s).count() for s in PK.row_slices(few, 2)) == few.count()


def test_vectors_are_written_slice_by_slice(spark, scratch, monkeypatch):
    """No shuffle outlives the slice that it served."""
    vector_tables(spark, scratch)
    monkeypatch.setattr(PK, "SLICE_ROWS", 60, raising=False)
    before = shuffle_files(spark)
    path = C._with_vectors(spark, scratch)
    until = time.time() + 20
    while shuffle_files(spark) - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffle_files(spark) - before
    assert spark.conf.get(CLEANUP_CONF, None) in (None, "false")  # as it was
    prefixes = PK.find_prefixes(path)
    assert len(prefixes) > 8
    got = Counter((r.vectors[0][0], r.vectors[4][4], r.vectors[7][7]) for r in PK.read_vectors(spark, path).collect())
    assert got == pairs_with_vectors()


def test_vectors_of_empty_tables(spark, scratch):
    vector_tables(spark, scratch + "/full")
    for t in ("orders", "part", "embeddings"):
        spark.read.parquet(f"{scratch}/full/{t}.parquet").limit(0).write.parquet(f"{scratch}/none/{t}.parquet")
    assert C.q_read_vectors(spark, scratch + "/none").count() == 0


def test_typed_pairs_come_from_every_slice(spark, scratch, monkeypatch):
    vector_tables(spark, scratch)
    monkeypatch.setattr(PK, "SLICE_ROWS", 60, raising=False)
    before = shuffle_files(spark)
    spark.conf.set(PK.PUSHDOWN, "true")
    try:
        rows = C.q_read_packed_typed(spark, scratch)
        until = time.time() + 20
        while shuffle_files(spark) - before and time.time() < until:
            time.sleep(0.2)
        assert not shuffle_files(spark) - before
        found = rows.collect()
    finally:
        spark.conf.unset(PK.PUSHDOWN)
    assert {r.edit_type for r in found} == {"add", "replace"}
    kind = lambda k: (k // 100 + (k % 100 >= 90)) % 5
    assert Counter((r.first, r.middle, r.last) for r in found) == pairs_with_vectors(lambda k: kind(k) in (0, 4))
