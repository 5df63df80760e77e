"""Packed source and sink, sidecars, size check, stream = batch, skip-if-complete."""
import os

import pytest
from pyspark.sql import functions as F

from editlake import fixtures as fx
from editlake.operators import checks as CK
from editlake.operators import select as S
from editlake.operators import shards as SH
from editlake.sources import corpus as SC
from editlake.sources import packed as PK

SF = "/root/testdata/sf0.001"


def _rows(spark):
    img = fx.images_binary(spark, SF)
    nxt = img.select((F.col("img_id") - 1).alias("row_id"), F.col("px").alias("after"))
    p = fx.pairs(spark, SF).select("row_id", "instruction", "edit_type")
    return (p.join(img.select(F.col("img_id").alias("row_id"), F.col("px").alias("before"), "res"), "row_id")
            .join(nxt, "row_id"))


def test_packed_roundtrip_and_sizes(spark, scratch):
    rows = _rows(spark)
    path = os.path.join(scratch, "packed")
    PK.write_packed_pairs(rows, path, shards=3, want_val=30, source="test")
    back = PK.read_packed_pairs(spark, path, records_per_partition=16)
    assert back.rdd.getNumPartitions() > 3
    want = {bytes(r.before) + bytes(r.after) for r in rows.collect()}
    got = {bytes(r.before) + bytes(r.after) for r in back.collect()}
    assert got == want
    sizes = CK.check_sizes(spark, path, 8).collect()
    assert len(sizes) == 3 and all(r.ok for r in sizes)
    PK.write_packed_pairs(rows, path, shards=2, want_val=30, source="test")  # append keeps what was there
    assert PK.read_packed_pairs(spark, path).count() == 2 * rows.count()
    PK.write_packed_pairs(rows, path, shards=3, want_val=30, source="test", mode="overwrite")
    assert PK.read_packed_pairs(spark, path).count() == rows.count()
    bad = rows.withColumn("after", F.when(F.col("row_id") == 5, F.lit(b"x")).otherwise(F.col("after")))
    with pytest.raises(Exception, match="bytes in a"):
        PK.write_packed_pairs(bad, path, shards=3)
    assert PK.read_packed_pairs(spark, path).count() == rows.count()  # a failed write publishes nothing
    # a record cut short fails the size check and the read
    victim = sorted(PK.find_prefixes(path))[0] + "_images.bin"
    with open(victim, "r+b") as fh:
        fh.truncate(os.path.getsize(victim) - 10)
    assert not all(r.ok for r in CK.check_sizes(spark, path, 8).collect())
    with pytest.raises(Exception, match="records of 8 px need"):
        PK.read_packed_pairs(spark, path).count()
    with pytest.raises(Exception, match="shared mount"):
        PK.read_packed_pairs(spark, "s3a://bucket/x").count()


def test_sidecars_pad_and_truncate(spark):
    p = fx.pairs(spark, SF)
    prompts = SC.read_sidecar(SC.sidecar_arrays(p, "instruction"), "instruction")
    types = SC.read_sidecar(SC.sidecar_arrays(p, "edit_type_nullable"), "edit_type")
    missing = p.where("edit_type_nullable is null").count()
    assert SC.join_sidecars(prompts, types, "train").where("edit_type = ''").count() == missing > 0
    short = types.where("pos < 3")  # a list that ends early
    train = SC.join_sidecars(prompts, short, "train")
    probe = SC.join_sidecars(prompts, short, "probe")
    assert train.count() == p.count() and probe.count() == short.count()
    one = spark.createDataFrame([(0, 0, "A"), (0, 1, None), (0, 2, "C")], "shard bigint, row_id bigint, t string")
    back = SC.read_sidecar(SC.sidecar_arrays(one, "t"), "t").orderBy("pos").collect()
    assert [r.t for r in back] == ["A", None, "C"]  # every value keeps its place


def test_union_shards_and_skip(spark, scratch):
    p = fx.pairs(spark, SF).select("row_id", "shard", "edit_type")
    root = os.path.join(scratch, "out")
    for k in range(3):
        part = p.where(F.col("shard") % 3 == k)
        if k == 2:
            part = part.withColumn("extra", F.lit(1))
        part.write.parquet(os.path.join(root, f"shard_{k}"))
    u = SC.union_shards(spark, root)
    assert u.count() == p.count()
    assert {r.source_shard for r in u.select("source_shard").distinct().collect()} == {0, 1, 2}
    assert SC.skip_if_complete(spark, os.path.join(root, "shard_0"), 1)
    assert not SC.skip_if_complete(spark, os.path.join(root, "missing"), 1)


def test_stream_equals_batch(spark, scratch):
    from editlake.streaming import ingest as G
    p = fx.pairs(spark, SF)
    src = os.path.join(scratch, "in")
    for s in sorted(r.shard for r in p.select("shard").distinct().collect()):
        p.where(F.col("shard") == s).coalesce(1).write.mode("append").parquet(src)
        os.utime(src)
    quota = {"add": 120, "tune_transfer": 70}
    out = G.stream_ingest(spark, src, os.path.join(scratch, "out"), os.path.join(scratch, "ck"),
                          quota, p.schema, files_per_trigger=2)
    want = S.quota_rows(p, SH.quota_table(spark, quota)).select("row_id")
    assert sorted(r.row_id for r in out.select("row_id").collect()) == sorted(r.row_id for r in want.collect())
    # a replay of the same batches changes nothing
    again = G.stream_ingest(spark, src, os.path.join(scratch, "out"), os.path.join(scratch, "ck"),
                            quota, p.schema, files_per_trigger=2)
    assert again.count() == out.count()


def test_planned_stream_in_any_order_equals_batch(spark, scratch):
    from editlake.streaming import ingest as G
    p = fx.pairs(spark, SF)
    quota = {"add": 120, "tune_transfer": 70}
    qt = SH.quota_table(spark, quota)
    shards = SH.taken_shards(SH.pick_shards(SH.shard_type_counts(p), qt))
    src = os.path.join(scratch, "in")
    p.where("shard < 0").coalesce(1).write.parquet(src)  # a first file without rows
    for s in sorted((r.shard for r in p.select("shard").distinct().collect()), reverse=True):
        p.where(F.col("shard") == s).coalesce(1).write.mode("append").parquet(src)
    out = G.stream_ingest(spark, src, os.path.join(scratch, "out"), os.path.join(scratch, "ck"), quota, p.schema,
                          files_per_trigger=2, shards=shards)
    want = S.quota_rows(p, qt, shards).select("row_id")
    assert sorted(r.row_id for r in out.select("row_id").collect()) == sorted(r.row_id for r in want.collect())


def test_first_batch_without_wanted_rows(spark, scratch):
    from editlake.streaming import ingest as G
    write = G.make_batch_writer(os.path.join(scratch, "t"), {"add": 4})
    p = fx.pairs(spark, SF)
    write(p.where("edit_type = 'replace'"), 0)
    write(p.where("shard < 3"), 1)
    assert spark.read.parquet(os.path.join(scratch, "t")).count() == 4


def test_strict_and_tolerant_scan(spark, scratch):
    cell = "struct<bytes: binary, path: string>"
    rows = [(t, t, (b"x", None), (b"y", None)) for t in "abc"]
    schema = f"edit_type string, edit_instruction string, image_file {cell}, edited_file {cell}"
    root = os.path.join(scratch, "c")
    for k in range(2):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(os.path.join(root, f"train-0000{k}-of-00002"))
    with open(os.path.join(root, "train-00001-of-00002", "bad.parquet"), "wb") as fh:
        fh.write(b"not parquet")
    path = os.path.join(root, "*")
    with pytest.raises(Exception):
        SC.scan_corpus(spark, path).count()
    found = SC.scan_corpus(spark, path, tolerant=True)
    assert found.count() == 6 and {(r.shard, r.row_id) for r in found.collect()} == {(s, i) for s in (0, 1) for i in range(3)}
    assert [r.file_name for r in SC.skipped_files(spark, root, found).collect()] == ["bad.parquet"]


def test_decode_errors_only(spark):
    from editlake.operators import images as IM
    df = spark.createDataFrame([(1, (bytes(12), None)), (2, (bytes(5), None)), (3, (None, None))],
                               "img_id bigint, c struct<bytes: binary, path: string>")
    assert [r.ok for r in IM.decode_images(df, "c").orderBy("img_id").collect()] == [True, False, False]

    def broken(data):
        raise RuntimeError("codec is missing")

    with pytest.raises(Exception, match="codec is missing"):
        IM.decode_images(df, "c", decoder=broken).collect()


def test_quota_decoded_takes_rare_good_rows(spark):
    """Rounds go on until the quota is met, however few rows decode."""
    rows = [(i, 0, "add", (bytes(12) if i % 30 == 29 else bytes(5), None)) for i in range(3000)]
    df = spark.createDataFrame(rows, "row_id bigint, shard bigint, edit_type string, image_file struct<bytes: binary, path: string>")
    out = S.quota_rows_decoded(df, SH.quota_table(spark, {"add": 50}), slack=0.02)
    got = out.orderBy("type_pos").collect()
    assert [r.row_id for r in got] == [30 * k + 29 for k in range(50)] and [r.type_pos for r in got] == list(range(1, 51))


def test_tolerant_decode_reports_counts(spark):
    good = bytes(range(192))
    rows = [(i, (good if i % 4 else good[:50], None)) for i in range(40)]
    df = spark.createDataFrame(rows, "img_id long, c struct<bytes: binary, path: string>")
    out, obs = SC.tolerant_decode(df, "c")
    assert out.count() == 30
    assert obs.get == {"rows": 40, "bad": 10}


def test_stream_batch_replay_is_idempotent(spark, scratch):
    """A batch re-run after a failure (same batch id) replaces its own output."""
    from editlake.streaming import ingest as G
    p = fx.pairs(spark, SF).where("shard < 3")
    target = os.path.join(scratch, "t")
    write = G.make_batch_writer(target, {"add": 40, "tune_transfer": 30})
    write(p, 0)
    first = sorted(r.row_id for r in spark.read.parquet(target).collect())
    write(p, 0)                       # replay of the same micro-batch
    again = sorted(r.row_id for r in spark.read.parquet(target).collect())
    assert first == again and len(first) == 70
    write(fx.pairs(spark, SF).where("shard >= 3 and shard < 6"), 1)
    counts = {r.edit_type: r["count"] for r in spark.read.parquet(target).groupBy("edit_type").count().collect()}
    assert counts == {"add": 40, "tune_transfer": 30}


def test_shard_map_document_file(spark, scratch):
    """S2 on the single-document JSON form, read as whole text; keys sort numerically."""
    import json
    doc = {"10": {"rows": 5, "types": {"add": 3, "MIX:add/replace": 2}},
           "9": {"rows": 4, "types": {"replace": 4}}, "2": {"rows": 0, "types": {}}}
    path = os.path.join(scratch, "shardmap.json")
    with open(path, "w") as fh:
        json.dump(doc, fh)
    text = spark.read.option("wholetext", "true").text(path)
    rows = SH.read_shard_map_document(text).orderBy("shard", "edit_type").collect()
    assert [(r.shard, r.edit_type, r.n) for r in rows] == [
        (9, "replace", 4), (10, "MIX:add/replace", 2), (10, "add", 3)]


def test_refresh_meta_keeps_the_record(spark):
    import json

    from editlake.operators import vectors as V
    meta = SC.write_meta(fx.pairs(spark, SF), 30, 8, "orders")
    for r in V.refresh_meta(meta, 64, 32, "hashed-token").collect():
        m = json.loads(r.meta_json)
        assert (m.pop("text_dim"), m.pop("seq_len"), m.pop("encoder")) == (64, 32, "hashed-token")
        assert m["n"] == r.n == sum(m["counts"].values()) and m["source"] == "orders"


def test_sizes_against_counts(spark, scratch):
    path = os.path.join(scratch, "p")
    PK.write_packed_pairs(_rows(spark), path, shards=2)
    names = [os.path.basename(p) for p in PK.find_prefixes(path)]
    n = [int(r.records) for r in sorted(CK.check_sizes(spark, path, 8).collect(), key=lambda r: r.path)]
    counts = spark.createDataFrame(list(zip(sorted(names), [n[0], n[1] + 1])), "prefix string, n bigint")
    assert [r.ok for r in CK.check_sizes(spark, path, 8, counts).orderBy("prefix").collect()] == [True, False]


def test_refresh_embeddings_refuses_count_mismatch(spark, scratch):
    import pytest

    from editlake.operators import vectors as V
    p = fx.pairs(spark, SF).select("shard", "row_id", "instruction")
    with pytest.raises(ValueError):
        V.refresh_embeddings(p, p.count() + 1, os.path.join(scratch, "v"))
    out = V.refresh_embeddings(p, p.count(), os.path.join(scratch, "v"), dim=8)
    assert out.count() == p.count()


def test_shard_rows_are_those_of_the_scan(spark, scratch):
    rows = spark.range(40).selectExpr("'add' as edit_type", "'x' as edit_instruction", "struct(cast('b' as binary) as bytes, cast(null as string) as path) as image_file",
                                      "struct(cast('b' as binary) as bytes, cast(null as string) as path) as edited_file", "id")
    for name, n in (("00003-of-00009", 3), ("train-00001-of-00009", 7), ("a b é%", 5), ("00002-of-00009", 0), ("own", 1)):
        SC.write_files(rows.where(f"id < {n}").drop("id").withColumn("file", F.lit(name)).coalesce(1), scratch + "/c", "file")
    if not os.path.exists(scratch + "/c/00002-of-00009.parquet"):
        import pyarrow.parquet as pq
        pq.write_table(pq.read_table(scratch + "/c/own.parquet").slice(0, 0), scratch + "/c/00002-of-00009.parquet")
    for shard_of in ("number", "path"):
        c = SC.scan_corpus(spark, scratch + "/c", shard_of=shard_of)
        got = sorted(map(tuple, SC.shard_rows(c, shard_of).collect()))
        assert got == sorted(map(tuple, c.groupBy("shard").count().collect())) and len(got) == 4
        take = lambda **more: sorted(map(tuple, S.slice_of_shards(c, 1, 6, F.lit(True), **more).select("shard", "row_id").collect()))
        assert take(rows=SC.shard_rows(c, shard_of)) == take() and len(take()) == 6
