"""Packed pairs: index, pushed filters, vectors, re-embedding, files without an index."""
import hashlib
import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from editlake.sources import packed as PK

TYPES = ["add", "remove", "tune_transfer", None, "a\"b,é"]


def px(k, half):
    return hashlib.sha256(f"{k}:{half}".encode()).digest() * 6  # 192 bytes: 8 px


def rows(spark, n=5000, vectors=False):
    """Types in long stretches, as in a corpus sorted by type."""
    data = [(k, px(k, 0), px(k, 1), 8, None if k % 11 == 0 else f'put a "hat", {k} é', TYPES[k * len(TYPES) // n]) for k in range(n)]
    df = spark.createDataFrame(data, "row_id bigint, before binary, after binary, res int, instruction string, edit_type string")
    if vectors:
        f = F.col("row_id").cast("float")
        df = df.withColumn("vectors", F.array(F.array(f, f + 1, f + 2), F.array(-f, f / 2, F.lit(0).cast("float"))))
    return df


@pytest.fixture()
def pushed(spark):
    spark.conf.set(PK.PUSHDOWN, "true")
    yield spark
    spark.conf.unset(PK.PUSHDOWN)


def key(r):
    return bytes(r.before), bytes(r.after), r.instruction, r.edit_type


def want(spark, n=5000):
    return sorted(((r.before, r.after, r.instruction or "", r.edit_type) for r in rows(spark, n).collect()), key=repr)


def test_round_trip_and_index(spark, scratch):
    for path in (scratch + "/a", "file:" + scratch + "/b"):
        PK.write_packed_pairs(rows(spark), path, shards=2, want_val=30, source="s")
        got = PK.read_packed_pairs(spark, path, 1024)
        assert sorted(((bytes(r.before), bytes(r.after), r.instruction, r.edit_type) for r in got.collect()), key=repr) == want(spark)
        for prefix in PK.find_prefixes(path):
            meta = PK.shard_meta(prefix, {})
            index = meta["ranges"]
            assert len(index["edit_types"]) == -(-meta["n"] // index["records"])
            with open(prefix.removeprefix("file:") + "_prompts.json") as f:
                assert len(json.load(f)) == meta["n"]  # still a plain JSON array


def test_filters_prune_ranges(pushed, scratch):
    spark, path = pushed, scratch + "/p"
    PK.write_packed_pairs(rows(spark), path, shards=2)
    everything = PK.read_packed_pairs(spark, path, 512)
    parts = everything.rdd.getNumPartitions()
    assert parts == 10
    adds = everything.where("edit_type = 'add'")
    assert adds.rdd.getNumPartitions() == 2  # 1,000 of 5,000 rows, in the first shard
    assert "Filter (" not in adds._jdf.queryExecution().executedPlan().toString().replace("IsNotNull", "")
    assert sorted(map(key, adds.collect())) == sorted(key(r) for r in everything.collect() if r.edit_type == "add")
    some = everything.where(F.col("edit_type").isin("remove", 'a"b,é') & F.col("row").between(2400, 2450))
    assert some.rdd.getNumPartitions() <= 2 and {r.row for r in some.collect()} == set(range(2400, 2451))
    assert everything.where("row in (3, 600) and edit_type = 'add'").count() == 2
    assert everything.where("edit_type is null").count() == 1000  # left to Spark
    assert everything.where("edit_type = 'no such type'").count() == 0
    prefix = PK.find_prefixes(path)[0]
    assert everything.where(F.col("prefix") == prefix).rdd.getNumPartitions() == 5
    assert everything.where("length(instruction) > 0 and edit_type = 'add'").count() == 1000 - 91 + 0


def test_without_pushdown_and_without_index(spark, scratch):
    path = scratch + "/q"
    PK.write_packed_pairs(rows(spark, 700), path, shards=1)
    prefix = PK.find_prefixes(path)[0]
    assert PK.read_packed_pairs(spark, path, 100).where("edit_type = 'add'").count() == 140
    meta = json.load(open(prefix + "_meta.json"))
    del meta["ranges"]
    json.dump(meta, open(prefix + "_meta.json", "w"))
    os.remove(path + "/" + PK.MANIFEST)  # as written elsewhere
    plain = PK.read_packed_pairs(spark, path, 100)
    assert plain.rdd.getNumPartitions() == 7
    assert sorted(((bytes(r.before), bytes(r.after), r.instruction, r.edit_type) for r in plain.collect()), key=repr) == want(spark, 700)
    os.remove(prefix + "_types.json")
    assert {r.edit_type for r in PK.read_packed_pairs(spark, path).collect()} == {None}
    assert PK.read_packed_pairs(spark, scratch + "/nothing").count() == 0


def test_vectors_round_trip(spark, scratch):
    path = scratch + "/v"
    PK.write_packed_pairs(rows(spark, 1500, vectors=True), path, shards=2)
    back = PK.read_vectors(spark, path, 256)
    assert back.columns == ["prefix", "row", "vectors"] and back.rdd.getNumPartitions() > 2
    both = PK.read_packed_pairs(spark, path, vectors=True).collect()
    numbers = {(bytes(r.before)): r.row_id for r in rows(spark, 1500).collect()}
    for r in both:
        k = float(numbers[bytes(r.before)])
        assert r.vectors == [[k, k + 1, k + 2], [-k, k / 2, 0.0]]
    assert sorted(r.vectors[0][0] for r in back.collect()) == [float(k) for k in range(1500)]
    PK.write_packed_pairs(rows(spark, 300), path, shards=1)  # a shard without vectors beside them
    assert back.where("vectors is null").count() == 0 and PK.read_vectors(spark, path).where("vectors is null").count() == 300
    ragged = rows(spark, 300, vectors=True).withColumn("vectors", F.when(F.col("row_id") == 7, F.slice("vectors", 1, 1)).otherwise(F.col("vectors")))
    with pytest.raises(Exception, match="one shape"):
        PK.write_packed_pairs(ragged, path, shards=1)
    assert PK.read_packed_pairs(spark, path).count() == 1800


def encoders():
    """Made here so that workers get them by value."""
    class Lengths:
        def __init__(self, scale):
            self.scale = scale

        def encode(self, texts):
            return np.array([[[self.scale * len(t), 1.0]] for t in texts], np.float32).reshape(len(texts), 1, 2)

    class Broken(Lengths):
        def encode(self, texts):
            if any("640" in t for t in texts):
                raise RuntimeError("encoder broke")
            return super().encode(texts)

    return Lengths, Broken


def test_reencode_publishes_at_once(spark, scratch):
    Lengths, Broken = encoders()
    path = scratch + "/r"
    PK.write_packed_pairs(rows(spark, 1200), path, shards=3)
    assert PK.read_vectors(spark, path).where("vectors is not null").count() == 0
    PK.reencode_vectors(spark, path, lambda: Lengths(1), encoder="one")
    check = lambda scale: all(r.vectors == [[scale * len(r.instruction), 1.0]]
                              for r in PK.read_packed_pairs(spark, path, vectors=True).collect())
    assert check(1)
    before = sorted(os.listdir(path))
    with pytest.raises(Exception, match="encoder broke"):
        PK.reencode_vectors(spark, path, lambda: Broken(3))
    assert check(1) and {o["encoder"] for _, o in PK.find_shards(path)} == {"one"}  # the old version stays readable
    PK.reencode_vectors(spark, path, lambda: Lengths(2), encoder="two")
    assert check(2) and {o["encoder"] for _, o in PK.find_shards(path)} == {"two"}
    assert not set(n for n in before if n.endswith("_text.bin")) & set(os.listdir(path))  # replaced vectors are gone
    assert PK.read_packed_pairs(spark, path).count() == 1200
    prefix = PK.find_prefixes(path)[0]
    meta = json.load(open(prefix + "_meta.json"))
    meta["n"] += 1
    json.dump(meta, open(prefix + "_meta.json", "w"))
    with pytest.raises(Exception, match="n="):
        PK.reencode_vectors(spark, path, lambda: Lengths(5))


def test_damaged_values_fail_the_write(spark, scratch):
    for column, value in (("before", F.lit(None).cast("binary")), ("after", F.lit(b"x")), ("res", F.lit(9)), ("res", F.lit(None).cast("int"))):
        bad = rows(spark, 200).withColumn(column, F.when(F.col("row_id") == 5, value).otherwise(F.col(column)))
        with pytest.raises(Exception, match="px shard"):
            PK.write_packed_pairs(bad, scratch + "/d", shards=1)
    assert PK.read_packed_pairs(spark, scratch + "/d").count() == 0


def test_partitions_do_not_grow_with_the_files(spark, scratch):
    path = scratch + "/g"
    PK.write_packed_pairs(rows(spark, 5000, vectors=True), path, shards=2)
    for records, most in ((1, 2 * PK.MOST_PARTITIONS), (3, 2 * PK.MOST_PARTITIONS), (512, 10), (1100, 6)):
        reader = PK.PackedReader({"path": path, "recordsPerPartition": str(records), "vectors": "true"})
        parts = reader.partitions()
        assert len(parts) <= most
        batches = [b for p in parts for b in reader.read(p)]
        assert max(b.num_rows for b in batches) <= records  # what is read at once stays the same
        got = sorted(((r["before"], r["after"], r["instruction"], r["edit_type"]) for b in batches for r in b.to_pylist()), key=repr)
        assert got == want(spark)
        assert sorted(v[0][0] for b in batches for v in b.column("vectors").to_pylist()) == list(range(5000))
    reader = PK.PackedReader({"path": path, "recordsPerPartition": "3"})
    reader.types, reader.low, reader.high = {"add"}, 100, 900
    assert all(r["edit_type"] == "add" and 100 <= r["row"] <= 900 for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist())
