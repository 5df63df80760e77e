"""Pools, sampling shares and determinism."""
import math

from pyspark.sql import functions as F

from editlake import fixtures as fx
from editlake.operators import assemble as AS

SF = "/root/testdata/sf0.01"


def test_pools_dense_positions(spark):
    pools = AS.build_pools(fx.pairs(spark, SF).where("decodable"), "train")
    bad = (pools.groupBy("pool_id").agg(F.count("*").alias("n"), F.max("pos").alias("mx"),
                                        F.min("pos").alias("mn"), F.max("pool_size").alias("sz"))
           .where("n != sz or mx != n - 1 or mn != 0"))
    assert bad.count() == 0
    assert pools.where("pool_id >= 0").groupBy("pool_id").count().where("count < 50").count() == 0


def test_mixture_shares_within_3_sigma(spark):
    pools = AS.build_pools(fx.pairs(spark, SF).where("decodable"), "train")
    n = 20000
    draws = AS.mixture_sample(pools, n, seed=11, synthetic_share=0.25)
    assert draws.count() == n
    syn = draws.where(F.col("type_id").isin(*AS.SYNTH_IDS)).count()
    sd = math.sqrt(n * 0.25 * 0.75)
    assert abs(syn - 0.25 * n) < 3 * sd
    # same seed, same draws (partition-independent)
    again = AS.mixture_sample(pools.repartition(3), n, seed=11, synthetic_share=0.25)
    assert sorted(draws.collect()) == sorted(again.collect())


def test_dropout_all_four_combinations(spark):
    d = spark.range(4000).withColumnRenamed("id", "draw_id").withColumn("type_id", F.lit(5).cast("bigint"))
    out = AS.cond_dropout(d, 3, 0.3, 0.3)
    combos = {(r.type_dropped, r.image_dropped) for r in out.select("type_dropped", "image_dropped").distinct().collect()}
    assert combos == {(True, True), (True, False), (False, True), (False, False)}


def test_materialize_examples_content(spark):
    import numpy as np

    from editlake import taxonomy as tx
    from editlake.operators import images as IM
    rng = np.random.default_rng(9)
    imgs = {i: rng.integers(0, 256, (3, 8, 8), dtype=np.uint8) for i in range(4)}
    corpus = spark.createDataFrame(
        [(i, bytearray(imgs[i].tobytes()), bytearray(imgs[(i + 1) % 4].tobytes()), 8, 0) for i in range(4)]
        + [(i, bytearray(bytes(192)), bytearray(bytes(192)), 8, 1) for i in range(4)],  # the same ids in another shard
        "row_id bigint, px binary, after_px binary, res int, shard bigint")
    inv, tune = tx.TYPE_ID["inverted"], tx.TYPE_ID["season_winter"]
    draws = spark.createDataFrame(
        [(0, 0, inv, inv, False, False), (1, 1, inv, inv, True, False),
         (2, 2, tune, tune, False, True), (3, 3, 0, tune, True, False)],
        "draw_id bigint, row_id bigint, type_id bigint, type_in bigint, flipped boolean, image_dropped boolean").withColumn(
        "shard", F.lit(0).cast("bigint"))
    out = {r.draw_id: r for r in AS.materialize_examples(draws, corpus).collect()}
    exact = lambda a: IM.stored_u8(IM.EDITS["inverted"](IM.normalize_u8(a)[None]))[0]
    assert bytes(out[0].after) == exact(imgs[0]).tobytes() and bytes(out[0].before) == imgs[0].tobytes()
    assert bytes(out[1].before) == imgs[1][..., ::-1].tobytes()
    assert bytes(out[1].after) == exact(imgs[1])[..., ::-1].tobytes()
    assert len(out) == 4
    assert exact(exact(imgs[0])).tobytes() == imgs[0].tobytes()  # stored rounded: inverting twice changes nothing
    assert bytes(out[2].before) == bytes([AS.GREY]) * 192 and bytes(out[2].after) == imgs[3].tobytes()
    assert out[3].type_id == 0 and bytes(out[3].after) == imgs[0][..., ::-1].tobytes()


def test_hashed_encoder_whole_text():
    import numpy as np

    from editlake.operators.vectors import HashedTokenEncoder
    enc = HashedTokenEncoder(dim=16, seq_len=4)
    texts = ["add a hat", "", None, "one two three four five six"]
    out = enc.encode(texts)
    assert out.shape == (4, 4, 16)
    np.testing.assert_allclose(out[0, 0], enc.token_vector("add") + enc.position[0], rtol=1e-6)
    assert np.all(out[0, 3] == 0) and np.all(out[1] == 0) and np.all(out[2] == 0)
    # tokens past the head are averaged into the last slot, not dropped
    rest = np.mean([enc.token_vector(t) for t in ["four", "five", "six"]], axis=0)
    np.testing.assert_allclose(out[3, 3], rest + enc.position[3], rtol=1e-5)
