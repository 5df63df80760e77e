"""Session helpers: spread only acts on under-split inputs; the checkpoint
folder comes from the session when it is set."""
from editlake.session import CHECKPOINT_CONF, ensure_checkpoint_dir, spread


def test_spread_only_when_under_split(spark):
    want = spark.sparkContext.defaultParallelism
    wide = spark.range(0, 1000, numPartitions=want + 2)
    assert spread(wide, "id") is wide
    narrow = spark.range(0, 1000, numPartitions=1)
    out = spread(narrow, "id")
    assert out.rdd.getNumPartitions() == want and out.count() == 1000


def test_checkpoint_dir_read_from_session(spark):
    current = spark.conf.get(CHECKPOINT_CONF)
    assert ensure_checkpoint_dir(spark) == current
    df = spark.range(10).checkpoint()
    assert df.count() == 10
