"""Session helpers: local sessions for tests and the bench, and the shared
checkpoint folder used to cut long lineages."""

from __future__ import annotations

import contextlib
import os
import tempfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"  # known to Spark 4.1 and later


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "editlake") -> SparkSession:
    """A local session configured like the tests and the bench expect."""
    spark = (SparkSession.builder
             .master(f"local[{cores}]")
             .appName(app)
             .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
             .config("spark.sql.adaptive.enabled", "true")
             .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
             .config("spark.sql.adaptive.skewJoin.enabled", "true")
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.sql.execution.arrow.pyspark.enabled", "true")
             .config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .config("spark.driver.memory", os.environ.get("EDITLAKE_DRIVER_MEMORY", "4g"))
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder (``spark.checkpoint.dir``).

    On a cluster this is set by the deployment and is used as given; there an
    unset folder is an error, because executors do not see the driver's disk.
    Only a local session (tests) gets a fresh scratch folder.
    """
    sc = spark.sparkContext
    configured = spark.conf.get(CHECKPOINT_CONF, None) or sc.getConf().get(CHECKPOINT_CONF, None)
    if configured:
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            sc.setCheckpointDir(configured)
        return configured
    if not sc.master.split("[")[0] == "local":
        raise ValueError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="editlake-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    spark.conf.set(CHECKPOINT_CONF, path)
    sc.setCheckpointDir(path)
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared folder (survives executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextlib.contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of a query that runs inside go when it ends, not when the
    driver happens to collect its garbage. For writes that follow each other."""
    was = spark.conf.get(CLEANUP_CONF, None)
    spark.conf.set(CLEANUP_CONF, "true")
    try:
        yield
    finally:
        if was is None:
            spark.conf.unset(CLEANUP_CONF)
        else:
            spark.conf.set(CLEANUP_CONF, was)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-repartition on ``keys`` when the scan gives fewer partitions than
    the cluster can run at once (one big row group is one task), so that
    expensive per-row work that follows runs on all cores.

    Nothing is persisted: filters that Catalyst pushes below the exchange reach
    the scan. Hashing on a key (not round-robin) keeps the placement the same
    on retries.
    """
    want = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= want:
        return df
    return df.repartition(want, *keys) if keys else df.repartition(want)


def ship_package(spark: SparkSession) -> None:
    """Give the Python workers this package (``addPyFile``), once per session.

    Kernels are sent to workers by reference, so workers must be able to
    import ``editlake``. A cluster where it is installed is left alone through
    ``spark.editlake.installed=true``.
    """
    sc = spark.sparkContext
    if getattr(sc, "_editlake_shipped", False) or spark.conf.get("spark.editlake.installed", "false") == "true":
        return
    import zipfile
    package = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="editlake-ship-"), "editlake.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(package)))
    sc.addPyFile(path)
    sc._editlake_shipped = True
