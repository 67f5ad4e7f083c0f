"""Session construction and cluster-facing settings.

Everything here is plain Spark configuration.  On a cluster the settings come
from ``spark-defaults`` / ``spark-submit``; :func:`get_session` only fills in
what is unset, so it never overrides the cluster's choices.  The session time
zone is the cluster's own, too: naive timestamps do not depend on it.
"""

from __future__ import annotations

import os
import tempfile

from pyspark import SparkConf, SparkContext
from pyspark.sql import SparkSession

# Settings every job of this package relies on.  AQE re-plans joins from
# runtime sizes (broadcast only when the materialised side is small, fall back
# to sort-merge otherwise), coalesces tiny shuffle partitions and splits skewed
# ones.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    # on a large cluster coalesce to the advisory size, not to the default
    # parallelism (which would leave thousands of tiny reduce tasks)
    "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    "spark.sql.files.maxPartitionBytes": "128m",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_session(master: str | None = None, app: str = "farmspark",
                shuffle_partitions: int | None = None,
                extra: dict[str, str] | None = None) -> SparkSession:
    """Return the active session, creating one with :data:`DEFAULT_CONF`.

    ``master`` and ``shuffle_partitions`` are only meant for local runs and
    tests; on a cluster leave them ``None``.
    """
    active = SparkSession.getActiveSession()
    if active is not None:
        ensure_checkpoint_dir(active)
        return active
    # what spark-defaults and spark-submit have set stays.  A local run starts
    # its JVM with the settings below (driver memory among them), so there the
    # JVM's own settings cannot be asked first.
    if not master:
        SparkContext._ensure_initialized()
    given = SparkConf()
    conf = dict(DEFAULT_CONF)
    if master:
        # one machine: no web page (it would open a port), small data, every
        # core busy rather than 128 MB partitions, and times shown in UTC
        conf |= {"spark.master": master, "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC",
                 "spark.sql.adaptive.coalescePartitions.parallelismFirst": "true"}
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf |= extra or {}
    b = SparkSession.builder.appName(app)
    for k, v in conf.items():
        if not given.contains(k) or k in (extra or {}):
            b = b.config(k, v)
    spark = b.getOrCreate()
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    The cluster names a shared (HDFS / object store) folder there; we only set
    one ourselves when it is unset in a local run (tests).  On a cluster an
    unset folder is an error rather than a machine-local fallback.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            # a machine-local folder would not survive the loss of an executor
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        configured = tempfile.mkdtemp(prefix="farmspark-ckpt-")
        spark.conf.set("spark.checkpoint.dir", configured)
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint folder for derived tables."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, "farmspark", name)
