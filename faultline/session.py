"""Spark session and shared-storage helpers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every job in this package assumes: UTC dates (the reference truncates
# commit instants to UTC dates), AQE for runtime join/skew decisions, Arrow for
# the few pandas-backed operators.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # Reliable RDD checkpoints are removed once their RDD is garbage collected.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_spark(master: str | None = None, app: str = "faultline",
              shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    """Return (or create) a session configured for this package.

    On a cluster the master and resources come from spark-submit; ``master`` is
    only for local runs and tests.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(BASE_CONF)
    if master and master.startswith("local"):
        conf["spark.driver.memory"] = "12g"  # local mode: the driver JVM runs the executors too
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's shared ``spark.checkpoint.dir``.

    Only when it is unset *and* Spark runs in local mode (tests, laptop) is a
    scratch folder created; a cluster without the setting is an error, because
    a machine-local folder does not survive executor loss.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="faultline-ckpt-", dir=os.environ.get("TMPDIR", "/tmp")))
        return sc.getCheckpointDir()
    raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")


#: Called with (name, DataFrame) for every stage that is stored (plan reports).
on_store = None


def materialize(df, name: str, run: str | None = None):
    """Write ``df`` as a Parquet table under the shared checkpoint folder and
    read it back: lineage is cut, the data survives executor loss, and the
    planner gets real file sizes (so small tables are broadcast by plan, not
    by chance) plus column pruning and filter pushdown on re-reads."""
    spark = df.sparkSession
    root = ensure_checkpoint_dir(spark).rstrip("/")
    folder = f"{root}/tables/{run or uuid.uuid4().hex}"
    path = f"{folder}/{name}"
    if on_store is not None:
        on_store(name, df)
    df.write.mode("overwrite").parquet(path)
    _remove_at_exit(spark, folder)
    return spark.read.parquet(path)


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path under the shared checkpoint folder, removed when the driver ends."""
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(where)
    _remove_at_exit(spark, folder)
    return f"{folder}/{name}"


def _remove_at_exit(spark: SparkSession, path: str) -> None:
    """Hadoop removes ``path`` when the driver ends: results may be read lazily
    until then, and no folder of stored stages is left behind after it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
