"""Session construction and the few cluster-level settings the library relies on."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every job of the library expects. AQE re-plans joins from runtime
# sizes, coalesces small shuffle partitions and splits skewed ones; none of
# these change results.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, app: str = "seekspark",
              shuffle_partitions: int | None = None,
              extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the library defaults.

    On a cluster leave ``master`` as None so spark-submit decides; tests pass
    ``local[*]`` and a small shuffle partition count.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if master and master.startswith("local"):
        conf.setdefault("spark.driver.memory", "10g")
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    A cluster names it; only in local mode, where driver and executors are
    one process, a scratch folder is made here if it is unset. Elsewhere that
    is an error: a folder of one machine would be lost to all others.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        d = tempfile.mkdtemp(prefix="seekspark-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(d)
    return d


def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def has_table(spark: SparkSession, path: str) -> bool:
    """Whether a Spark job has written data files under ``path``, on any file
    system. Errors of the store are raised, not taken for an absent table."""
    fs, p = _file_system(spark, path)
    return fs.exists(p) and fs.getContentSummary(p).getFileCount() > 0


def is_complete(spark: SparkSession, path: str) -> bool:
    """Whether the job that wrote ``path`` came to its end: Spark then leaves a mark there."""
    fs, p = _file_system(spark, f"{path}/_SUCCESS")
    return fs.exists(p)


def drop_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder of intermediate tables that nothing reads any more."""
    fs, p = _file_system(spark, path)
    fs.delete(p, True)


def table_stamp(spark: SparkSession, path: str) -> tuple:
    """Changes when a table is written again: newest modification time of the
    folder, its bytes and its files."""
    fs, p = _file_system(spark, path)
    size = fs.getContentSummary(p)
    return fs.getFileStatus(p).getModificationTime(), size.getLength(), size.getFileCount()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the shared checkpoint folder for intermediate tables."""
    return os.path.join(checkpoint_dir(spark), name)
