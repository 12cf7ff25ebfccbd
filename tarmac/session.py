"""Session construction and shared-folder helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings a session built by this package always carries. AQE re-plans joins
# and shuffle sizes from runtime statistics and splits skewed join partitions;
# the UI is off because nothing here serves pages.
DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Checkpoint files of intermediate tables are removed once unreferenced.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(
    master: str | None = None,
    app_name: str = "tarmac",
    shuffle_partitions: int | None = None,
    extra_conf: dict[str, str] | None = None,
) -> SparkSession:
    """Create (or reuse) a session with the package defaults.

    ``master`` is only set when given, so on a cluster the launcher decides.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra_conf or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    sc = _context(spark)
    if sc is not None:
        sc.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def _context(spark: SparkSession):
    try:
        return spark.sparkContext
    except Exception:  # sessions without a local SparkContext handle
        return None


def checkpoint_dir(spark: SparkSession) -> str | None:
    """The shared folder the cluster names for checkpoints, if any."""
    sc = _context(spark)
    current = sc.getCheckpointDir() if sc is not None else None
    if current:
        return current
    return spark.conf.get("spark.checkpoint.dir", None) or None


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder the session names (``spark.checkpoint.dir``).

    Only a local-mode session without one (tests) gets a private temporary
    folder; on a cluster a machine-local folder would not survive the loss of
    that machine, so a missing setting is an error there."""
    found = checkpoint_dir(spark)
    sc = _context(spark)
    if found:
        if sc is not None and not sc.getCheckpointDir():
            sc.setCheckpointDir(found)
        return found
    master = spark.conf.get("spark.master", None) or (sc.master if sc is not None else "")
    if not str(master).startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set: name a shared folder (HDFS/object store) for checkpoints")
    local = tempfile.mkdtemp(prefix="tarmac-ckpt-")
    if sc is not None:
        sc.setCheckpointDir(local)
    else:
        spark.conf.set("spark.checkpoint.dir", local)
    return local


def run_folder(spark: SparkSession, label: str) -> str:
    """A new folder name under the shared checkpoint folder; what is written
    there goes when the session's JVM ends."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{label}/{uuid.uuid4().hex}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path

