"""SparkSession construction and the few settings every plan relies on."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings the operators depend on for correct results (time zone, ANSI arithmetic)
# and for an adaptive physical plan (AQE coalescing / skew handling).
REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def build_session(master: str | None = None, app: str = "coldlake", shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    """Create (or get) a session with the required settings.

    On a cluster ``master`` stays None and the launcher decides; tests pass ``local[*]``.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(REQUIRED_CONF)
    conf["spark.ui.enabled"] = "false"
    # no call site per column expression: building a report's plan takes a third of the time
    conf["spark.python.sql.dataFrameDebugging.enabled"] = "false"
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    for k, v in REQUIRED_CONF.items():
        spark.conf.set(k, v)
    ensure_checkpoint_dir(spark)
    return spark


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, extra: dict | None = None) -> SparkSession:
    conf = {
        "spark.driver.memory": "8g",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.warehouse.dir": os.path.join(os.environ.get("COLDLAKE_SCRATCH", "/tmp"), "coldlake-warehouse"),
    }
    conf.update(extra or {})
    spark = build_session(f"local[{cores}]", shuffle_partitions=shuffle_partitions, extra=conf)
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str | None:
    """The shared folder the cluster names in spark.checkpoint.dir (None if unset)."""
    d = spark.sparkContext.getCheckpointDir()
    if d:
        return d
    return spark.sparkContext.getConf().get("spark.checkpoint.dir", None)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the configured checkpoint folder; only a local test session gets its own."""
    d = spark.sparkContext.getCheckpointDir()
    if d:
        return d
    d = checkpoint_dir(spark)
    if d is None:
        master = spark.sparkContext.master
        if not master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        d = tempfile.mkdtemp(prefix="coldlake-ckpt-", dir=os.environ.get("COLDLAKE_SCRATCH", "/tmp"))
    spark.sparkContext.setCheckpointDir(d)
    return d
