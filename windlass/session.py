"""Session helpers: one place for the settings every job in the package relies on."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Settings the library needs for correct results (UTC, zone-less timestamps) and for
# runtime re-planning at scale (AQE: partition coalescing, skew-join splitting).
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8, app: str = "windlass",
                  extra: dict | None = None) -> SparkSession:
    """Local session for tests and the benchmark. On a cluster use the cluster's session."""
    builder = SparkSession.builder.master(master).appName(app)
    conf = dict(BASE_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf["spark.driver.memory"] = "8g"
    conf.update(extra or {})
    if "spark.checkpoint.dir" not in conf:
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        conf["spark.checkpoint.dir"] = tempfile.mkdtemp(
            prefix="windlass-ckpt-", dir=os.environ.get("WINDLASS_SCRATCH", "/tmp"))
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named in ``spark.checkpoint.dir``.

    On a cluster the folder is set by the cluster (a shared file system) and is only read here.
    Only when it is unset -- local tests and benchmarks -- a fresh scratch folder is registered.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir", None)
    if not current:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        current = tempfile.mkdtemp(prefix="windlass-ckpt-", dir=os.environ.get("WINDLASS_SCRATCH", "/tmp"))
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(current)
    return current


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (survives executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def wide_plan_mode(spark: SparkSession) -> None:
    """Wide plans (pivots and feature tables with hundreds of aliased columns under null filters) make Catalyst's constraint propagation
    grow combinatorially, up to the driver's memory; switching it off for the session only drops some inferred IS NOT NULL filters.
    It stays off: plans are optimized when they run, after the functions that build them have returned."""
    spark.conf.set("spark.sql.constraintPropagation.enabled", "false")


def pin_utc(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
