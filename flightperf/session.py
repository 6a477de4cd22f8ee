"""Session helpers: one place for the configuration the engine expects."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings that matter for correctness or plan shape (not for tuning one machine).
ENGINE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # flight_date comes from timestamps in some inputs; pin the zone for reproducible dates
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.filterPushdown": "true",
}


def cluster_conf(total_cores: int, input_bytes: int) -> dict[str, str]:
    """Suggested settings for a cluster run, sized from the cores and the raw input size.

    Of 109 text columns 16 are shuffled at most, about an eighth of the raw bytes. Shuffle
    partitions start at one per 256 MB of that (at least 2 waves of tasks), which keeps the
    number of shuffle blocks (input splits x partitions) in check at 100 TB; AQE coalesces the
    small ones and splits skewed ones at run time. Input splits of 256 MB keep file-open
    overhead low on very large scans.
    """
    parts = max(2 * total_cores, input_bytes // 8 // (256 << 20))
    return {
        "spark.sql.shuffle.partitions": str(int(parts)),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(128 << 20),
        "spark.sql.files.maxPartitionBytes": str(256 << 20),
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
    }


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "flightperf", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the engine settings.

    On a cluster, ``master`` stays None so spark-submit decides. Tests pass ``local[*]``.
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
        b = b.config("spark.ui.enabled", "false")
        b = b.config("spark.ui.showConsoleProgress", "false")
        b = b.config("spark.driver.memory", os.environ.get("FLIGHTPERF_DRIVER_MEM", "8g"))
    for k, v in ENGINE_CONF.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the cluster.

    ``spark.checkpoint.dir`` is read from the session; only when nothing is set
    (a local test run) is a private folder created and registered.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir()
    if d:
        return d
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not sc.master.startswith("local"):
            # a machine-local folder is not visible to other executors
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
        d = tempfile.mkdtemp(prefix="flightperf-ckpt-")
    sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique folder under the shared checkpoint folder for written tables.

    Tables written here cut lineage and survive executor loss; the folder is never reused.
    """
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/flightperf/{name}-{uuid.uuid4().hex[:12]}"
