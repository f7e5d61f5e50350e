"""Session construction and the shared checkpoint folder."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import SparkSession

# Settings every job here relies on: adaptive execution (runtime broadcast
# conversion, partition coalescing, skew splitting) and ANSI arithmetic.
RECOMMENDED_CONF: dict[str, str] = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a hot key even where that costs one more shuffle
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "shelfmark", extra: dict[str, str] | None = None) -> SparkSession:
    """Local or cluster session with the settings above.

    On a cluster leave ``master`` as None; the launcher decides.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(RECOMMENDED_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster the folder must be set by whoever launches the job (a shared
    file system or object store). Only a local-mode session without the
    setting gets a private folder under the temp directory, as in tests.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder before running this job")
        configured = tempfile.mkdtemp(prefix="shelfmark-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", configured)
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A sub folder of the shared checkpoint folder for written intermediates."""
    base = checkpoint_dir(spark)
    return f"{base.rstrip('/')}/{name}"


def scale_conf(input_bytes: int, total_cores: int, partition_bytes: int = 256 * 1024 * 1024,
               shuffle_fraction: float = 0.125, max_shuffle_partitions: int = 50_000) -> dict[str, str]:
    """Settings sized to the input.

    Scan splits are ``partition_bytes``. Shuffle partitions are sized to the
    expected shuffle volume, not the input: after column pruning and map-side
    combining a shuffle carries a fraction of the scanned bytes
    (``shuffle_fraction``). The count is at least twice the cores and capped,
    because map tasks x reduce partitions shuffle blocks must stay
    manageable; AQE coalesces small stages and splits skewed partitions (three
    times the median and above the advisory size). Broadcast stays on Spark's
    size check (never forced).
    """
    wanted = -(-int(input_bytes * shuffle_fraction) // partition_bytes)
    parts = max(2 * total_cores, min(max_shuffle_partitions, wanted))
    return {
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(parts),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(partition_bytes),
        "spark.sql.files.maxPartitionBytes": str(partition_bytes),
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "3",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(partition_bytes),
        "spark.sql.autoBroadcastJoinThreshold": str(64 * 1024 * 1024),
    }
