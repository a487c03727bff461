"""Session helpers: local test sessions and the shared checkpoint folder."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import SparkSession

# Settings every session of this library wants, local or cluster.
SQL_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def local_session(cores: int = 8, shuffle_partitions: int | None = None) -> SparkSession:
    """A local session for tests and the bench (no UI, UTC, AQE on)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("shopfloor")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cores))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in SQL_DEFAULTS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder of the session.

    On a cluster ``spark.checkpoint.dir`` names a folder every executor can
    reach; it is read from the session and used as is (and required).  Only a
    local session without it (tests) gets a private scratch folder.
    """
    try:
        named = spark.conf.get("spark.checkpoint.dir", None)
    except Exception:  # noqa: BLE001
        named = None
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001  (remote sessions have no local context)
        if not named:
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the whole cluster") from None
        return named
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    path = named or sc.getConf().get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", str(sc.master)):
            # a machine-local folder is not reachable by other executors, and is
            # lost with its machine: a cluster must name a shared folder
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the whole cluster")
        path = tempfile.mkdtemp(prefix="shopfloor-ckpt-")
    sc.setCheckpointDir(path)
    return sc._jsc.sc().getCheckpointDir().get()


def cluster_conf(input_bytes: int, total_cores: int) -> dict[str, str]:
    """Settings for a cluster run over ``input_bytes`` of parquet with ``total_cores`` task slots.

    * Scan splits: input / 100,000, kept within 256 MB .. 2 GB, so a 100 TB
      scan runs as about 100,000 map tasks of 1 GB.
    * Shuffle partitions: input / 2 GB, at least three waves of tasks for the
      cores (50,000 for 100 TB).  Map tasks x reduce partitions is the number
      of shuffle blocks to track and fetch, so splits grow with the input.
    * AQE merges small shuffle partitions toward 256 MB, splits a partition
      five times the median and above 256 MB (skew), and may turn a
      sort-merge join into a broadcast join from measured sizes.
    """
    mb, gb = 1 << 20, 1 << 30
    split = min(2 * gb, max(256 * mb, input_bytes // 100_000))
    shuffle = max(3 * total_cores, -(-input_bytes // (2 * gb)))
    return {
        **SQL_DEFAULTS,
        "spark.sql.files.maxPartitionBytes": str(split),
        "spark.sql.shuffle.partitions": str(shuffle),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(256 * mb),
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(256 * mb),
        "spark.sql.autoBroadcastJoinThreshold": str(64 * mb),
    }
