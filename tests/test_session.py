"""Cluster sizing and broadcast-threshold parsing."""

from __future__ import annotations

from shopfloor.plans import joins as J
from shopfloor.session import cluster_conf, ensure_checkpoint_dir


def test_cluster_conf_bounds():
    big = cluster_conf(100 * 2**40, 8000)
    assert int(big["spark.sql.shuffle.partitions"]) == 51_200
    assert int(big["spark.sql.files.maxPartitionBytes"]) == 100 * 2**40 // 100_000
    small = cluster_conf(2**30, 8)
    assert int(small["spark.sql.shuffle.partitions"]) == 24  # three waves on 8 cores
    assert int(small["spark.sql.files.maxPartitionBytes"]) == 256 * 2**20
    assert small["spark.sql.adaptive.skewJoin.enabled"] == "true"


def test_broadcast_threshold_parsing(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    df = spark.range(1)
    try:
        for raw, want in [("10485760b", 10 << 20), ("20m", 20 << 20), ("1GB", 1 << 30), ("-1", 0)]:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", raw)
            assert J.broadcast_limit(df) == want
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        assert not J.is_small(df)  # broadcasting switched off: nothing is broadcast
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_checkpoint_folder_is_reused(spark):
    assert ensure_checkpoint_dir(spark) == ensure_checkpoint_dir(spark)
