"""Plan checks: the physical plans have the shape the operators promise."""

from __future__ import annotations

import __spark_entry__ as E

from .conftest import SMALL


def _plan(spark, name: str) -> str:
    df = E.queries()[name](spark, SMALL)
    return df._jdf.queryExecution().executedPlan().toString()


def test_stock_prunes_columns_and_broadcasts_bins(spark):
    plan = _plan(spark, "item_stock")
    # the line table is read with only the columns the sum needs
    assert "ReadSchema: struct<item_id:bigint,quantity:bigint,bin_id:bigint>" in plan
    assert "partial_sum" in plan  # combined map-side before any shuffle
    assert "SortMergeJoin" not in plan


def test_receipt_does_not_shuffle_the_line_snapshot(spark):
    plan = _plan(spark, "receive_shipments")
    first_join = plan.split("\n")[3]
    assert "BroadcastHashJoin" in first_join and "LeftOuter" in first_join


def test_receipt_joins_the_line_snapshot_once_when_nothing_broadcasts(spark):
    from shopfloor import queries_changes

    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    queries_changes.reset()
    try:
        plan = _plan(spark, "receive_shipments")
        credited = plan.split("BroadcastNestedLoopJoin")[0].split("Union")[1]
        assert "BroadcastHashJoin" not in credited.split("_off")[0].split("SortMergeJoin")[0]
        joins = [x for x in plan.split("\n") if "SortMergeJoin" in x]
        assert len(joins) <= 2 and any("LeftOuter" in x and "id#" in x for x in joins)  # the credit, and new lines against holders
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        queries_changes.reset()


def test_first_row_rules_are_aggregates_not_windows(spark):
    for name in ("staff_roles", "first_inbound_bin", "cart_fold"):
        plan = _plan(spark, name)
        assert "Window" not in plan, name


def test_filters_reach_the_scan(spark):
    plan = _plan(spark, "active_promotions")
    pushed = [x for x in plan.split("PushedFilters: ")[1:] if "l_discount" in x.split("]")[0]]
    assert pushed and "GreaterThan(l_discount,0.085)" in pushed[0].split("]")[0]


def test_single_partition_only_for_partition_offsets(spark):
    # the only single-partition step is the running sum over per-partition counts
    for name in ("grid_sort", "add_items", "receive_shipments", "grid_page_rest", "grid_page_deep"):
        plan = _plan(spark, name)
        for line in plan.split("\n"):
            if "SinglePartition" in line:
                assert "_pid" in plan, name


def test_sized_side_broadcasts_only_within_the_threshold(spark):
    from shopfloor.plans.materialize import sized_side

    big = spark.range(0, 1000).withColumnRenamed("id", "k")
    small = sized_side(spark.range(0, 10).withColumnRenamed("id", "k"), "test_keys")
    plan = big.join(small, "k", "left_semi")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        small = sized_side(spark.range(0, 10).withColumnRenamed("id", "k"), "test_keys")
        plan = big.join(small, "k", "left_semi")._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastExchange" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_hot_bin_stock_is_exact(spark):
    """One bin holds a third of all lines; stock per store and item stays exact."""
    from pyspark.sql import functions as F

    from shopfloor.operators import stock as S
    from shopfloor.sources.fixtures import RetailTables

    n = 30_000
    lines = spark.range(0, n).select(
        F.col("id"),
        (F.col("id") % 50).alias("item_id"),
        (F.col("id") % 7 + 1).alias("quantity"),
        F.lit(None).cast("long").alias("order_id"),
        F.when(F.col("id") % 3 == 0, F.lit(1)).otherwise(F.col("id") % 40 * 2 + 1).alias("bin_id"),
    ).repartition(16)
    bins = spark.range(0, 40).select((F.col("id") * 2 + 1).alias("id"), F.lit("Outbound").alias("type"), F.col("id").alias("warehouse_id"))
    wh = spark.range(0, 40).select("id", F.lit("w").alias("warehousename"), F.lit(0).alias("country_id"))
    store = spark.range(0, 40).select("id", F.lit("s").alias("name"), F.lit(0).alias("country_id"), F.col("id").alias("warehouse_id"))
    items = spark.range(0, 50).select("id", F.concat(F.lit("K"), F.col("id").cast("string")).alias("sku"))
    t = RetailTables(spark, "/nonexistent")
    t.__dict__.update(line=lines, storagebin=bins, warehouse=wh, store=store, item=items)
    got = {(r.store_id, r.sku): r.stock for r in S.item_stock(t).collect()}
    want: dict = {}
    for i in range(n):
        b = 1 if i % 3 == 0 else (i % 40) * 2 + 1
        key = ((b - 1) // 2, f"K{i % 50}")
        want[key] = want.get(key, 0) + i % 7 + 1
    assert got == want
