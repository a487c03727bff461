"""Changes and stock with no side that fits a broadcast, and batches whose keys repeat or stand for several rows."""

from __future__ import annotations

import datetime as dt
from collections import Counter

import pytest
from pyspark.sql import functions as F

from shopfloor.operators import changes as X
from shopfloor.plans.joins import counted_side, sort_partitions


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _written(spark, monkeypatch):
    names = []
    for module in (X,):
        for fn in ("write_table", "write_counted", "sized_side"):
            real = getattr(module, fn)
            monkeypatch.setattr(module, fn, lambda df, name, real=real: (names.append(name), real(df, name))[1])
    return names


def test_counted_side_is_broadcast_by_its_rows_only(spark):
    df = spark.range(100)
    joined = lambda rows: _plan(spark.range(50).join(counted_side(df, rows), "id"))
    assert "BroadcastHashJoin" in joined(100)
    # Spark itself would broadcast so small a file; the counted rows forbid it
    assert "SortMergeJoin" in joined(10**7)


def test_sorted_partitions_follow_the_input(spark, monkeypatch):
    sizes = {1 << 20: 8, 64 << 30: 2048, 100 << 40: (100 << 40) // (512 << 20)}
    for size, want in sizes.items():
        monkeypatch.setattr("shopfloor.plans.joins.input_bytes", lambda _df, size=size: size)
        assert sort_partitions(spark.range(1)) == want


def _status(spark):
    orders = spark.createDataFrame([(i, ["Pending", "Submitted", "Shipped"][i % 3], None) for i in range(9)], "id long, status string, shippeddate timestamp_ntz")
    lines = spark.createDataFrame([(i, i % 3) for i in range(9)], "id long, order_id long")
    asked = spark.createDataFrame([(i, "Submitted" if i % 3 == 0 else "Completed") for i in range(12)], "id long, new_status string")
    return orders, lines, asked


@pytest.mark.parametrize("limit", ["10485760", "64"])
def test_status_rejects_need_neither_snapshot_nor_broadcast(spark, monkeypatch, limit):
    orders, lines, asked = _status(spark)
    names = _written(spark, monkeypatch)
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    try:
        change = X.apply_status(orders, lines, asked, dt.date(1998, 1, 1))
        reasons = {r.id: r.reason for r in change.rejects.collect()}
        states = {r.id: r.status for r in change.orders.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert "status_changes" not in names
    assert reasons == {3: "order has no lines", 6: "order has no lines", 1: "not allowed: Submitted -> Completed", 4: "not allowed: Submitted -> Completed",
                       7: "not allowed: Submitted -> Completed", 9: "unknown order", 10: "unknown order", 11: "unknown order"}
    assert states == {0: "Submitted", 1: "Submitted", 2: "Completed", 3: "Pending", 4: "Submitted", 5: "Completed", 6: "Pending", 7: "Submitted", 8: "Completed"}


def test_price_adds_are_written_once_and_judged_by_pair(spark, monkeypatch):
    prices = spark.createDataFrame([(1, 1, 5.0), (2, None, 5.0)], "item_id long, country_id int, retailprice double")
    items = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (3, "c")], "id long, sku string")
    adds = [("a", 1, 1.0, 1), ("a", 2, 9.0, 2), ("a", 2, 8.0, 2), ("a", 2, 1.0, 3), ("b", None, 4.0, 1), ("c", 1, 2.0, 1), ("c", 1, 2.0, 1), ("z", 1, 1.0, 1), ("z", 1, 1.0, 1), (None, 1, 1.0, 1)]
    names = _written(spark, monkeypatch)
    change = X.add_prices(prices, items, spark.createDataFrame(adds, "sku string, country_id int, retailprice double, seq long"))
    assert names == ["price_adds_checked"]
    assert Counter(map(tuple, change.prices.collect())) == Counter([(1, 1, 5.0), (2, None, 5.0), (1, 2, 8.0), (2, None, 4.0), (3, 1, 2.0), (3, 1, 2.0)])
    assert Counter(map(tuple, change.rejects.collect())) == Counter(
        [("a", 1, 1.0, "already priced"), ("a", 2, 9.0, "repeated in the batch"), ("a", 2, 1.0, "repeated in the batch")]
        + [("c", 1, 2.0, "repeated in the batch")] * 2 + [("z", 1, 1.0, "unknown sku")] * 2 + [(None, 1, 1.0, "unknown sku")]
    )


def test_store_requests_are_not_repeated_for_stores_of_one_name(spark, monkeypatch):
    n = 40
    stores = spark.createDataFrame([(i, "Same", i) for i in range(n)] + [(99, "Bare", 99)], "id long, name string, warehouse_id long")
    bins = spark.createDataFrame([(i, "Outbound", i) for i in range(n)], "id long, type string, warehouse_id long")
    items = spark.createDataFrame([(1, "a"), (2, "b")], "id long, sku string")
    lines = spark.createDataFrame([(1, 1, 7, None, 3), (2, 1, 7, None, 5), (3, 1, 7, None, None)], "id long, item_id long, quantity long, order_id long, bin_id long")
    asked = [("Same", "a", 10, 1), ("Same", "a", 20, 2), ("Same", "b", 30, 1), ("Bare", "a", 40, 1), ("Same", "z", 50, 1), ("None", "z", 60, 1)]
    names = _written(spark, monkeypatch)
    change = X.set_store_quantity(lines, stores, bins, items, spark.createDataFrame(asked, "store_name string, sku string, quantity long, seq long"))
    got = {(r.quantity, r.reason) for r in change.rejects.collect()}
    assert names == ["store_requests"]
    assert got == {(30, "no line of the item"), (40, "no outbound bin"), (50, "unknown sku"), (60, "unknown store")}
    assert {r.id: r.quantity for r in change.lines.collect()} == {1: 20, 2: 20, 3: 7}


@pytest.mark.parametrize("mode", ["set", "add"])
def test_line_changes_write_their_batch_and_what_is_open(spark, monkeypatch, mode):
    orders = spark.createDataFrame([(1, "Pending"), (2, "Shipped"), (3, None), (2, "Pending")], "id long, status string")
    lines = spark.createDataFrame([(i, 1, 5, [1, 2, 3, 4, None][i], None) for i in range(5)], "id long, item_id long, quantity long, order_id long, bin_id long")
    asked = spark.createDataFrame([(i, q) for i in range(7) for q in (1, 2)], "id long, quantity long")
    names = _written(spark, monkeypatch)
    got = {r.id: r.quantity for r in X.update_line_quantity(lines, asked, mode, orders).collect()}
    new = {"set": 2, "add": 8}[mode]
    assert got == {0: new, 1: 5, 2: 5, 3: new, 4: new}
    assert len(names) == 2


def test_lines_are_sorted_without_derived_columns(spark, monkeypatch, tmp_path):
    from shopfloor.plans import ids
    from shopfloor.sources.fixtures import RetailTables

    cols = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
    day = dt.datetime(1996, 1, 1)
    rows = [(2, 7, 3, 1, 4.0, 1.0, 0.0, 0.0, "N", "O", day), (1, 8, 4, 2, 5.0, 1.0, 0.0, 0.0, "N", "F", day), (1, 8, 4, 1, None, 1.0, 0.0, 0.0, "N", None, day)]
    spark.createDataFrame(rows, cols).write.parquet(f"{tmp_path}/lineitem.parquet")
    seen, real = [], ids.sort_partitions
    monkeypatch.setattr(ids, "sort_partitions", lambda df: (seen.append(set(df.columns)), real(df))[1])
    got = sorted(map(tuple, RetailTables(spark, str(tmp_path)).line.collect()))
    assert seen == [{c.split()[0] for c in cols.split(", ")}]
    assert got == [(1, 8, None, 1, 8), (2, 8, 5, 1, 8), (3, 7, 4, 2, 7)]


def test_warehouse_stock_moves_no_line_twice(spark, tmp_path):
    from types import SimpleNamespace

    from shopfloor.operators import stock as S

    lines = spark.createDataFrame([(1, 1, 2), (1, 1, 3), (2, 1, 4), (3, 1, 5), (None, 1, 6), (1, None, 7)], "bin_id long, item_id long, quantity long")
    bins = spark.createDataFrame([(1, "Outbound", 10), (2, "Inbound", 10), (3, "Outbound", 11)], "id long, type string, warehouse_id long")
    t = SimpleNamespace(line=lines, storagebin=bins, warehouse=spark.createDataFrame([(10,)], "id long"))
    stock = S.warehouse_item_stock(t)
    assert {tuple(r) for r in stock.collect()} == {(10, 1, 5), (10, None, 7)}
    assert stock._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1
