"""Cart outcomes add by add, rejects of every update and removal, touched-row counts."""

from __future__ import annotations

import datetime as dt
import random
from collections import defaultdict

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from shopfloor.operators import changes as X
from shopfloor.operators import stock as S


def _brute(adds, stock):
    taken, out = defaultdict(int), {}
    for session, item, add_id, ts in sorted(adds, key=lambda r: (r[3] is not None, r[3] or dt.datetime.min, r[2])):
        known = None not in (session, item, ts)
        out[add_id] = known and taken[session, item] < (stock.get((session, item)) or 0)
        taken[session, item] += out[add_id]
    return out


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
@pytest.mark.parametrize("edge_rows", [1, 50, 4096])
def test_cart_outcomes(spark, kind, edge_rows):
    rng = random.Random(5)
    start = dt.datetime(2024, 3, 10, 0, 0)
    adds = [(1, 1, i, start + dt.timedelta(microseconds=rng.randrange(10**10))) for i in range(400)]  # a hot pair
    adds += [(2, 1, 1000 + i, start) for i in range(300)]  # a hot instant: ids decide
    adds += [(3, i % 5, 2000 + i, start + dt.timedelta(hours=rng.randrange(48))) for i in range(60)]
    adds += [(None, 1, 3000, start), (1, None, 3001, start), (1, 1, 3002, None), (9, 9, 3003, start)]
    stock = {(1, 1): 123, (2, 1): 77, (3, 0): 12, (3, 1): 3, (3, 2): 0, (3, 3): -4, (3, 4): None}
    df = spark.createDataFrame(adds, f"session long, item_id long, add_id long, ts {kind}").withColumn("extra", F.lit("x"))
    held = spark.createDataFrame([(*k, v) for k, v in stock.items()], "session long, item_id long, stock long")
    got = {r.add_id: r.accepted for r in S.cart_outcomes(df, held, edge_rows=edge_rows).collect()}
    assert got == _brute(adds, stock)
    assert S.cart_outcomes(df.limit(0), held).collect() == []


def test_outcomes_sum_to_the_fold(spark):
    rng = random.Random(6)
    start = dt.datetime(2024, 1, 1)
    adds = [(rng.randrange(5), rng.randrange(4), i, start + dt.timedelta(minutes=rng.randrange(30))) for i in range(300)]
    df = spark.createDataFrame(adds, "session long, item_id long, add_id long, ts timestamp_ntz")
    stock = spark.createDataFrame([(s, i, (s * 7 + i * 5) % 23) for s in range(5) for i in range(4)], "session long, item_id long, stock long")
    per_add = S.cart_outcomes(df, stock).groupBy("session", "item_id").agg(F.count_if("accepted").alias("accepted"))
    assert set(per_add.collect()) == set(S.cart_fold(df, stock).select("session", "item_id", "accepted").collect())


def _write(df):
    df.write.format("noop").mode("overwrite").save()


def _cases(spark):
    prices = spark.createDataFrame([(i, 1, 10.0 * i) for i in range(1, 21)], "item_id long, country_id long, retailprice double")
    asked = spark.createDataFrame([(i % 30, 1, float(i), i) for i in range(45)], "item_id long, country_id long, retailprice double, seq long")
    yield "prices", lambda o: X.update_prices(prices, asked, touched=o), lambda: X.update_prices_rejects(prices, asked), asked
    yield "remove prices", lambda o: X.remove_prices(prices, asked, touched=o), lambda: X.remove_prices_rejects(prices, asked), asked
    items = spark.createDataFrame([(i, "n", "c", "d") for i in range(20)], "id long, name string, category string, description string")
    renames = spark.createDataFrame([(i % 25, f"n{i}", "c", None, i) for i in range(40)], "id long, name string, category string, description string, seq long")
    yield "items", lambda o: X.update_items(items, renames, touched=o), lambda: X.update_items_rejects(items, renames), renames
    empty = prices.limit(0)
    yield "remove items", lambda o: X.remove_items(items, items.select("id"), empty, renames, touched=o).items, lambda: X.remove_items_rejects(items, renames), renames
    orders = spark.createDataFrame([(i, ["Pending", "Shipped", None][i % 3], i) for i in range(12)], "id long, status string, origin_id long")
    lines = spark.createDataFrame([(i, i % 4, 5, i % 14 if i % 5 else None, None) for i in range(40)], "id long, item_id long, quantity long, order_id long, bin_id long")
    caps = spark.createDataFrame([(i % 50, i, i) for i in range(70)], "id long, quantity long, seq long")
    plans = spark.createDataFrame([(i % 15, i, i) for i in range(25)] + [(None, 1, 1)], "id long, origin_id long, seq long")
    yield "lines", lambda o: X.update_line_quantity(lines, caps, orders=orders, touched=o), lambda: X.update_line_quantity_rejects(lines, caps, orders=orders), caps
    yield "remove lines", lambda o: X.remove_order_lines(lines, caps, orders, o), lambda: X.remove_order_lines_rejects(lines, caps, orders), caps
    yield "orders", lambda o: X.update_orders(orders, plans, touched=o), lambda: X.update_orders_rejects(orders, plans), plans
    states = plans.select("id", F.lit("Completed").alias("new_status"), "seq")
    yield "status", lambda o: X.set_status(orders, states, o), lambda: X.set_status_rejects(orders, states), states
    people = spark.createDataFrame([(f"m{i}", "n", "p") for i in range(9)], "email string, name string, phone string")
    moves = spark.createDataFrame([(f"m{i % 12}", f"x{i}", i) for i in range(20)], "email string, name string, seq long")
    yield "members", lambda o: X.update_members(people, moves, touched=o), lambda: X.update_profiles_rejects(people, moves), moves
    yield "staff", lambda o: X.update_staff(people, moves, touched=o), lambda: X.update_profiles_rejects(people, moves), moves


def test_touched_rows_and_rejects_are_the_batch(spark):
    for name, write, rejects, batch in _cases(spark):
        seen = Observation()
        _write(write(seen))
        assert seen.get["touched"] + rejects().count() == batch.count(), name
        assert seen.get["touched"] > 0, name
        assert sorted(map(str, write(None).collect())) == sorted(map(str, write(Observation()).collect())), name


def test_added_deltas_count_rows_not_requests(spark):
    lines = spark.createDataFrame([(1, 1, 5, None, None), (2, 1, 5, None, None)], "id long, item_id long, quantity long, order_id long, bin_id long")
    deltas = spark.createDataFrame([(1, 2), (1, 3), (7, 1)], "id long, quantity long")
    seen = Observation()
    _write(X.update_line_quantity(lines, deltas, mode="add", touched=seen))
    assert seen.get == {"touched": 1}


def test_lines_of_locked_orders_are_not_added(spark):
    orders = spark.createDataFrame([(1, "Pending"), (2, "Shipped"), (3, None)], "id long, status string")
    lines = spark.createDataFrame([(4, 1, 5, 1, None)], "id long, item_id long, quantity long, order_id long, bin_id long")
    new = spark.createDataFrame([(1, 1, 1), (1, 2, 2), (1, 3, 3), (1, 4, 9), (1, 5, None)], "item_id long, quantity long, order_id long")
    kept = X.append_lines(lines, new, ["quantity"], orders).filter("id > 4")
    assert [tuple(r) for r in kept.select("id", "quantity", "order_id").orderBy("id").collect()] == [(5, 1, 1), (6, 5, None)]
    rejects = {(r.quantity, r.reason) for r in X.append_lines_rejects(new, orders).collect()}
    assert rejects == {(2, "locked"), (3, "locked"), (4, "unknown")}
    assert X.append_lines(lines, new, ["quantity"]).count() == 6
