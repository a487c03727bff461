"""Properties of the operators, on small generated tables."""

from __future__ import annotations

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shopfloor.operators import changes as W
from shopfloor.operators import grid as G

FEW = settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))

PRICE = "item_id long, country_id int, retailprice double"
ITEM = "id long, sku string, name string, category string, description string, dtype string, length int, width long, height long, isdeleted boolean"

pairs = st.lists(st.tuples(st.integers(1, 6), st.integers(1, 4)), min_size=0, max_size=12, unique=True)


def _rows(df, cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def _items(spark):
    return spark.createDataFrame(
        [(i, f"S{i}", "n", "c", "d", "FurnitureEntity", 1, 1, 1, False) for i in range(1, 7)], ITEM
    )


@FEW
@given(have=pairs, add=pairs)
def test_remove_after_add_restores_prices(spark, have, add):
    prices = spark.createDataFrame([(i, c, float(i * 10 + c)) for i, c in have], PRICE)
    adds = spark.createDataFrame([(f"S{i}", c, 1.5) for i, c in add], "sku string, country_id int, retailprice double")
    change = W.add_prices(prices, _items(spark), adds)
    added = change.prices
    assert added.count() + change.rejects.count() == len(have) + len(add)
    fresh = [(i, c) for i, c in add if (i, c) not in set(have)]
    keys = spark.createDataFrame(fresh, "item_id long, country_id int")
    back = W.remove_prices(added, keys)
    assert _rows(back, ["item_id", "country_id", "retailprice"]) == _rows(prices, ["item_id", "country_id", "retailprice"])


@FEW
@given(have=pairs)
def test_updates_without_keys_are_identity(spark, have):
    prices = spark.createDataFrame([(i, c, float(i) + 0.25) for i, c in have], PRICE)
    none = spark.createDataFrame([], PRICE)
    assert _rows(W.update_prices(prices, none), prices.columns) == _rows(prices, prices.columns)
    items = _items(spark)
    no_items = spark.createDataFrame([], "id long, name string, category string, description string")
    assert _rows(W.update_items(items, no_items), items.columns) == _rows(items, items.columns)
    lines = spark.createDataFrame([(i, 7, i * 2, None, 1) for i, _ in have], "id long, item_id long, quantity long, order_id long, bin_id long")
    no_lines = spark.createDataFrame([], "id long, quantity long")
    for mode in ("set", "add"):
        assert _rows(W.update_line_quantity(lines, no_lines, mode), lines.columns) == _rows(lines, lines.columns)


@FEW
@given(
    lines=st.lists(st.tuples(st.integers(1, 4), st.integers(1, 3), st.integers(1, 9)), min_size=1, max_size=10),
    status=st.lists(st.sampled_from(["Shipped", "Submitted", "Pending"]), min_size=3, max_size=3),
)
def test_receipt_adds_exactly_the_received_quantity(spark, lines, status):
    bins = spark.createDataFrame([(100, "Inbound", 10), (101, "Outbound", 10)], "id long, type string, warehouse_id long")
    orders = spark.createDataFrame([(50 + k, s, 10) for k, s in enumerate(status)], "id long, status string, destination_id long")
    # order lines sit elsewhere (bin 999); the inbound bin holds item 1 already
    rows = [(1, 1, 5, None, 100)] + [(10 + n, item, qty, 50 + (n % 3), 999) for n, (item, _, qty) in enumerate(lines)]
    snap = spark.createDataFrame(rows, "id long, item_id long, quantity long, order_id long, bin_id long")
    r = W.receive_shipments(orders, snap, bins, orders.select("id"))
    before = sum(q for _, _, q, _, b in rows if b == 100)
    after = r.lines.filter(F.col("bin_id") == 100).agg(F.sum("quantity")).first()[0]
    shipped = {50 + k for k, s in enumerate(status) if s == "Shipped"}
    received = sum(q for _, _, q, o, b in rows if o in shipped)
    assert after - before == received
    assert r.lines.filter(F.col("bin_id") == 999).count() == len(lines)  # the order lines themselves are untouched


@FEW
@given(values=st.lists(st.integers(0, 20), min_size=1, max_size=30), length=st.integers(1, 7))
def test_pages_concatenate_to_the_sorted_table(spark, values, length):
    df = spark.createDataFrame(list(enumerate(values)), "pos long, v long")
    srt = G.grid_sort(df, [("v", "desc")], "pos")
    whole = [r.pos for r in srt.collect()]
    pages = []
    for start in range(0, len(values), length):
        pages.extend(r.pos for r in G.grid_page(df, start, length, [("v", "desc")], "pos").collect())
    assert pages == whole
    ranked = sorted((r.row_pos, r.pos) for r in G.grid_rank(df, [("v", "desc")], "pos", {"v": "num"}).collect())
    assert [p for _, p in ranked] == whole


words = st.lists(st.sampled_from(["red", "oak", "chair", "table", "blue"]), min_size=1, max_size=3, unique=True)


@FEW
@given(terms=words)
def test_smart_search_ignores_word_order(spark, terms):
    df = spark.createDataFrame(
        [(1, "red oak chair"), (2, "blue table"), (3, "oak table, red"), (4, "chair")], "id long, t string"
    )
    a = sorted(r.id for r in G.grid_search(df, " ".join(terms)).collect())
    b = sorted(r.id for r in G.grid_search(df, " ".join(reversed(terms))).collect())
    assert a == b
