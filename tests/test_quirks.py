"""Hand-made cases for the store's rules and quirks (tiny inline tables)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from shopfloor.functions import exprs as X
from shopfloor.operators import catalog as C
from shopfloor.operators import changes as W
from shopfloor.operators import grid as G
from shopfloor.operators import stock as S
from shopfloor.plans.ids import number_rows
from shopfloor.sources.fixtures import RetailTables

ITEM = "id long, sku string, name string, category string, description string, dtype string, length int, width long, height long, isdeleted boolean"


def _tables(spark, **views) -> RetailTables:
    t = RetailTables(spark, "/nonexistent")
    for name, df in views.items():
        t.__dict__[name] = df
    return t


def _items(spark, rows):
    return spark.createDataFrame(rows, ITEM)


def test_null_isdeleted_is_not_listed(spark):
    items = _items(spark, [
        (1, "A", "a", "c", "d", "FurnitureEntity", 1, 1, 1, False),
        (2, "B", "b", "c", "d", "FurnitureEntity", 1, 1, 1, None),
        (3, "C", "c", "c", "d", "FurnitureEntity", 1, 1, 1, True),
    ])
    sub = spark.createDataFrame([(1, None), (2, "x.jpg"), (3, None)], "id long, imageurl string")
    t = _tables(spark, item=items, subtype=sub)
    assert [r.id for r in C.list_items(t, C.FURNITURE).collect()] == [1]
    # the showroom lists soft-deleted items too, unpriced ones with price 0.00
    t.__dict__["item_country"] = spark.createDataFrame([(1, 5, 12.5)], "item_id long, country_id int, retailprice double")
    rows = {r.id: r for r in C.showroom_items(t).collect()}
    assert set(rows) == {1, 2, 3}
    assert rows[1].price_text == "12.50" and rows[2].price_text == "0.00"
    assert rows[1].image_path == "/img/products/default.jpg" and rows[2].image_path == "/img/products/x.jpg"


def _stock_views(spark):
    store = spark.createDataFrame(
        [(1, "S1", 0, 10), (2, "S2", 0, 10), (3, "S3", 0, 20)], "id long, name string, country_id int, warehouse_id long"
    )
    wh = spark.createDataFrame([(10, "W10", 0), (20, "W20", 0)], "id long, warehousename string, country_id int")
    bins = spark.createDataFrame(
        [(100, "Inbound", 10), (101, "Outbound", 10), (201, "Outbound", 20)], "id long, type string, warehouse_id long"
    )
    line = spark.createDataFrame(
        [(1, 7, 5, None, 101), (2, 7, 3, None, 101), (3, 7, 4, None, 100), (4, 7, 2, None, 201)],
        "id long, item_id long, quantity long, order_id long, bin_id long",
    )
    items = _items(spark, [(7, "SKU_7", "x", "c", "d", "FurnitureEntity", 1, 1, 1, False)])
    return _tables(spark, store=store, warehouse=wh, storagebin=bins, line=line, item=items)


def test_shared_warehouse_counts_once_per_store(spark):
    t = _stock_views(spark)
    per_store = {r.store_id: r.stock for r in S.item_stock(t).collect()}
    assert per_store == {1: 8, 2: 8, 3: 2}  # inbound bin not counted
    assert S.item_stock_all(t).collect()[0].stock == 18  # warehouse 10 twice
    assert S.item_stock_all(t, distinct_warehouse=True).collect()[0].stock == 10


def test_stock_by_store_name_missing_is_zero(spark):
    t = _stock_views(spark)
    req = spark.createDataFrame([("S1", "SKU_7"), ("S9", "SKU_7"), ("S3", "SKU_X")], "store_name string, sku string")
    got = {(r.store_name, r.sku): r.stock for r in S.stock_by_store_name(t, req).collect()}
    assert got == {("S1", "SKU_7"): 8, ("S9", "SKU_7"): 0, ("S3", "SKU_X"): 0}
    avail = {r.store_name: r.availability for r in S.item_availability(t, req).collect()}
    assert avail == {"S1": "Available", "S9": "Unavailable", "S3": "Unavailable"}


def test_cart_guard_stops_at_stock(spark):
    ts = dt.datetime(2024, 1, 1)
    adds = spark.createDataFrame(
        [(1, 1, ts + dt.timedelta(seconds=i), float(10 + i)) for i in range(5)]
        + [(2, 1, ts, 1.0), (3, 1, ts, 1.0), (4, 1, ts, 1.0)],
        "session long, item_id long, ts timestamp_ntz, price double",
    )
    stock = spark.createDataFrame([(1, 1, 3), (2, 1, 0), (3, 1, -2), (4, 1, None)], "session long, item_id long, stock long")
    got = {r.session: (r.adds, r.accepted, r.price) for r in S.cart_fold(adds, stock).collect()}
    assert got[1] == (5, 3, 10.0)  # reaches the stock exactly; price of the first add
    assert got[2][1] == 0 and got[3][1] == 0 and got[4][1] == 0


def test_first_inbound_bin_none(spark):
    t = _stock_views(spark)
    got = {r.warehouse_id: r.bin_id for r in S.first_inbound_bin(t).collect()}
    assert got == {10: 100, 20: None}


def test_receipt_credits_bin_line_and_adds_new_item(spark):
    t = _stock_views(spark)
    orders = spark.createDataFrame(
        [(50, "Shipped", 10), (51, "Shipped", 20), (52, "Submitted", 10)], "id long, status string, destination_id long"
    )
    lines = t.line.unionByName(spark.createDataFrame(
        [(5, 7, 6, 50, 999), (6, 8, 1, 50, 999), (7, 7, 1, 51, 999), (8, 7, 9, 52, 999)],
        "id long, item_id long, quantity long, order_id long, bin_id long",
    ))
    r = W.receive_shipments(orders, lines, t.storagebin, orders.select("id"))
    by_id = {x.id: x for x in r.lines.collect()}
    assert by_id[3].quantity == 4 + 6  # existing item 7 in inbound bin 100: credited
    new = [x for x in by_id.values() if x.id > 8]
    assert [(x.item_id, x.quantity, x.bin_id, x.order_id) for x in new] == [(8, 1, 100, None)]
    assert {x.order_id: x.reason for x in r.rejects.collect()} == {51: "no inbound bin", 52: "not shipped: Submitted"}
    assert {x.id: x.status for x in r.orders.collect()} == {50: "Completed", 51: "Shipped", 52: "Submitted"}


def test_status_machine(spark):
    orders = spark.createDataFrame(
        [(1, "Pending", None), (2, "Pending", None), (3, "Submitted", None), (4, "Completed", None)],
        "id long, status string, shippeddate timestamp_ntz",
    )
    lines = spark.createDataFrame([(10, 1)], "id long, order_id long")
    changes = spark.createDataFrame(
        [(1, "Submitted"), (2, "Submitted"), (3, "Shipped"), (4, "Pending"), (9, "Shipped")], "id long, new_status string"
    )
    r = W.apply_status(orders, lines, changes, dt.date(2020, 5, 1))
    st = {x.id: (x.status, x.shippeddate) for x in r.orders.collect()}
    assert st[1] == ("Submitted", None)
    assert st[3] == ("Shipped", dt.datetime(2020, 5, 1))
    assert st[2][0] == "Pending" and st[4][0] == "Completed"
    rej = {x.id: x.reason for x in r.rejects.collect()}
    assert rej == {2: "order has no lines", 4: "not allowed: Completed -> Pending", 9: "unknown order"}


def test_price_batch_duplicates_and_existing(spark):
    prices = spark.createDataFrame([(1, 5, 10.0)], "item_id long, country_id int, retailprice double")
    items = _items(spark, [(1, "A", "a", "c", "d", "FurnitureEntity", 1, 1, 1, False),
                           (2, "B", "b", "c", "d", "FurnitureEntity", 1, 1, 1, False)])
    adds = spark.createDataFrame(
        [("A", 5, 99.0, 1), ("B", 5, 20.0, 1), ("B", 5, 30.0, 2), ("B", 6, 7.0, 3), ("B", 6, 8.0, 3), ("Z", 5, 1.0, 1)],
        "sku string, country_id int, retailprice double, seq long",
    )
    change = W.add_prices(prices, items, adds)
    got = {(r.item_id, r.country_id): r.retailprice for r in change.prices.collect()}
    assert got == {(1, 5): 10.0, (2, 5): 20.0, (2, 6): 7.0}  # the first of a repeated pair
    assert sorted((r.sku, r.country_id, r.retailprice, r.reason) for r in change.rejects.collect()) == [
        ("A", 5, 99.0, "already priced"), ("B", 5, 30.0, "repeated in the batch"), ("B", 6, 8.0, "repeated in the batch"),
        ("Z", 5, 1.0, "unknown sku")]
    twice = adds.select("sku", "country_id", "retailprice").filter("sku = 'B' and retailprice = 20").selectExpr("explode(array(1, 2))", "*").drop("col")
    change = W.add_prices(prices, items, twice)  # equal rows: one goes in, the other comes back
    assert change.prices.count() == 2 and change.rejects.count() == 1
    upd = spark.createDataFrame([(1, 5, 12.349), (1, 5, 12.35), (3, 3, 1.0)], "item_id long, country_id int, retailprice double")
    got = {(r.item_id, r.country_id): r.retailprice for r in W.update_prices(prices, upd).collect()}
    assert got == {(1, 5): 12.4}  # larger value wins on a tie, half-up to one decimal, unknown pair ignored


def test_remove_items_cascades(spark):
    items = _items(spark, [(1, "A", "a", "c", "d", "RawMaterialEntity", 1, 1, 1, False),
                           (2, "B", "b", "c", "d", "FurnitureEntity", 1, 1, 1, False)])
    sub = spark.createDataFrame([(1, None), (2, None)], "id long, imageurl string")
    prices = spark.createDataFrame([(1, 5, 10.0), (2, 5, 3.0)], "item_id long, country_id int, retailprice double")
    r = W.remove_items(items, sub, prices, spark.createDataFrame([(1,)], "id long"))
    assert [x.id for x in r.items.collect()] == [2]
    assert [x.id for x in r.subtypes.collect()] == [2]
    assert [x.item_id for x in r.prices.collect()] == [2]  # raw material prices go too


def test_add_items_ids_and_rejects(spark):
    items = _items(spark, [(5, "A", "a", "c", "d", "RawMaterialEntity", 1, 1, 1, False)])
    sub = spark.createDataFrame([(5, None)], "id long, imageurl string")
    new = spark.createDataFrame(
        [("C", "c", "cat", "d", "FurnitureEntity", 2, 3, 4, 1), ("B", "b", "cat", "d", "RawMaterialEntity", 1, 1, 1, 1),
         ("A", "a", "cat", "d", "FurnitureEntity", 1, 1, 1, 1), ("D", "", "cat", "d", "FurnitureEntity", 1, 1, 1, 1),
         ("E", "e", "cat", "d", "FurnitureEntity", 0, 1, 1, 1), ("C", "c2", "cat", "d", "FurnitureEntity", 2, 3, 4, 2),
         ("F", "f", "cat", None, "Bogus", 1, 1, 1, 1)],
        "sku string, name string, category string, description string, dtype string, length int, width long, height long, seq long",
    )
    r = W.add_items(items, sub, new)
    got = {x.sku: (x.id, x.name, x.isdeleted) for x in r.items.collect()}
    assert got["B"] == (6, "b", False) and got["C"] == (7, "c", False)
    imgs = {x.id: x.imageurl for x in r.subtypes.collect()}
    assert imgs[6] is None and imgs[7] == "/img/products/C.jpg"
    assert {x.sku: x.reason for x in r.rejects.collect()} == {
        "A": "sku already in use", "D": "missing required field", "E": "dimension below 1", "C": "repeated in the batch",
        "F": "missing required field; unknown type"}
    assert r.items.count() + r.rejects.count() == items.count() + new.count()
    wide = new.filter("sku = 'B'").withColumn("width", F.lit(1.5))
    assert [x.reason for x in W.add_items(items, sub, wide).rejects.collect()] == ["dimension not a whole number"]


def test_every_store_request_is_applied_or_rejected(spark):
    lines = spark.createDataFrame([(1, 7, 5, None, 1), (2, 8, 5, None, 1)], "id long, item_id long, quantity long, order_id long, bin_id long")
    stores = spark.createDataFrame([("S", 10), ("T", 11)], "name string, warehouse_id long")
    bins = spark.createDataFrame([(1, "Outbound", 10), (2, "Inbound", 11)], "id long, type string, warehouse_id long")
    items = spark.createDataFrame([(7, "A")], "id long, sku string")
    asked = spark.createDataFrame([("S", "A", 9, 1), ("S", "A", 3, 2), ("X", "A", 1, 1), ("S", "Z", 1, 1), ("T", "A", 1, 1), (None, "A", 1, 1)],
                                  "store_name string, sku string, quantity long, seq long")
    r = W.set_store_quantity(lines, stores, bins, items, asked)
    assert {x.id: x.quantity for x in r.lines.collect()} == {1: 3, 2: 5}
    assert sorted((x.store_name or "", x.sku, x.reason) for x in r.rejects.collect()) == [
        ("", "A", "unknown store"), ("S", "Z", "unknown sku"), ("T", "A", "no outbound bin"), ("X", "A", "unknown store")]


def test_lines_of_locked_orders_stay(spark):
    lines = spark.createDataFrame([(1, 7, 5, 100, 1), (2, 7, 5, 101, 1), (3, 7, 5, None, 1)], "id long, item_id long, quantity long, order_id long, bin_id long")
    orders = spark.createDataFrame([(100, "Pending"), (101, "Submitted")], "id long, status string")
    asked = spark.createDataFrame([(1, 2), (2, 2), (3, 2)], "id long, quantity long")
    got = lambda d: {r.id: r.quantity for r in d.collect()}
    assert got(W.update_line_quantity(lines, asked, "set", orders)) == {1: 2, 2: 5, 3: 2}
    assert got(W.update_line_quantity(lines, asked, "add", orders)) == {1: 7, 2: 5, 3: 7}
    assert got(W.remove_order_lines(lines, asked, orders)) == {2: 5}


def test_links_fold_into_lines_and_back(spark):
    from shopfloor.operators import links as L

    lines = spark.createDataFrame([(1, 7, 5), (2, 8, 6), (3, 9, 1)], "id long, item_id long, quantity long")
    bins = spark.createDataFrame([(10, 1), (11, 1), (10, 2)], "bin_id long, lineitem_id long")  # line 1 stands in two bins
    orders = spark.createDataFrame([(100, 1)], "order_id long, lineitem_id long")
    folded = L.fold_links(lines, bins, orders)
    assert sorted(map(tuple, folded.collect()), key=str) == sorted(
        [(1, 7, 5, 100, 10), (1, 7, 5, 100, 11), (2, 8, 6, None, 10), (3, 9, 1, None, None)], key=str)
    assert sorted(map(tuple, L.bin_links(folded).collect())) == [(10, 1), (10, 2), (11, 1)]
    assert set(map(tuple, L.order_links(folded).collect())) == {(100, 1)}
    assert L.order_links(folded, spark.createDataFrame([(5,)], "id long")).count() == 0


def test_orders_with_missing_fields_are_rejected(spark):
    from shopfloor.operators import orders as O

    day = dt.datetime(2020, 2, 1)
    orders = spark.createDataFrame([(1, 1, 2, day), (2, None, 2, day), (3, 1, 2, None), (4, 1, 1, day), (5, 1, 2, day)],
                                   "id long, origin_id long, destination_id long, expecteddate timestamp_ntz")
    line = spark.createDataFrame([(1, 5), (5, None)], "order_id long, quantity long")
    got = {r.id: (r.ok, r.reason) for r in O.validate_orders(_tables(spark, line=line), orders, dt.date(2020, 1, 1)).collect()}
    assert got == {1: (True, ""), 2: (False, "missing field"), 3: (False, "missing field"), 4: (False, "origin equals destination"),
                   5: (False, "quantity out of range")}


def test_line_quantity_add_presums(spark):
    lines = spark.createDataFrame([(1, 7, 5, None, 1)], "id long, item_id long, quantity long, order_id long, bin_id long")
    deltas = spark.createDataFrame([(1, 2), (1, 3), (9, 1)], "id long, quantity long")
    assert W.update_line_quantity(lines, deltas, mode="add").collect()[0].quantity == 10
    assert W.update_line_quantity(lines, deltas, mode="set").collect()[0].quantity == 3


def test_update_orders_only_pending(spark):
    orders = spark.createDataFrame([(1, "Pending", 1, 2), (2, "Shipped", 1, 2)], "id long, status string, origin_id long, destination_id long")
    ch = spark.createDataFrame([(1, 5), (2, 5)], "id long, origin_id long")
    got = {r.id: r.origin_id for r in W.update_orders(orders, ch).collect()}
    assert got == {1: 5, 2: 1}


def test_expressions(spark):
    df = spark.createDataFrame(
        [(0.2, 1.25, "http://x/y.png"), (0.125, 2.35, "a/b.png"), (1.5, None, "f.png"), (0.0, 0.0, None)],
        "r double, p double, u string",
    )
    rows = df.select(
        X.percent_text("r").alias("pct"), X.round_half_up_1("p").alias("p1"), X.price_text("p").alias("pt"),
        X.promotion_image("u").alias("img"), X.first_non_empty([F.lit(""), F.col("u")], "none").alias("pick"),
    ).collect()
    assert [r.pct for r in rows] == ["20%", "13%", "1.5", "0.0"]
    assert [r.p1 for r in rows] == [1.3, 2.4, None, 0.0]
    assert [r.pt for r in rows] == ["1.25", "2.35", "0.00", "0.00"]
    assert [r.img for r in rows] == ["http://x/y.png", "/a/b.png", "/img/promotions/f.png", "/img/products/default.jpg"]
    assert [r.pick for r in rows] == ["http://x/y.png", "a/b.png", "f.png", "none"]
    legacy = spark.createDataFrame([("/old/img/p.png",)], "u string").select(X.promotion_image("u", "/old/img/").alias("i"))
    assert legacy.collect()[0].i == "/img/p.png"


def test_number_rows_matches_row_number(spark):
    # enough rows over enough partitions that range bounds come from sampling
    n = 200_000
    df = spark.range(0, n).select((F.col("id") * 7919 % 100_003).alias("k"), F.col("id").alias("v")).repartition(16)
    got = number_rows(df, ["k", "v"], id_col="n", start=100)
    rows = sorted((r.k, r.v, r.n) for r in got.collect())
    assert [r[2] for r in rows] == list(range(101, n + 101))


def test_grid_search_terms_and_complement(spark):
    df = spark.createDataFrame(
        [(1, "Red chair\nwith arms"), (2, "chair, red"), (3, "table &amp; chair"), (4, None), (5, "a+b (c)")],
        "id long, t string",
    )
    ids = lambda d: sorted(r.id for r in d.collect())
    assert ids(G.grid_search(df, "CHAIR red")) == [1, 2]
    assert ids(G.grid_search(df, '"red chair"')) == [1]
    assert ids(G.grid_search(df, "with")) == [1]
    assert ids(G.grid_search(df, "chairwith")) == [] and ids(G.grid_search(df, '"chair with"')) == [1]  # a line break is a space
    assert ids(G.grid_search(df, "chairwith", types={"t": "num"})) == [1]  # other types only lose their line breaks
    assert ids(G.grid_search(df, "& chair")) == [3]  # entities decoded
    assert ids(G.grid_search(df, "a+b (c)", smart=False)) == [5]  # regex characters are literal
    assert ids(G.grid_search(df, r"^\d+\s+a\+b", regex=True)) == [5]
    assert ids(G.grid_search(df, "chair", keep="removed")) == [4, 5]
    assert ids(G.grid_search(df, "", keep="applied")) == [1, 2, 3, 4, 5]
    assert ids(G.grid_search(df, "chair", column_search={"id": "2"})) == [2]


def test_grid_sort_typed_and_pages(spark):
    df = spark.createDataFrame(
        [(1, "1,200", "1/5/2020"), (2, "", "12/1/2019"), (3, "$35", "bad"), (4, "-", "2020-01-05"), (5, "35", "1/5/2020")],
        "id long, amount string, day string",
    )
    order = [r.id for r in G.grid_sort(df, [("amount", "asc")], "id", {"amount": "num-fmt"}).collect()]
    assert order == [2, 4, 3, 5, 1]  # blanks first (stable), then 35, 35, 1200
    order = [r.id for r in G.grid_sort(df, [("day", "desc")], "id", {"day": "date"}).collect()]
    assert order == [1, 4, 5, 2, 3]  # unparsable -> epoch, last when descending
    ranked = {r.id: r.row_pos for r in G.grid_rank(df, [("amount", "asc")], "id", {"amount": "num-fmt"}).collect()}
    assert ranked == {2: 1, 4: 2, 3: 3, 5: 4, 1: 5}
    by_id = ([("id", "asc")], "id")
    assert [r.id for r in G.grid_page(df, 4, 2, *by_id).collect()] == [5]
    assert G.grid_page(df, 10, 2, *by_id).count() == 0  # page past the end
    assert [r.id for r in G.grid_page(df, 0, -1, *by_id).collect()] == [1, 2, 3, 4, 5]
    assert [r.id for r in G.grid_page(df, 3, -1, *by_id).collect()] == [4, 5]
    assert G.grid_page(df, G.TOP_ROWS, 5, *by_id).count() == 0
    info = G.grid_page_info(df, F.col("id") > 1, 2, 2).collect()[0]
    assert (info.page, info.pages, info.start, info.end, info.records_total, info.records_display) == (1, 2, 2, 4, 5, 4)
    assert G.page_number_start("last", 0, 2, 5) == 4 and G.page_number_start("next", 4, 2, 5) == 4
    assert G.page_number_start(3, 0, 2, 5) == 0 and G.page_number_start(2, 0, 2, 5) == 4  # past the end -> first page
    assert G.page_number_start("previous", 1, 2, 5) == 0 and G.page_number_start(1, 0, 2, 0) == 0


def test_grid_column_types(spark):
    df = spark.createDataFrame(
        [("1", "2020-01-01", "$1,000", "<b>5</b>", "<i>x</i>", "plain", 3.5),
         ("-", "", "12%", "<b>6</b>", "", "text", None)],
        "a string, b string, c string, d string, e string, f string, g double",
    )
    got = {r.column_name: r.type for r in G.grid_column_types(df).collect()}
    assert got == {"a": "num", "b": "date", "c": "num-fmt", "d": "html-num", "e": "html", "f": "string", "g": "num"}


def test_profile_updates_skip_password_fields(spark):
    staff = spark.createDataFrame(
        [(1, "a@x", "Ann", "111", "h1"), (2, "b@x", "Bob", "222", "h2")],
        "id long, email string, name string, phone string, passwordhash string",
    )
    ch = spark.createDataFrame([("a@x", "Anne", "999", "evil", 1), ("a@x", "Anna", "998", "evil", 2)],
                               "email string, name string, phone string, passwordhash string, seq long")
    got = {r.email: (r.name, r.phone, r.passwordhash) for r in W.update_staff(staff, ch).collect()}
    assert got == {"a@x": ("Anna", "998", "h1"), "b@x": ("Bob", "222", "h2")}


def test_append_feedback_and_sales(spark):
    feedback = spark.createDataFrame([("a@x", "hi", "Ann", "S")], "email string, message string, name string, subject string")
    new = spark.createDataFrame([("Bob", "b@x", "Q", "msg")], "name string, email string, subject string, message string")
    assert W.append_rows(feedback, new).count() == 2
    sales = spark.createDataFrame([(4, 1, dt.datetime(2020, 1, 1), 5.0, 5.0, "SGD")],
                                  "id long, member_id long, createddate timestamp_ntz, amountdue double, amountpaid double, currency string")
    new_sales = spark.createDataFrame([(7, 12.5), (3, 1.0)], "member_id long, amount double")
    out = {r.id: r for r in W.append_sales(sales, new_sales, dt.date(2021, 1, 1), ["member_id"]).collect()}
    assert out[5].member_id == 3 and out[6].member_id == 7
    assert out[6].amountdue == out[6].amountpaid == 12.5 and out[6].currency == "SGD"


def test_html_columns_search_without_tags(spark):
    df = spark.createDataFrame([(1, "<b>red</b>\nchair"), (2, "<span class='red'>x</span>")], "id long, h string")
    ids = lambda d: sorted(r.id for r in d.collect())
    assert ids(G.grid_search(df, '"red chair"')) == [1]  # detected as html
    assert ids(G.grid_search(df, "class")) == []
    assert ids(G.grid_search(df, "class", types={"h": "string"})) == [2]


def test_email_known_and_lookup(spark):
    from shopfloor.operators import people as P

    members = spark.createDataFrame([(1, "a@x"), (2, "b@x")], "id long, email string")
    asks = spark.createDataFrame([("a@x",), ("z@x",), ("a@x",)], "email string")
    assert {r.email: r.known for r in P.email_known(members, asks).collect()} == {"a@x": True, "z@x": False}
    keys = spark.createDataFrame([(2,), (2,), (9,)], "id long")
    assert [r.id for r in P.lookup_by_keys(members, keys, "id").collect()] == [2]


def test_shipping_order_listing_keeps_shipped_date(spark):
    from shopfloor.operators import orders as O

    so = spark.createDataFrame(
        [(1, dt.datetime(2020, 1, 1), dt.datetime(2020, 1, 9), dt.datetime(2020, 1, 3), "Shipped", 10, 20)],
        "id long, createddate timestamp_ntz, expecteddate timestamp_ntz, shippeddate timestamp_ntz, status string, origin_id long, destination_id long",
    )
    wh = spark.createDataFrame([(10, "W10", 0), (20, "W20", 0)], "id long, warehousename string, country_id int")
    t = _tables(spark, shippingorder=so, warehouse=wh)
    row = O.shipping_orders(t).collect()[0]
    assert row.shippeddate == dt.datetime(2020, 1, 3)  # the real date, not the expected one
    assert (row.origin_name, row.destination_name) == ("W10", "W20")


def test_grid_sort_options_and_custom_filter(spark):
    df = spark.createDataFrame(
        [(1, "b", 2, "x"), (2, "a", 2, "y"), (3, "a", 1, "x"), (4, "c", 0, "y")],
        "id long, name string, rank long, grp string",
    )
    ids = lambda d: [r.id for r in d.collect()]
    # sorting the "name" column actually sorts by rank then name
    assert ids(G.grid_sort(df, [("name", "asc")], "id", {"rank": "num"}, data_sort={"name": ["rank", "name"]})) == [4, 3, 2, 1]
    # a fixed leading key always applies first, whatever the user sorts by
    assert ids(G.grid_sort(df, [("name", "desc")], "id", fixed_pre=[("grp", "asc")])) == [1, 3, 4, 2]
    assert ids(G.grid_sort(df, [("grp", "asc")], "id", fixed_post=[("rank", "desc")], types={"rank": "num"})) == [1, 3, 2, 4]
    # caller predicates are ANDed with the search
    assert sorted(ids(G.grid_search(df, "x", extra=[F.col("rank") > 1]))) == [1]


def test_add_items_fills_volume_and_type_when_kept(spark):
    items = spark.createDataFrame(
        [(1, "A", "a", "c", "d", "RawMaterialEntity", 1, 1, 1, False, 1.0, "Raw Material")],
        ITEM + ", volume double, type string",
    )
    sub = spark.createDataFrame([(1, None)], "id long, imageurl string")
    new = spark.createDataFrame([("B", "b", "cat", "d", "FurnitureEntity", 2, 3, 4)],
                                "sku string, name string, category string, description string, dtype string, length int, width long, height long")
    row = [r for r in W.add_items(items, sub, new).items.collect() if r.sku == "B"][0]
    assert (row.id, row.volume, row.type, row.isdeleted) == (2, 24.0, "Furniture", False)


def test_grid_sort_types_come_from_schema_or_values(spark):
    df = spark.createDataFrame([(1, "10"), (2, "9"), (3, ""), (4, "100")], "id long, amount string")
    assert [r.id for r in G.grid_sort(df, [("amount", "asc")], "id").collect()] == [3, 2, 1, 4]
    assert [r.id for r in G.grid_sort(df, [("amount", "asc")], "id", {"amount": "string"}).collect()] == [3, 1, 4, 2]  # as text
    big = spark.createDataFrame([(1, 2**53 + 1), (2, 2**53), (3, 10), (4, 9)], "id long, n long")
    assert [r.id for r in G.grid_sort(big, [("n", "asc")], "id").collect()] == [4, 3, 2, 1]
    days = spark.createDataFrame(
        [(1, "2024-01-01T00:00:00.25Z"), (2, "2024-01-01T00:00:00.125Z"), (3, "2024-01-01T02:00:00+02:00"), (4, "")], "id long, d string"
    )
    assert [r.id for r in G.grid_sort(days, [("d", "asc")], "id").collect()] == [4, 3, 2, 1]
    stamps = days.select("id", F.expr("try_cast(d as timestamp)").alias("d"))
    assert [r.id for r in G.grid_sort(stamps, [("d", "asc")], "id").collect()] == [4, 3, 2, 1]


def test_html_type_is_decided_by_the_first_row(spark):
    df = spark.createDataFrame([(2, "plain"), (1, "<a>x</a>"), (3, None)], "pos long, t string")
    kind = lambda d, **k: {r.column_name: r.type for r in G.grid_column_types(d, ["t"], **k).collect()}["t"]
    assert kind(df, position="pos") == "html" and kind(df) == "html"
    assert kind(df.filter("pos > 1"), position="pos") == "string"
    assert kind(df.filter("pos <> 1").union(spark.createDataFrame([(9, "<b>")], df.schema)), position="pos") == "string"
    empty = {r.column_name: r.type for r in G.grid_column_types(df.limit(0)).collect()}
    assert empty == {"pos": "num", "t": "string"}


def test_character_references_are_decoded_as_in_a_browser(spark):
    import html

    cells = ["&eacute;t&eacute;", "&#233;&#xE9;&#XE9", "&amp;lt;", "&notit; &notin; &not;", "&copy 2020 &copyx", "&#0; &#x80; &#150; &#xD800; &#99999999999;",
             "&unknown; & && &;", "a&nbsp;b", "&CounterClockwiseContourIntegral;", "&#39;&apos;&quot;", "AT&T", "&fjlig;"]
    df = spark.createDataFrame([(c,) for c in cells], "c string")
    got = {r.c: r.d for r in df.select("c", G.decode_entities(F.col("c")).alias("d")).collect()}
    assert got == {c: html.unescape(c) for c in cells}
    seen = df.select(G.cell_text(F.lit("<b>x</b> &lt;y&gt;\nz")).alias("t")).first().t
    assert seen == "x <y> z"


def test_regex_search_folds_all_letters(spark):
    df = spark.createDataFrame([(1, "ÉTÉ"), (2, "ete")], "id long, t string")
    assert [r.id for r in G.grid_search(df, "été", regex=True).collect()] == [1]
    assert [r.id for r in G.grid_search(df, "été").collect()] == [1]


def test_default_sort_keeps_server_order_and_case_flag(spark):
    # staff pages put an empty hidden first column: the default sort keeps the given order
    df = spark.createDataFrame([("", 3, "Red"), ("", 1, "red"), ("", 2, "RED x")], "blank string, pos long, t string")
    assert [r.pos for r in G.grid_sort(df, position="pos").collect()] == [1, 2, 3]
    ids = lambda d: sorted(r.pos for r in d.collect())
    assert ids(G.grid_search(df, "red", case_insensitive=False)) == [1]
    assert ids(G.grid_search(df, "red")) == [1, 2, 3]
    assert ids(G.grid_search(df, "^red$", regex=True, smart=False, cols=["t"])) == [1, 3]
