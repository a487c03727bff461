"""Date texts, type masks, code-unit order, many searches, deep pages, and audits of updates."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from shopfloor.functions.datetext import is_date, parse_date
from shopfloor.operators import changes as X
from shopfloor.operators import grid as G

DATES = {
    "1/15/2024, 10:00:00 AM": "2024-01-15 10:00:00", "12/1/2023": "2023-12-01 00:00:00", "12/1/2023, 12:00:00 AM": "2023-12-01 00:00:00",
    "12/1/2023, 12:30 PM": "2023-12-01 12:30:00", "2024/1/5 9:05": "2024-01-05 09:05:00", "Jan 15, 2024 10:00:00": "2024-01-15 10:00:00",
    "Mon, 15 Jan 2024 10:00:00 GMT": "2024-01-15 10:00:00", "Mon Jan 15 2024 10:00:00 GMT+0800": "2024-01-15 02:00:00", "15 January 2024": "2024-01-15 00:00:00",
    "1/15/2024, 10:00 AM EST": "2024-01-15 15:00:00", "2024-01-15T10:00:00.25Z": "2024-01-15 10:00:00.25",
    "mary 1 2024": "2024-03-01 00:00:00",  # a month is known by its first three letters
    "2/30/2024": None, "1/15/2024 13:00 PM": None, "Monday": None, "13/1/2024": None, "": None, "$1/2/2024": None, "x" * 200: None, None: None,
}


def test_date_texts(spark):
    df = spark.createDataFrame([(t,) for t in DATES], "t string")
    got = {r.t: r.p for r in df.select("t", parse_date(F.col("t")).cast("string").alias("p")).collect()}
    assert got == DATES
    tail = spark.createDataFrame([("Mon Jan 15 2024 10:00:00 GMT+0800 (CST)",)], "t string").select(parse_date(F.col("t")).isNotNull(), is_date(F.col("t"))).first()
    assert tuple(tail) == (True, False)  # a sort key, but no detected date: it ends in a bracket


def test_dates_with_a_time_are_detected_and_sorted(spark):
    df = spark.createDataFrame([(1, "1/15/2024, 10:00:00 AM"), (2, "12/1/2023, 9:00:00 PM"), (3, "1/5/2024, 1:00:00 PM"), (4, None)], "id long, d string")
    assert G.detect_types(df, ["d"], "id") == {"d": "date"}
    assert [r.id for r in G.grid_sort(df, [("d", "asc")], "id").collect()] == [4, 2, 3, 1]


@pytest.mark.parametrize(
    "values, kind",
    [
        (["1", "-2.5e3", None, "-"], "num"), (["1", "$1,000.5"], "num-fmt"), (["<b>1</b>", "2"], "html-num"), (["<b>$1</b>", "2"], "html-num-fmt"),
        (["1", "x"], "string"), (["<b>x</b>", "1"], "html"), ([" 5", "£6"], "num-fmt"), (["1/2/2024", "5"], "string"), (["", None], "num"),
        (["May 1, 2024", "2024-01-01"], "date"), (["May", "1"], "string"),
    ],
)
def test_type_lattice(spark, values, kind):
    df = spark.createDataFrame(list(enumerate(values)), "pos int, v string")
    assert {r.column_name: r.type for r in G.grid_column_types(df, ["v"], "pos").collect()} == {"v": kind}
    assert G.column_types(df, ["v"], None, "pos") == {"v": kind}


def test_text_order_is_by_code_units(spark):
    df = spark.createDataFrame([(1, "ﬁ"), (2, "\U0001F600"), (3, "Z"), (4, "é"), (5, "")], "id long, t string")
    assert [r.id for r in G.grid_sort(df, [("t", "asc")], "id", {"t": "string"}).collect()] == [5, 3, 4, 2, 1]


def test_row_text_plan_holds_the_references_once(spark):
    df = spark.createDataFrame([(1, "a &amp; b", "c\nd", "&eacute;")], "id long, a string, b string, c string")
    types = dict.fromkeys("abc", "string")
    assert df.select(G.row_text(df, types=types).alias("t")).first().t == "1  a & b  c d  é"
    one = df.select(G.row_text(df, ["a"], types))._jdf.queryExecution().optimizedPlan().toString()
    three = df.select(G.row_text(df, types=types))._jdf.queryExecution().optimizedPlan().toString()
    assert len(three) < 1.2 * len(one)


def test_many_searches_equal_single_ones(spark):
    rng = random.Random(4)
    words = ["Red", "chair", "blue", "table", "oak", "a&amp;b", "x", "Été", "lamp-shade", "of the"]
    df = spark.createDataFrame([(i, " ".join(rng.choices(words, k=6)), rng.choice(words)) for i in range(80)] + [(99, None, None)], "id long, t string, u string")
    texts = ["red CHAIR", '"blue table"', "x", "oak of", "été", "a&b lamp", "zzz", "", '"e o"', "9", 'chair "chair"']
    searches = spark.createDataFrame(list(enumerate(texts)), "search_id int, text string")
    got = Counter((r.search_id, r.id) for r in G.grid_search_many(df, searches, "id").collect())
    want = Counter((k, r.id) for k, t in enumerate(texts) if t for r in G.grid_search(df, t, position="id").select("id").collect())
    assert got == want
    assert G.grid_search_many(df, searches.limit(0), "id").collect() == []
    assert G.grid_search_many(df.limit(0), searches, "id").collect() == []


def test_many_searches_cut_only_distinct_words_into_grams(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"the old  oak chair {i % 7} the oak", "é&amp;" if i % 3 else "a <b") for i in range(300)] + [(400, None, None), (401, "  ", "x")], "id long, t string, u string")
    texts = ["oak chair", '"old  oak"', '" chair 3 "', '"  "', "th ir", '"k c" é&', '"<b" 5', "z", '"the oak  "', "o"]
    searches = spark.createDataFrame(list(enumerate(texts)), "search_id int, text string")
    want = Counter((k, r.id) for k, t in enumerate(texts) for r in G.grid_search(df, t, position="id").select("id").collect())
    written = {}
    real = G.write_table
    monkeypatch.setattr(G, "write_table", lambda d, name: written.setdefault(name, real(d, name)))
    got = G.grid_search_many(df, searches, "id")
    assert Counter((r.search_id, r.id) for r in got.collect()) == want
    # no table of grams by rows: every row has the same few words, but for its id
    assert "grid-row-grams" not in written and max(d.count() for d in written.values()) < 1500
    assert written["grid-words"].agg({"n": "max"}).first()[0] == 302
    # the text is read once where words are looked up, with no shuffle of texts
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and not re.search(r"Filter \(size\(array_distinct", plan)
    written.clear()
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert Counter((r.search_id, r.id) for r in G.grid_search_many(df, searches, "id").collect()) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_many_searches_with_repeated_and_null_keys(spark):
    df = spark.createDataFrame([(1, "red oak red"), (1, "red oak red"), (2, "oaken reds"), (None, "red oak")], "id long, t string")
    searches = spark.createDataFrame([(7, "red oak"), (7, "red oak"), (8, "red"), (None, "red")], "search_id int, text string")
    got = Counter((r.search_id, r.id) for r in G.grid_search_many(df, searches, "id", types={"t": "string"}).collect())
    assert got == {(7, 1): 8, (7, 2): 2, (8, 1): 4, (8, 2): 1}


def test_deep_pages_by_order_statistics(spark, monkeypatch):
    monkeypatch.setattr(G, "TOP_ROWS", 50)
    monkeypatch.setattr(G, "SPLITTERS", 8)
    rng = random.Random(9)
    data = [(i, rng.choice([None, 1, 2, 3, 4, 5]), rng.choice(["a", "B", "c", None])) for i in range(2000)]
    df = spark.createDataFrame(data, "id long, n int, t string").repartition(6)
    order, types = [("n", "desc"), ("t", "asc")], {"t": "string"}
    whole = [r.id for r in G.grid_sort(df, order, "id", types).collect()]
    for start, length in ((0, 10), (700, 25), (1990, 25), (2500, 5), (1200, -1), (0, -1), (2000, -1)):
        want = whole[start:] if length < 0 else whole[start : start + length]
        assert [r.id for r in G.grid_page(df, start, length, order, "id", types).collect()] == want, (start, length)
    plan = G.grid_page(df, 700, 25, order, "id", types)._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan.lower()
    # without a position equal keys leave the order open: still every row once
    pages = [r.n for s in range(0, 2000, 500) for r in G.grid_page(df.select("n"), s, 500, [("n", "asc")]).collect()]
    assert sorted(x or 0 for x in pages) == sorted(d[1] or 0 for d in data)


def test_store_requests_are_applied_or_rejected_once(spark):
    lines = spark.createDataFrame([(1, 10, 5, None, 100), (2, 11, 6, None, 101), (3, 10, 7, None, None)], "id long, item_id long, quantity long, order_id long, bin_id long")
    stores = spark.createDataFrame([(1, "A", 1), (2, "A", 2), (3, "C", 3), (4, "D", 4)], "id long, name string, warehouse_id long")
    bins = spark.createDataFrame([(100, "Outbound", 1), (101, "Outbound", 1), (102, "Outbound", 2), (103, "Inbound", 3), (104, "Outbound", 4)], "id long, type string, warehouse_id long")
    items = spark.createDataFrame([(10, "S10"), (11, "S11"), (12, "S12")], "id long, sku string")
    req = [("A", "S10", 50, 1), ("A", "S10", 60, 2), ("A", "S12", 1, 3), ("B", "S10", 1, 4), ("C", "S10", 1, 5), ("D", "S10", 1, 6), ("A", "S99", 1, 7), (None, None, 1, 8)]
    out = X.set_store_quantity(lines, stores, bins, items, spark.createDataFrame(req, "store_name string, sku string, quantity long, seq long"))
    assert {r.id: r.quantity for r in out.lines.collect()} == {1: 60, 2: 6, 3: 7}
    assert Counter(tuple(r) for r in out.rejects.collect()) == Counter([
        ("A", "S12", 1, "no line of the item"), ("B", "S10", 1, "unknown store"), ("C", "S10", 1, "no outbound bin"),
        ("D", "S10", 1, "no line of the item"), ("A", "S99", 1, "unknown sku"), (None, None, 1, "unknown store"),
    ])


def test_applied_and_rejected_updates_are_the_batch(spark):
    orders = spark.createDataFrame([(1, "Pending", 5), (2, "Shipped", 5), (3, None, 5), (4, "Pending", 5)], "id long, status string, origin_id long")
    asked = [(1, 7, 1), (1, 8, 2), (1, 8, 2), (2, 7, 1), (3, 7, 1), (9, 7, 1), (None, 7, 1), (4, None, 1)]
    batch = spark.createDataFrame(asked, "id long, origin_id long, seq long")
    judged = X.audit_updates(orders, batch, ["id"], ["seq", "origin_id"], F.col("status") == "Pending").collect()
    assert Counter((r.id, r.origin_id, r.seq) for r in judged) == Counter(asked)
    applied = {r.id: r.origin_id for r in judged if r.reason is None}
    assert applied == {1: 8, 4: None}
    after = {r.id: r.origin_id for r in X.update_orders(orders, batch).collect()}
    assert after == {**dict.fromkeys((1, 2, 3, 4), 5), **applied}
    rejects = Counter((r.id, r.reason) for r in X.update_orders_rejects(orders, batch).collect())
    assert rejects == Counter({(1, "superseded"): 2, (2, "locked"): 1, (3, "locked"): 1, (9, "unknown"): 1, (None, "unknown"): 1})


def test_line_updates_behind_the_edit_lock(spark):
    lines = spark.createDataFrame([(1, 10, 5, 7, None), (2, 10, 5, 8, None), (3, 10, 5, None, 100)], "id long, item_id long, quantity long, order_id long, bin_id long")
    orders = spark.createDataFrame([(7, "Pending"), (8, "Shipped")], "id long, status string")
    batch = spark.createDataFrame([(1, 2), (1, 3), (2, 2), (3, 2), (4, 2)], "id long, quantity long")
    rejects = lambda mode: Counter((r.id, r.quantity, r.reason) for r in X.update_line_quantity_rejects(lines, batch, mode, orders).collect())
    assert rejects("set") == Counter([(1, 2, "superseded"), (2, 2, "locked"), (4, 2, "unknown")])
    assert rejects("add") == Counter([(2, 2, "locked"), (4, 2, "unknown")])
    assert {r.id: r.quantity for r in X.update_line_quantity(lines, batch, "add", orders).collect()} == {1: 10, 2: 5, 3: 7}
