"""Stock by store and item, bin contents, inbound bins and the cart guard.

Stock is the sum of line quantities in a warehouse's Outbound bins; a store
sees the stock of its warehouse.  Lines are aggregated per (warehouse, item)
before anything is fanned out to stores, so the big side shrinks first and a
hot warehouse or item is combined map-side instead of landing in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.exprs import availability
from ..plans.joins import maybe_broadcast
from ..plans.materialize import sized_side, write_table
from ..sources.fixtures import RetailTables


def _outbound_bins(t: RetailTables) -> DataFrame:
    bins = t.storagebin.filter(F.col("type") == K.BIN_OUTBOUND).select(F.col("id").alias("bin_id"), "warehouse_id")
    # the warehouse join only drops bins whose warehouse is unknown
    return bins.join(t.warehouse.select(F.col("id").alias("warehouse_id")), "warehouse_id", "left_semi")


def warehouse_item_stock(t: RetailTables) -> DataFrame:
    """(warehouse_id, item_id, stock) over Outbound bins."""
    lines = t.line.select("bin_id", "item_id", "quantity")
    bins = _outbound_bins(t)
    # a bin and an item mostly meet on one line: lines of other bins are dropped, and the rest is summed once
    located = lines.join(maybe_broadcast(bins), "bin_id")
    return located.groupBy("warehouse_id", "item_id").agg(F.sum("quantity").alias("stock"))


def store_item_stock(t: RetailTables) -> DataFrame:
    """(store_id, item_id, stock): warehouse stock fanned out to its stores."""
    stores = t.store.select(F.col("id").alias("store_id"), "warehouse_id")
    return warehouse_item_stock(t).join(maybe_broadcast(stores), "warehouse_id").select("store_id", "item_id", "stock")


def item_stock(t: RetailTables) -> DataFrame:
    """Stock of every item at every store: (store_id, sku, stock)."""
    items = t.item.select(F.col("id").alias("item_id"), "sku")
    # sku is unique per item, so (store, item) sums are already (store, sku) sums
    return store_item_stock(t).join(items, "item_id").select("store_id", "sku", F.col("stock").cast("long").alias("stock"))


def item_stock_all(t: RetailTables, distinct_warehouse: bool = False) -> DataFrame:
    """Stock of every item over all stores: (sku, stock).

    As in the store, a warehouse serving several stores is counted once per
    store; ``distinct_warehouse`` counts each warehouse (that has a store) once.
    """
    stock = warehouse_item_stock(t)
    stores = t.store.select("warehouse_id")
    if distinct_warehouse:
        weights = stores.distinct().withColumn("n", F.lit(1))
    else:
        weights = stores.groupBy("warehouse_id").agg(F.count(F.lit(1)).alias("n"))
    weighted = stock.join(maybe_broadcast(weights), "warehouse_id").select("item_id", (F.col("stock") * F.col("n")).alias("stock"))
    per_item = weighted.groupBy("item_id").agg(F.sum("stock").cast("long").alias("stock"))
    items = t.item.select(F.col("id").alias("item_id"), "sku")
    return per_item.join(items, "item_id").select("sku", "stock")


def stock_by_store_name(t: RetailTables, requests: DataFrame) -> DataFrame:
    """Stock for requested (store_name, sku) pairs; unknown or empty -> 0."""
    stores = t.store.select(F.col("name").alias("store_name"), "warehouse_id")
    items = t.item.select(F.col("id").alias("item_id"), "sku")
    resolved = (
        requests.select("store_name", "sku")
        .join(maybe_broadcast(stores), "store_name", "left")
        .join(items, "sku", "left")
    )
    stock = warehouse_item_stock(t)
    return resolved.join(stock, ["warehouse_id", "item_id"], "left").groupBy("store_name", "sku").agg(
        F.coalesce(F.sum("stock"), F.lit(0)).cast("long").alias("stock")
    )


def item_availability(t: RetailTables, requests: DataFrame) -> DataFrame:
    """Requested (store_name, sku) with quantity and Available / Unavailable."""
    return stock_by_store_name(t, requests).select(
        "store_name", "sku", F.col("stock").alias("quantity"), availability("stock").alias("availability")
    )


def outbound_bin_contents(t: RetailTables) -> DataFrame:
    """Items and quantities in the Outbound bin(s) of every warehouse."""
    lines = t.line.select("bin_id", "item_id", "quantity")
    located = lines.join(maybe_broadcast(_outbound_bins(t)), "bin_id")
    items = t.item.withColumnRenamed("id", "item_id")
    return located.join(items, "item_id").select(
        "warehouse_id",
        F.col("item_id").alias("id"),
        *[c for c in t.item.columns if c != "id"],
        "quantity",
    )


def first_inbound_bin(t: RetailTables) -> DataFrame:
    """Lowest-id Inbound bin of every warehouse; NULL when it has none."""
    inbound = (
        t.storagebin.filter(F.col("type") == K.BIN_INBOUND)
        .groupBy("warehouse_id")
        .agg(F.min("id").alias("bin_id"))
    )
    return t.warehouse.select(F.col("id").alias("warehouse_id")).join(inbound, "warehouse_id", "left")


def item_in_bin(t: RetailTables, requests: DataFrame) -> DataFrame:
    """For requested (bin_id, item_id): does a line of the bin hold the item?"""
    wanted = sized_side(requests.select("bin_id", "item_id").distinct(), "bin_item_requests")
    # only lines of requested pairs are kept before the distinct, so the big
    # line table is filtered map-side and never shuffled whole
    held = (
        t.line.select("bin_id", "item_id")
        .join(wanted, ["bin_id", "item_id"], "left_semi")
        .distinct()
        .withColumn("present", F.lit(True))
    )
    return requests.select("bin_id", "item_id").join(held, ["bin_id", "item_id"], "left").select(
        "bin_id", "item_id", F.coalesce("present", F.lit(False)).alias("present")
    )


def cart_fold(adds: DataFrame, stock: DataFrame, on: tuple[str, ...] = ("session", "item_id")) -> DataFrame:
    """Fold add-to-cart events per (session, item_id) under a stock guard.

    An add is accepted while the count already in the cart is below the stock,
    so the cart may reach the stock exactly; NULL, zero or negative stock
    rejects every add.  The accepted adds are the first ones in time, so the
    result is ``least(adds, greatest(stock, 0))``.  If ``adds`` carries a
    ``price`` column, the price seen at the first add is kept.  ``stock`` is
    joined on ``on``: (session, item_id) by default, or e.g. (store_id,
    item_id) when each add carries the store it was made in.

    Written as an aggregate (partial, map-side), so one busy session or item
    never has to sit whole in one task; the stock is joined to the folded
    carts, one row per cart.
    """
    keys = ["session", "item_id", *[c for c in on if c not in ("session", "item_id")]]
    aggs = [F.count(F.lit(1)).alias("adds"), F.min("ts").alias("first_ts")]
    if "price" in adds.columns:
        aggs.append(F.min_by("price", "ts").alias("price"))
    folded = adds.groupBy(*keys).agg(*aggs)
    guarded = folded.join(stock.select(*on, "stock"), list(on), "left")
    accepted = F.least(F.col("adds"), F.greatest(F.coalesce(F.col("stock"), F.lit(0)), F.lit(0)))
    cols = ["session", "item_id", "adds", "stock", accepted.cast("long").alias("accepted")]
    if "price" in adds.columns:
        cols.append("price")
    return guarded.select(*cols)


EDGE_ROWS = 4096
SLOTS = 256


def _micros(adds: DataFrame) -> Column:
    """``ts`` as whole microseconds; a time without zone is read field by field, so no zone's clock change reorders it."""
    kind = adds.schema["ts"].dataType.typeName()
    if kind == "timestamp":
        return F.unix_micros("ts")
    seconds = "0" if kind == "date" else "hour(ts) * 3600 + minute(ts) * 60 + extract(second from ts)"
    return F.expr(f"unix_date(cast(ts as date)) * 86400000000L + cast(({seconds}) * 1000000 as bigint)")


def _narrowed(adds: DataFrame, wide: DataFrame, keys: list[str], col: str, lo: str, hi: str) -> DataFrame:
    """Each pair's range of ``col`` cut to the one of ``SLOTS`` slots that holds its last accepted add."""
    state = [c for c in wide.columns if c not in keys]
    step = f"(({hi} - {lo}) div {SLOTS} + 1)"
    slots = _in_range(adds, wide, keys).withColumn("_slot", F.expr(f"({col} - {lo}) div {step}"))
    # partial sums in every task: a hot pair is at most SLOTS rows a task
    counts = slots.groupBy(*keys, *state, "_slot").agg(F.count(F.lit(1)).alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(*keys).orderBy("_slot"))
    edge = counts.withColumn("_upto", upto).filter("_upto >= _need and _upto - _c < _need")
    new = {
        "_need": "_need - (_upto - _c)", "_n": "_c",
        lo: f"{lo} + _slot * {step}", hi: f"least({hi}, {lo} + _slot * {step} + {step} - 1)",
    }
    return edge.select(*keys, *[F.expr(new.get(c, c)).alias(c) for c in state])


def _in_range(adds: DataFrame, state: DataFrame, keys: list[str]) -> DataFrame:
    return adds.join(maybe_broadcast(state), keys).filter("_at between _lo and _hi and add_id between _lo_id and _hi_id")


def cart_outcomes(adds: DataFrame, stock: DataFrame, on: tuple[str, ...] = ("session", "item_id"), edge_rows: int = EDGE_ROWS) -> DataFrame:
    """Every add (session, item_id, ``on``, add_id) with ``accepted``: what the guard of ``cart_fold`` answers to it.

    The first ``stock`` adds of a (session, item) in time are accepted, equal
    times by ``add_id`` (unique).  An add without session, item, time or id, or
    without a stock above zero, is refused.  ``stock`` has one row per ``on``.

    No pair is ranked whole: pairs whose stock covers all their adds need no
    order, and for the others the range of times (then of ids at one time) that
    holds the last accepted add is narrowed by histograms of ``SLOTS`` slots
    until it holds at most ``edge_rows`` adds; only these are ranked.
    """
    keys = ["session", "item_id", *[c for c in on if c not in ("session", "item_id")]]
    placed = write_table(adds.select(*keys, "add_id", _micros(adds).alias("_at")), "cart_adds")
    valid = placed.dropna(subset=[*keys, "add_id", "_at"])
    folded = valid.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_lo"), F.max("_at").alias("_hi"),
        F.min("add_id").alias("_lo_id"), F.max("add_id").alias("_hi_id"),
    )
    limits = stock.select(*on, F.col("stock").cast("long").alias("_need")).filter("_need > 0")
    pairs = write_table(folded.join(limits, list(on)), "cart_pairs")
    state = pairs.filter("_n > _need")
    for col, lo, hi in (("_at", "_lo", "_hi"), ("add_id", "_lo_id", "_hi_id")):
        open_ = (F.col("_n") > edge_rows) & (F.col(lo) < F.col(hi))
        while not state.filter(open_).isEmpty():
            cut = _narrowed(valid, state.filter(open_), keys, col, lo, hi)
            state = write_table(state.filter(~open_).unionByName(cut), "cart_ranges")
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("_at", "add_id"))
    edges = _in_range(valid, state, keys).withColumn("_nth", nth).filter("_nth = _need")
    last = edges.select(*keys, F.col("_at").alias("_last"), F.col("add_id").alias("_last_id"))
    covered = pairs.filter("_n <= _need").select(*keys, F.col("_hi").alias("_last"), F.col("_hi_id").alias("_last_id"))
    lasts = sized_side(last.unionByName(covered), "cart_lasts")
    accepted = F.expr("coalesce(_at < _last or (_at = _last and add_id <= _last_id), false)")
    return placed.join(lasts, keys, "left").select(*keys, "add_id", accepted.alias("accepted"))
