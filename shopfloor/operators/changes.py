"""Set-based writes: each operator takes the current snapshot(s) and a change
batch (DataFrames) and returns the new snapshot(s), to be written by the
caller.

All new snapshots are computed from the old ones before anything is written,
so a multi-table change is all-or-nothing at the write step.  Batches are
never collected; duplicate keys in a batch are resolved first (updates: last
by ``seq``, ties by the larger value; inserts: the first) so joins never
multiply rows.  Rows of an insert that are not applied come back as rejects;
updates and removals have a ``*_rejects`` operator beside them.  An update or
removal given an ``Observation`` (``touched``) counts the rows it changes while
the new snapshot is written, without a job of its own: after the write,
``touched.get["touched"]`` is the number of rows.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.exprs import round_half_up_1, sku_image, volume
from ..plans.batches import first_rows, last_per_key, last_value, sum_per_key
from ..plans.ids import max_id, number_rows
from ..plans.joins import counted_side, fixed_broadcast, maybe_broadcast
from ..plans.materialize import sized_side, write_counted, write_table


def _seq(batch: DataFrame) -> list[Column]:
    return [F.col("seq")] if "seq" in batch.columns else []


def _apply_updates(
    base: DataFrame, changes: DataFrame, keys: Sequence[str], cols: Sequence[str], guard: Column | None = None, touched: Observation | None = None
) -> DataFrame:
    """Left join ``changes`` (one row per key) and take the new value where
    matched (and where ``guard``, a condition on the base row, holds)."""
    renamed = changes.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in cols]).withColumn("_hit", F.lit(True))
    # a batch is usually far smaller than the snapshot: ship it to the snapshot's
    # tasks when its size check passes instead of shuffling the whole snapshot
    joined = base.join(sized_side(renamed, "changes"), list(keys), "left")
    hit = F.coalesce(F.col("_hit"), F.lit(False))
    if guard is not None:
        hit = hit & F.coalesce(guard, F.lit(False))
    joined = _counted(joined, hit, touched)
    out = [
        F.when(hit, F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in cols else F.col(c)
        for c in base.columns
    ]
    return joined.select(*out)


def _counted(rows: DataFrame, hit: Column, touched: Observation | None) -> DataFrame:
    """``rows`` that report how many of them are ``hit`` to ``touched``, where one is given."""
    return rows if touched is None else rows.observe(touched, F.count_if(hit).alias("touched"))


def _remove(base: DataFrame, gone: DataFrame, keys: Sequence[str], touched: Observation | None) -> DataFrame:
    """Rows of ``base`` whose keys are not in ``gone`` (distinct keys where ``touched`` is given)."""
    if touched is None:
        return base.join(gone, list(keys), "left_anti")
    hit = F.coalesce(F.col("_gone"), F.lit(False))
    marked = base.join(maybe_broadcast(gone.withColumn("_gone", F.lit(True))), list(keys), "left")
    return _counted(marked, hit, touched).filter(~hit).select(*base.columns)


def audit_updates(base: DataFrame, requests: DataFrame, keys: Sequence[str], order: Sequence[str] = (), editable: Column | None = None) -> DataFrame:
    """Every update request with its ``reason``: NULL where it is applied, else unknown, locked or superseded.

    A request is unknown when ``base`` has no row of its key (a null key never
    has one), locked when no row of its key is ``editable`` (a condition on the
    base row), superseded when a later request of the batch has the same key:
    the greatest by ``order`` is applied.  Only the asked keys of ``base`` are
    looked at; applied and rejected requests together are the batch.
    """
    batch = _numbered_batch(requests, "update_requests")
    asked = sized_side(batch.select(*keys).distinct(), "update_asked")
    open_ = F.coalesce(editable, F.lit(False)) if editable is not None else F.lit(True)
    found = base.join(asked, list(keys), "left_semi").select(*keys, open_.alias("_open")).groupBy(*keys).agg(F.bool_or("_open").alias("_open"))
    last = batch.groupBy(*keys).agg(F.max(F.struct(*order, "_rid"))["_rid"].alias("_rid")).select("_rid", F.lit(True).alias("_last"))
    reason = (
        F.when(F.col("_open").isNull(), "unknown").when(~F.col("_open"), "locked").when(F.col("_last").isNull(), "superseded")
    )
    return batch.join(found, list(keys), "left").join(last, "_rid", "left").select(*requests.columns, reason.alias("reason"))


# ---- prices ---------------------------------------------------------------


@dataclass
class PricesChange:
    prices: DataFrame
    rejects: DataFrame


def _numbered_batch(batch: DataFrame, name: str) -> DataFrame:
    """The batch with a row id, written once so that every output sees the same ids."""
    return write_table(batch.withColumn("_rid", F.monotonically_increasing_id()), name)


def add_prices(prices: DataFrame, items: DataFrame, adds: DataFrame) -> PricesChange:
    """Insert (sku, country_id, retailprice) prices where the (item, country) has none.

    Rows are inserted one after the other, so the first of a repeated pair wins
    (by ``seq``, then the smaller price).  Every row that is not inserted is in
    ``rejects`` with the reason: unknown sku, already priced, or repeated.
    """
    ids = items.groupBy(F.col("id").alias("item_id"), "sku").agg(F.count(F.lit(1)).cast("int").alias("_times"))
    batch = adds.join(ids, "sku", "left")
    seq = ["seq"] if "seq" in adds.columns else []
    # existing prices go before the batch's rows of their pair, so one pass over a pair judges all of its rows
    held = prices.select(*[F.col(c).cast(batch.schema[c].dataType).alias(c) for c in ("item_id", "country_id")]).dropna()
    both = batch.withColumn("_add", F.lit(1)).unionByName(held.withColumn("_add", F.lit(0)), allowMissingColumns=True)
    # rows of unknown items have no pair: they are dealt out by their own values
    alone = F.when(F.col("item_id").isNull(), F.xxhash64(*adds.columns))
    pair = Window.partitionBy("item_id", "country_id", alone).orderBy("_add", *seq, "retailprice", "sku")
    reason = (
        F.when(F.col("item_id").isNull(), "unknown sku")
        .when(F.min("_add").over(pair) == 0, "already priced")
        .when(F.row_number().over(pair) > 1, "repeated in the batch")
    )
    judged = both.withColumn("reason", reason).filter("_add = 1")
    # an item listed more than once takes the row as often
    judged = judged.select("sku", "item_id", "country_id", "retailprice", "reason", F.explode(F.array_repeat(F.lit(0), F.coalesce("_times", F.lit(1)))).alias("_n"))
    ranked = write_table(judged.drop("_n"), "price_adds_checked")
    fresh = ranked.filter("reason is null").select(*prices.columns)
    rejects = ranked.filter("reason is not null").select("sku", "country_id", "retailprice", "reason")
    return PricesChange(prices=prices.unionByName(fresh), rejects=rejects)


def update_prices(prices: DataFrame, updates: DataFrame, touched: Observation | None = None) -> DataFrame:
    """Set new prices by (item_id, country_id), rounded half-up to one decimal.

    Pairs without a price are not inserted (the update touches no row).
    """
    one = last_value(updates, ["item_id", "country_id"], "retailprice")
    one = one.withColumn("retailprice", round_half_up_1("retailprice"))
    return _apply_updates(prices, one, ["item_id", "country_id"], ["retailprice"], touched=touched)


def update_prices_rejects(prices: DataFrame, updates: DataFrame) -> DataFrame:
    """Price updates that ``update_prices`` does not apply, with the reason (see ``audit_updates``)."""
    order = [*(["seq"] if "seq" in updates.columns else []), "retailprice"]
    return audit_updates(prices, updates, ["item_id", "country_id"], order).filter("reason is not null")


def remove_prices(prices: DataFrame, keys: DataFrame, touched: Observation | None = None) -> DataFrame:
    """Delete prices whose (item_id, country_id) is in ``keys``."""
    pairs = keys.select("item_id", "country_id").distinct()
    return _remove(prices, sized_side(pairs, "price_keys"), ["item_id", "country_id"], touched)


def remove_prices_rejects(prices: DataFrame, keys: DataFrame) -> DataFrame:
    """Removals that find no price, or repeat another of the batch (superseded)."""
    return audit_updates(prices, keys, ["item_id", "country_id"]).filter("reason is not null")


# ---- items ----------------------------------------------------------------


@dataclass
class ItemsChange:
    items: DataFrame
    subtypes: DataFrame
    rejects: DataFrame


def add_items(items: DataFrame, subtypes: DataFrame, new: DataFrame) -> ItemsChange:
    """Add items: reject invalid rows and known SKUs, give ids, split base + subtype.

    ``new`` has sku, name, category, description, dtype, length, width,
    height (and optionally seq).  Text fields must be non-empty, the subtype one
    of the known ones and every dimension a whole number of at least 1.  Rows
    are added one after the other, so the first valid row of a repeated SKU
    wins (by ``seq``, then by its fields) and the others are rejected.  Every
    row is either added or in ``rejects`` with its reasons.  New ids continue
    after the largest id, in SKU order.  Furniture and retail products get the
    image ``/img/products/<sku>.jpg``; raw materials none.
    """
    text_ok = F.lit(True)
    for c in ("sku", "name", "category", "description"):
        text_ok = text_ok & F.coalesce(F.length(F.trim(F.col(c))) > 0, F.lit(False))
    type_ok = F.coalesce(F.col("dtype").isin(*K.SUBTYPE_TYPE), F.lit(False))
    dims_ok, whole = F.lit(True), F.lit(True)
    for c in ("length", "width", "height"):
        dims_ok = dims_ok & F.coalesce(F.col(c) >= 1, F.lit(False))
        whole = whole & F.coalesce(F.col(c) == F.floor(F.col(c)), F.lit(True))
    batch = _numbered_batch(new, "new_items")
    # only the proposed SKUs of the item table are looked at
    proposed = sized_side(batch.select("sku").distinct(), "new_items_skus")
    taken = items.select("sku").join(proposed, "sku", "left_semi").distinct().withColumn("_taken", F.lit(True))
    checked = batch.join(taken, "sku", "left").withColumn("_reason", F.concat_ws(
        "; ",
        F.when(~text_ok, F.lit("missing required field")),
        F.when(~type_ok, F.lit("unknown type")),
        F.when(~dims_ok, F.lit("dimension below 1")),
        F.when(~whole, F.lit("dimension not a whole number")),
        F.when(F.col("_taken"), F.lit("sku already in use")),
    ))
    fields = [c for c in new.columns if c not in ("sku", "seq")]
    valid = first_rows(checked.filter("_reason = ''"), ["sku"], [*(["seq"] if "seq" in new.columns else []), *fields])
    valid = write_table(valid, "new_items_valid")
    rejects = checked.filter("_reason <> ''").select("sku", F.col("_reason").alias("reason")).unionByName(
        valid.filter(~F.col("_first")).select("sku", F.lit("repeated in the batch").alias("reason"))
    )
    fresh = valid.filter("_first").select("sku", *fields)
    start = max_id(items)
    numbered = number_rows(fresh, ["sku"], id_col="id", start=start)
    derived = {
        "isdeleted": F.lit(False),
        # filled when the snapshot keeps them: volume and the subtype's type text
        "volume": volume("length", "width", "height"),
        "type": F.element_at(F.create_map(*[F.lit(x) for kv in K.SUBTYPE_TYPE.items() for x in kv]), F.col("dtype")),
    }
    base_rows = numbered.select(
        *[derived[c].cast(items.schema[c].dataType).alias(c) if c in derived and c not in fresh.columns else F.col(c)
          for c in items.columns]
    )
    image = F.when(F.col("dtype") == "RawMaterialEntity", F.lit(None).cast("string")).otherwise(sku_image("sku"))
    sub_rows = numbered.select("id", image.alias("imageurl"))
    return ItemsChange(
        items=items.unionByName(base_rows.select(*items.columns)),
        subtypes=subtypes.unionByName(sub_rows.select(*subtypes.columns)),
        rejects=rejects,
    )


ITEM_FIELDS = ("name", "category", "description")


def update_items(items: DataFrame, updates: DataFrame, touched: Observation | None = None) -> DataFrame:
    """Set name, category and description by id."""
    cols = list(ITEM_FIELDS)
    one = last_per_key(updates.select("id", *cols, *(["seq"] if "seq" in updates.columns else [])), ["id"],
                       [*_seq(updates), F.struct(*cols)]).drop("seq")
    return _apply_updates(items, one, ["id"], cols, touched=touched)


def update_items_rejects(items: DataFrame, updates: DataFrame) -> DataFrame:
    """Item updates that ``update_items`` does not apply, with the reason (see ``audit_updates``)."""
    order = [*(["seq"] if "seq" in updates.columns else []), *ITEM_FIELDS]
    return audit_updates(items, updates, ["id"], order).filter("reason is not null")


@dataclass
class RemoveItems:
    items: DataFrame
    subtypes: DataFrame
    prices: DataFrame


def remove_items(items: DataFrame, subtypes: DataFrame, prices: DataFrame, ids: DataFrame, touched: Observation | None = None) -> RemoveItems:
    """Delete items with their subtype rows and all their prices (one key set, three anti joins); ``touched`` counts items."""
    keys = sized_side(ids.select("id").distinct(), "item_keys")
    return RemoveItems(
        items=_remove(items, keys, ["id"], touched),
        subtypes=subtypes.join(keys, "id", "left_anti"),
        prices=prices.join(keys.withColumnRenamed("id", "item_id"), "item_id", "left_anti"),
    )


def remove_items_rejects(items: DataFrame, ids: DataFrame) -> DataFrame:
    """Removals of unknown items, or that repeat another of the batch (superseded)."""
    return audit_updates(items, ids, ["id"]).filter("reason is not null")


# ---- lines ----------------------------------------------------------------


@dataclass
class LinesChange:
    rejects: DataFrame
    build: Callable[[], DataFrame]

    @cached_property
    def lines(self) -> DataFrame:
        """The new snapshot; its batch of changes is written when it is first asked for."""
        return self.build()


def set_store_quantity(lines: DataFrame, stores: DataFrame, bins: DataFrame, items: DataFrame, requests: DataFrame) -> LinesChange:
    """Set the quantity of an item in the Outbound bin of a named store's warehouse.

    ``requests`` has store_name, sku, quantity (and optionally seq).  Two
    requests reaching the same (bin, item) keep the last one.  A store name
    may stand for several stores and a warehouse may have several Outbound
    bins: a request that reaches one line at least is applied there.  Any
    other request is in ``rejects``, once: unknown store, unknown sku, no
    outbound bin, or no line of the item in the bins.
    """
    batch = write_table(requests, "store_requests")
    st = stores.select(F.col("name").alias("store_name"), "warehouse_id")
    ob = bins.filter(F.col("type") == K.BIN_OUTBOUND).select(F.col("id").alias("bin_id"), "warehouse_id")
    it = items.select(F.col("id").alias("item_id"), "sku")
    # what a store name and a sku reach is found from the lines, so no request is repeated for the
    # stores and bins that it may mean
    shown = lines.select("bin_id", "item_id").join(maybe_broadcast(ob), "bin_id").join(maybe_broadcast(st), "warehouse_id")
    held = shown.join(it, "item_id").select("store_name", "sku")
    lost = batch.join(held, ["store_name", "sku"], "left_anti")
    names = st.join(ob, "warehouse_id", "left").groupBy("store_name").agg(F.count("bin_id").alias("_bins"))
    known = it.select("sku").distinct().withColumn("_sku", F.lit(True))
    judged = lost.join(maybe_broadcast(names), "store_name", "left").join(known, "sku", "left")
    reason = (
        F.when(F.col("_bins").isNull(), "unknown store").when(F.col("_sku").isNull(), "unknown sku")
        .when(F.col("_bins") == 0, "no outbound bin").otherwise("no line of the item")
    )
    rejects = judged.select("store_name", "sku", "quantity", reason.alias("reason"))

    def build() -> DataFrame:
        targets = batch.join(maybe_broadcast(st.join(ob, "warehouse_id").select("store_name", "bin_id")), "store_name").join(it, "sku")
        one = last_value(targets, ["bin_id", "item_id"], "quantity")
        return _apply_updates(lines, one, ["bin_id", "item_id"], ["quantity"])

    return LinesChange(rejects=rejects, build=build)


def _by_id(changes: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``changes`` dealt by line id before they are grouped: nearly every id stands once, so a task would
    only fill its memory with the ids of its whole split before the shuffle."""
    return changes.select("id", *cols).repartition("id")


def _editable(lines: DataFrame, keyed: DataFrame, orders: DataFrame | None) -> DataFrame:
    """The rows of ``keyed`` (one per line id) that may be applied: with ``orders``, lines of an order that is not Pending are locked."""
    if orders is None:
        return keyed
    keyed, rows = write_counted(keyed, "line_keys")
    ids = keyed.select("id")
    asked = lines.select("id", "order_id").join(counted_side(ids, rows), "id", "left_semi")
    locked = orders.filter(F.coalesce(F.col("status") != K.PENDING, F.lit(True))).select(F.col("id").alias("order_id"))
    open_ = asked.join(locked.hint("merge"), "order_id", "left_anti").select("id")
    return keyed.join(open_.hint("merge"), "id", "left_semi")


def update_line_quantity(
    lines: DataFrame, changes: DataFrame, mode: str = "set", orders: DataFrame | None = None, touched: Observation | None = None
) -> DataFrame:
    """Set (``mode='set'``, last change wins) or add (``mode='add'``, deltas summed) line quantities by id.

    With ``orders``, only lines whose order is Pending (or that belong to none of them) change: the edit lock.
    """
    if mode == "add":
        deltas = _editable(lines, sum_per_key(_by_id(changes, ["quantity"]), ["id"], "quantity"), orders).withColumnRenamed("quantity", "_d")
        joined = lines.join(counted_side(*write_counted(deltas.withColumn("_hit", F.lit(True)), "line_deltas")), "id", "left")
        joined = _counted(joined, F.coalesce(F.col("_hit"), F.lit(False)), touched)
        return joined.select(
            *[(F.col(c) + F.coalesce(F.col("_d"), F.lit(0))).cast("long").alias(c) if c == "quantity" else F.col(c)
              for c in lines.columns]
        )
    one = last_value(_by_id(changes, ["quantity", *(["seq"] if "seq" in changes.columns else [])]), ["id"], "quantity")
    return _apply_updates(lines, _editable(lines, one, orders), ["id"], ["quantity"], touched=touched)


def update_line_quantity_rejects(lines: DataFrame, changes: DataFrame, mode: str = "set", orders: DataFrame | None = None) -> DataFrame:
    """Line changes that ``update_line_quantity`` does not apply, with the reason (see ``audit_updates``; deltas never supersede)."""
    order = [*(["seq"] if "seq" in changes.columns else []), "quantity"]
    judged = _audit_lines(lines, changes, order, orders)
    wanted = F.col("reason").isNotNull() if mode == "set" else F.col("reason").isin("unknown", "locked")
    return judged.filter(wanted)


def _audit_lines(lines: DataFrame, changes: DataFrame, order: Sequence[str], orders: DataFrame | None) -> DataFrame:
    """``audit_updates`` of requests by line id; with ``orders``, lines of a non-Pending order are locked."""
    asked = sized_side(changes.select("id").distinct(), "line_audit_keys")
    base = lines.select("id", "order_id").join(asked, "id", "left_semi")
    editable = None
    if orders is not None:
        status = orders.select(F.col("id").alias("order_id"), F.coalesce("status", F.lit("")).alias("_status"))
        base = base.join(status, "order_id", "left")
        editable = F.coalesce("_status", F.lit(K.PENDING)) == K.PENDING
    return audit_updates(base, changes, ["id"], order, editable)


def remove_order_lines(lines: DataFrame, line_ids: DataFrame, orders: DataFrame | None = None, touched: Observation | None = None) -> DataFrame:
    """Delete lines (and with them their order links) by line id; with ``orders``, lines of a non-Pending order stay."""
    ids = _by_id(line_ids, []).distinct()
    return _remove(lines, sized_side(_editable(lines, ids, orders), "line_keys_open"), ["id"], touched)


def remove_order_lines_rejects(lines: DataFrame, line_ids: DataFrame, orders: DataFrame | None = None) -> DataFrame:
    """Removals of unknown or locked lines, or that repeat another of the batch (superseded)."""
    return _audit_lines(lines, line_ids, [], orders).filter("reason is not null")


# ---- orders ---------------------------------------------------------------


def update_orders(orders: DataFrame, changes: DataFrame, editable_status: str = K.PENDING, touched: Observation | None = None) -> DataFrame:
    """Set expected date, origin and destination by id; only Pending orders are editable."""
    cols = [c for c in ("expecteddate", "origin_id", "supplier_id", "destination_id") if c in changes.columns]
    one = last_per_key(changes.select("id", *cols, *(["seq"] if "seq" in changes.columns else [])), ["id"],
                       [*_seq(changes), F.struct(*cols)]).drop("seq")
    # the edit lock is a condition on the order row itself: no join against all orders
    return _apply_updates(orders, one, ["id"], cols, guard=F.col("status") == editable_status, touched=touched)


def update_orders_rejects(orders: DataFrame, changes: DataFrame, editable_status: str = K.PENDING) -> DataFrame:
    """Order updates that ``update_orders`` does not apply, with the reason (see ``audit_updates``)."""
    cols = [c for c in ("expecteddate", "origin_id", "supplier_id", "destination_id") if c in changes.columns]
    order = [*(["seq"] if "seq" in changes.columns else []), *cols]
    return audit_updates(orders, changes, ["id"], order, F.col("status") == editable_status).filter("reason is not null")


@dataclass
class StatusChange:
    orders: DataFrame
    rejects: DataFrame


def transition_table(spark) -> DataFrame:
    """Allowed (status, new_status, needs_lines) rows: a fixed five-row table."""
    return spark.createDataFrame(
        [(a, b, need) for a, b, need in K.STATUS_TRANSITIONS], "status string, new_status string, needs_lines boolean"
    )


def apply_status(orders: DataFrame, lines: DataFrame, changes: DataFrame, as_of: _dt.date) -> StatusChange:
    """Move orders through the status machine.

    Pending -> Submitted needs at least one line; Submitted -> Shipped or
    Unfulfillable; Shipped -> Completed or Unfulfillable; the last two are
    final.  Moving to Shipped stamps ``shippeddate`` with ``as_of``.  Other
    changes go to ``rejects`` with the reason.
    """
    spark = orders.sparkSession
    one = last_per_key(changes.select("id", "new_status", *(["seq"] if "seq" in changes.columns else [])), ["id"],
                       [*_seq(changes), F.col("new_status")]).drop("seq")
    # written once: its rows decide the broadcast of the id list below
    one, rows = write_counted(one, "status_requests")
    ids = counted_side(one.select("id"), rows)
    rules = fixed_broadcast(transition_table(spark))
    # only the requested orders and their lines are read past the scan (map-side semi joins, where the batch is small)
    cur = orders.select("id", "status").join(ids, "id", "left_semi")
    counted = (
        lines.select(F.col("order_id").alias("id"))
        .join(ids, "id", "left_semi")
        .groupBy("id")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    checked = (
        one.join(counted_side(cur, rows), "id", "left")
        .join(counted_side(counted, rows), "id", "left")
        .join(rules, ["status", "new_status"], "left")
    )
    n = F.coalesce(F.col("_n"), F.lit(0))
    reason = (
        F.when(F.col("status").isNull(), F.lit("unknown order"))
        .when(F.col("needs_lines").isNull(), F.concat(F.lit("not allowed: "), F.col("status"), F.lit(" -> "), F.col("new_status")))
        .when(F.col("needs_lines") & (n == 0), F.lit("order has no lines"))
    )
    checked = checked.withColumn("reason", reason)
    ok = checked.filter(F.col("reason").isNull()).select("id", F.col("new_status").alias("status"))
    rejects = checked.filter(F.col("reason").isNotNull()).select(
        "id", F.col("status").alias("from_status"), F.col("new_status").alias("to_status"), "reason"
    )
    day = F.lit(as_of).cast("timestamp_ntz")
    moved = ok.withColumn("_ship", F.when(F.col("status") == K.SHIPPED, day))
    renamed = moved.select("id", F.col("status").alias("_new_status"), "_ship", F.lit(True).alias("_hit"))
    # planned, not run: the new snapshot costs nothing where only the rejects are asked for
    joined = orders.join(counted_side(renamed, rows), "id", "left")
    out = []
    for c in orders.columns:
        if c == "status":
            out.append(F.when(F.col("_hit"), F.col("_new_status")).otherwise(F.col(c)).alias(c))
        elif c == "shippeddate":
            out.append(F.when(F.col("_hit") & F.col("_ship").isNotNull(), F.col("_ship")).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    return StatusChange(orders=joined.select(*out), rejects=rejects)


def set_status(orders: DataFrame, changes: DataFrame, touched: Observation | None = None) -> DataFrame:
    """Set the status of orders by id without a state machine (purchase orders); the last change wins."""
    one = last_value(changes.withColumnRenamed("new_status", "status"), ["id"], "status")
    return _apply_updates(orders, one, ["id"], ["status"], touched=touched)


def set_status_rejects(orders: DataFrame, changes: DataFrame) -> DataFrame:
    """Status changes that ``set_status`` does not apply, with the reason (see ``audit_updates``)."""
    order = [*(["seq"] if "seq" in changes.columns else []), "new_status"]
    return audit_updates(orders, changes, ["id"], order).filter("reason is not null")


@dataclass
class Receipt:
    lines: DataFrame
    orders: DataFrame
    rejects: DataFrame


def receive_shipments(orders: DataFrame, lines: DataFrame, bins: DataFrame, receipts: DataFrame) -> Receipt:
    """Complete shipped orders and put their goods into the destination's inbound bin.

    For each order in ``receipts`` (column ``id``): it must be Shipped and its
    destination must have an Inbound bin (the lowest id); otherwise it is
    rejected.  The order's line quantities are summed per item; an item the
    bin already holds credits the bin's lowest-id line of that item, a new
    item becomes a new line in the bin (ids continue after the largest,
    ordered by bin and item).  Accepted orders become Completed.  As in the
    store, the origin warehouse's stock is not reduced (the goods left it
    when the order shipped, outside this flow).
    """
    inbound = bins.filter(F.col("type") == K.BIN_INBOUND).groupBy("warehouse_id").agg(F.min("id").alias("bin_id"))
    wanted = sized_side(receipts.select("id").distinct(), "receipts")
    # the requested orders are picked out map-side; unknown ids survive the outer join
    known = orders.select("id", "status", F.col("destination_id").alias("warehouse_id")).join(wanted, "id", "left_semi")
    cur = wanted.join(known, "id", "left")
    located = cur.join(maybe_broadcast(inbound), "warehouse_id", "left")
    reason = (
        F.when(F.col("status").isNull(), F.lit("unknown order"))
        .when(F.col("status") != K.SHIPPED, F.concat(F.lit("not shipped: "), F.col("status")))
        .when(F.col("bin_id").isNull(), F.lit("no inbound bin"))
    )
    located = located.withColumn("reason", reason)
    rejects = located.filter(F.col("reason").isNotNull()).select(F.col("id").alias("order_id"), "reason")
    accepted = sized_side(located.filter(F.col("reason").isNull()).select(F.col("id").alias("order_id"), "bin_id"), "accepted")

    received = (
        lines.select("order_id", "item_id", "quantity")
        .join(accepted, "order_id")
        .groupBy("bin_id", "item_id")
        .agg(F.sum("quantity").alias("_add"))
    )
    received = sized_side(received, "received")
    # the line that takes the credit: lowest id of the item in the bin, with the sum it receives
    holders = (
        lines.select("id", "bin_id", "item_id")
        .join(received.select("bin_id", "item_id"), ["bin_id", "item_id"], "left_semi")
        .groupBy("bin_id", "item_id")
        .agg(F.min("id").alias("id"))
        .join(received, ["bin_id", "item_id"])
    )
    holders = write_table(holders, "holders")  # read twice below: the line table is scanned once
    # one join on the line id, with a written (size-proven) side: no key is null and the snapshot is
    # streamed past a broadcast, or shuffled once beyond its bound
    credited = lines.join(maybe_broadcast(holders.select("id", "_add")), "id", "left").select(
        *[(F.col(c) + F.coalesce(F.col("_add"), F.lit(0))).cast("long").alias(c) if c == "quantity" else F.col(c)
          for c in lines.columns]
    )
    fresh = received.join(holders, ["bin_id", "item_id"], "left_anti")
    start = max_id(lines)
    new_lines = number_rows(fresh, ["bin_id", "item_id"], id_col="id", start=start).select(
        *[
            F.col("_add").cast("long").alias(c) if c == "quantity"
            else F.lit(None).cast("long").alias(c) if c == "order_id"
            else F.col(c)
            for c in lines.columns
        ]
    )
    done = accepted.select(F.col("order_id").alias("id"), F.lit(K.COMPLETED).alias("_st"))
    new_orders = orders.join(done, "id", "left").select(
        *[F.coalesce(F.col("_st"), F.col(c)).alias(c) if c == "status" else F.col(c) for c in orders.columns]
    )
    return Receipt(lines=credited.unionByName(new_lines), orders=new_orders, rejects=rejects)


# ---- people ---------------------------------------------------------------


PASSWORD_FIELDS = ("passwordhash", "passwordsalt", "passwordreset", "securityanswer")


PROFILE_FIELDS = ("name", "phone", "address", "zipcode")


def _profile_fields(people: DataFrame, changes: DataFrame, key: str, cols: Sequence[str] | None) -> list[str]:
    wanted = [c for c in (cols or changes.columns) if c not in (key, "seq") and c in people.columns and c in changes.columns]
    return [c for c in wanted if c.lower() not in PASSWORD_FIELDS]


def update_profiles(
    people: DataFrame, changes: DataFrame, key: str = "email", cols: Sequence[str] | None = None, touched: Observation | None = None
) -> DataFrame:
    """Set profile fields of members or staff by ``key`` (password fields are never changed here)."""
    wanted = _profile_fields(people, changes, key, cols)
    one = last_per_key(changes.select(key, *wanted, *(["seq"] if "seq" in changes.columns else [])), [key],
                       [*_seq(changes), F.struct(*wanted)]).drop("seq")
    return _apply_updates(people, one, [key], wanted, touched=touched)


def update_profiles_rejects(people: DataFrame, changes: DataFrame, key: str = "email", cols: Sequence[str] | None = None) -> DataFrame:
    """Profile updates that ``update_profiles`` does not apply, with the reason (see ``audit_updates``)."""
    order = [*(["seq"] if "seq" in changes.columns else []), *_profile_fields(people, changes, key, cols)]
    return audit_updates(people, changes, [key], order).filter("reason is not null")


def update_members(members: DataFrame, changes: DataFrame, cols: Sequence[str] = PROFILE_FIELDS, touched: Observation | None = None) -> DataFrame:
    """Set member profile and delivery fields by email."""
    return update_profiles(members, changes, "email", cols, touched)


def update_staff(staff: DataFrame, changes: DataFrame, key: str = "email", touched: Observation | None = None) -> DataFrame:
    """Set staff profile fields (id number, name, phone, address, ...) by email."""
    return update_profiles(staff, changes, key, touched=touched)


# ---- appends --------------------------------------------------------------


def append_orders(
    orders: DataFrame, new: DataFrame, as_of: _dt.datetime | _dt.date, order_by: Sequence[str], after: int | None = None
) -> DataFrame:
    """Append order headers: status Pending, created ``as_of``; ids continue after the largest.

    ``new`` carries the header fields the caller sets (expected date, origin
    or supplier, destination); ``order_by`` fixes the id order (a total order).
    ``after`` overrides the id to continue from (ids shared with another table).
    """
    start = max_id(orders) if after is None else after
    numbered = number_rows(new, list(order_by), id_col="id", start=start)
    filled = numbered.withColumn("status", F.lit(K.PENDING)).withColumn(
        "createddate", F.lit(as_of).cast("timestamp_ntz")
    )
    for c in orders.columns:
        if c not in filled.columns:
            filled = filled.withColumn(c, F.lit(None).cast(orders.schema[c].dataType))
    return orders.unionByName(filled.select(*orders.columns))


def append_lines(lines: DataFrame, new: DataFrame, order_by: Sequence[str], orders: DataFrame | None = None) -> DataFrame:
    """Append line items (quantity, item and links); ids continue after the largest.

    With ``orders``, a line of an unknown or non-Pending order is not added (the edit lock).
    """
    if orders is not None:
        new = _judged_lines(new, orders).filter("reason is null").drop("reason")
    start = max_id(lines)
    numbered = number_rows(new, list(order_by), id_col="id", start=start)
    for c in lines.columns:
        if c not in numbered.columns:
            numbered = numbered.withColumn(c, F.lit(None).cast(lines.schema[c].dataType))
    return lines.unionByName(numbered.select(*[F.col(c).cast(lines.schema[c].dataType) for c in lines.columns]))


def append_lines_rejects(new: DataFrame, orders: DataFrame) -> DataFrame:
    """New lines that ``append_lines`` refuses under ``orders``: their order is unknown or locked."""
    return _judged_lines(new, orders).filter("reason is not null")


def _judged_lines(new: DataFrame, orders: DataFrame) -> DataFrame:
    """``new`` with its ``reason``; a line of no order is never refused.  Only the asked orders are looked at."""
    asked = sized_side(new.select(F.col("order_id").alias("id")).distinct(), "line_adds_orders")
    open_ = F.coalesce(F.col("status") == K.PENDING, F.lit(False))
    known = orders.join(asked, "id", "left_semi").select(F.col("id").alias("order_id"), open_.alias("_open"))
    known = sized_side(known, "line_adds_status")
    reason = F.when(F.col("order_id").isNull(), None).when(F.col("_open").isNull(), "unknown").when(~F.col("_open"), "locked")
    return new.join(known, "order_id", "left").select(*new.columns, reason.alias("reason"))


def append_sales(sales: DataFrame, new: DataFrame, as_of: _dt.datetime | _dt.date, order_by: Sequence[str]) -> DataFrame:
    """Append sales records: amount due = amount paid, currency SGD, created ``as_of``."""
    start = max_id(sales)
    numbered = number_rows(new, list(order_by), id_col="id", start=start)
    rows = numbered.select(
        "id", "member_id", F.lit(as_of).cast("timestamp_ntz").alias("createddate"),
        F.col("amount").alias("amountdue"), F.col("amount").alias("amountpaid"), F.lit(K.SALE_CURRENCY).alias("currency"),
    )
    return sales.unionByName(rows.select(*[F.col(c).cast(sales.schema[c].dataType) for c in sales.columns]))


def append_rows(table: DataFrame, new: DataFrame) -> DataFrame:
    """Append rows by column name (delivery details, feedback); missing columns are NULL."""
    for c in table.columns:
        if c not in new.columns:
            new = new.withColumn(c, F.lit(None).cast(table.schema[c].dataType))
    return table.unionByName(new.select(*[F.col(c).cast(table.schema[c].dataType) for c in table.columns]))
