"""Purchase and shipping orders, their lines, suppliers, sales history, validation."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..plans.joins import maybe_broadcast
from ..sources.fixtures import RetailTables


def purchase_orders(t: RetailTables, newest_first: bool = True) -> DataFrame:
    """Purchase orders with supplier and destination warehouse names.

    Sorted newest first (ties by id so the order is total): a range-partitioned
    sort, no single-task step.
    """
    wh = t.warehouse.select(F.col("id").alias("destination_id"), "warehousename")
    sup = t.supplier.select(F.col("id").alias("supplier_id"), "suppliername")
    rows = t.purchaseorder.join(maybe_broadcast(wh), "destination_id").join(maybe_broadcast(sup), "supplier_id")
    rows = rows.select(*t.purchaseorder.columns, "suppliername", "warehousename")
    if newest_first:
        rows = rows.orderBy(F.col("createddate").desc(), F.col("id").desc())
    return rows


def shipping_orders(t: RetailTables) -> DataFrame:
    """Shipping orders with destination and origin names (the warehouse dimension joined twice)."""
    dest = t.warehouse.select(F.col("id").alias("destination_id"), F.col("warehousename").alias("destination_name"))
    orig = t.warehouse.select(F.col("id").alias("origin_id"), F.col("warehousename").alias("origin_name"))
    rows = t.shippingorder.join(maybe_broadcast(dest), "destination_id").join(maybe_broadcast(orig), "origin_id")
    return rows.select(*t.shippingorder.columns, "destination_name", "origin_name")


def order_lines(t: RetailTables, orders: DataFrame) -> DataFrame:
    """Lines of the given orders with the full item row: (order_id, lineitem_id, quantity, item columns)."""
    keys = orders.select(F.col("id").alias("order_id"))
    lines = t.line.select("order_id", F.col("id").alias("lineitem_id"), "quantity", F.col("item_id").alias("id"))
    return lines.join(keys, "order_id", "left_semi").join(t.item, "id").select(
        "order_id", "lineitem_id", "quantity", *t.item.columns
    )


def supplier_catalog(t: RetailTables) -> DataFrame:
    """Every supplier's items: cost, lead time, lot size and the item's SKU, name, subtype."""
    items = t.item.select(F.col("id").alias("item_id"), "sku", "name", "dtype")
    return t.supplier_item.join(items, "item_id").select(
        "supplier_id", "item_id", "costprice", "leadtime", "lotsize", "sku", "name", "dtype"
    )


def purchase_history(t: RetailTables, country_id) -> DataFrame:
    """Furniture each member bought, at today's price in one country, with delivery details.

    Inner joins as in the store: a sale without delivery row, or an item
    without a price in the country, drops out.
    """
    furniture = (
        t.item.filter(F.col("dtype") == "FurnitureEntity")
        .join(t.subtype, "id")
        .select(F.col("id").alias("item_id"), "sku", F.col("name").alias("item_name"), "imageurl")
    )
    prices = t.item_country.filter(F.col("country_id") == F.lit(country_id)).select("item_id", "retailprice")
    priced = furniture.join(prices, "item_id")
    sales = t.sale.select(F.col("id").alias("sale_id"), "member_id", "createddate")
    delivery = t.delivery.select(F.col("salerecord_id").alias("sale_id"), "name", "delivery_address")
    # one row per sale first; then the lines meet a single join on the sale id,
    # whose hot sales AQE can split (two chained joins on one key would stop it)
    sale_info = sales.join(delivery, "sale_id")
    lines = t.line.select(F.col("order_id").alias("sale_id"), "item_id", "quantity")
    return (
        lines.join(priced, "item_id")
        .join(sale_info, "sale_id")
        .select(
            "member_id", "sku", "item_name", "retailprice", "quantity", "createddate", "imageurl", "sale_id",
            "name", "delivery_address",
        )
    )


def line_with_sku(t: RetailTables) -> DataFrame:
    """Every line item with its item's SKU."""
    items = t.item.select(F.col("id").alias("item_id"), "sku")
    return t.line.join(items, "item_id").select(*t.line.columns, "sku")


def validate_orders(t: RetailTables, orders: DataFrame, as_of: _dt.date) -> DataFrame:
    """Check orders: origin, destination and expected date given, origin other than
    destination, expected date not before ``as_of``, every line quantity within
    1..9999 (a missing quantity fails).  Returns one row per order with the
    checks, ``ok`` and the reasons; ``ok`` is never null, so ok and not ok rows
    together are all orders.
    """
    day = F.lit(as_of).cast("timestamp_ntz")
    fits = F.coalesce(F.col("quantity").between(K.MIN_LINE_QTY, K.MAX_LINE_QTY), F.lit(False))
    bad_lines = (
        t.line.select("order_id", "quantity")
        .join(orders.select(F.col("id").alias("order_id")), "order_id", "left_semi")
        .groupBy("order_id")
        .agg(F.count(F.when(~fits, 1)).alias("bad_lines"))
        .withColumnRenamed("order_id", "id")
    )
    checked = orders.select("id", "origin_id", "destination_id", "expecteddate").join(bad_lines, "id", "left")
    missing = F.col("origin_id").isNull() | F.col("destination_id").isNull() | F.col("expecteddate").isNull()
    same = F.coalesce(F.col("origin_id") == F.col("destination_id"), F.lit(False))
    late = F.coalesce(F.col("expecteddate") < day, F.lit(False))
    bad = F.coalesce(F.col("bad_lines"), F.lit(0))
    return checked.select(
        "id",
        same.alias("same_place"),
        late.alias("past_expected"),
        bad.cast("long").alias("bad_lines"),
        (~missing & ~same & ~late & (bad == 0)).alias("ok"),
        F.concat_ws(
            "; ",
            F.when(missing, F.lit("missing field")),
            F.when(same, F.lit("origin equals destination")),
            F.when(late, F.lit("expected date before today")),
            F.when(bad > 0, F.lit("quantity out of range")),
        ).alias("reason"),
    )
