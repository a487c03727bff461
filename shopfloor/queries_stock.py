"""Registered stock queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import constants as K
from .operators import stock as S
from .queries import register
from .sources.fixtures import RetailTables


def stock_requests(t: RetailTables) -> DataFrame:
    """(store_name, sku): each supplier's store asks for the items it supplies."""
    stores = t.store.select(F.col("id").alias("supplier_id"), F.col("name").alias("store_name"))
    items = t.item.select(F.col("id").alias("item_id"), "sku")
    return t.supplier_item.join(stores, "supplier_id").join(items, "item_id").select("store_name", "sku").distinct()


STOCK_REQUESTS_SQL = """x_req AS (SELECT DISTINCT s.name AS store_name, i.sku FROM v_supplier_item si
    JOIN v_store s ON s.id = si.supplier_id JOIN v_item i ON i.id = si.item_id)"""


@register(
    "item_stock",
    """SELECT shop.id AS store_id, art.sku, cast(sum(held.quantity) AS BIGINT) AS stock
FROM v_line held
JOIN v_item art ON art.id = held.item_id
JOIN (SELECT id, warehouse_id FROM v_storagebin WHERE type = 'Outbound') shelf ON shelf.id = held.bin_id
JOIN v_store shop USING (warehouse_id)
WHERE shop.warehouse_id IN (SELECT id FROM v_warehouse)
GROUP BY ALL""",
)
def item_stock(t: RetailTables) -> DataFrame:
    """Stock of every item at every store (Outbound bins of the store's warehouse)."""
    return S.item_stock(t)


@register(
    "item_stock_all",
    """WITH serves AS (SELECT warehouse_id, count(*) AS shops FROM v_store GROUP BY warehouse_id)
SELECT art.sku, cast(sum(held.quantity * serves.shops) AS BIGINT) AS stock
FROM v_line held
JOIN v_item art ON art.id = held.item_id
JOIN v_storagebin shelf ON shelf.id = held.bin_id AND shelf.type = 'Outbound'
JOIN serves USING (warehouse_id)
WHERE serves.warehouse_id IN (SELECT id FROM v_warehouse)
GROUP BY art.sku""",
)
def item_stock_all(t: RetailTables) -> DataFrame:
    """Stock of every item over all stores (a shared warehouse counts once per store)."""
    return S.item_stock_all(t)


@register(
    "item_stock_all_distinct",
    """SELECT i.sku, cast(sum(x.stock) AS BIGINT) AS stock FROM x_wh_stock x JOIN v_item i ON i.id = x.item_id
WHERE x.warehouse_id IN (SELECT warehouse_id FROM v_store) GROUP BY i.sku""",
)
def item_stock_all_distinct(t: RetailTables) -> DataFrame:
    """Stock over all stores counting each warehouse once."""
    return S.item_stock_all(t, distinct_warehouse=True)


@register(
    "stock_by_store_name",
    f"""WITH {STOCK_REQUESTS_SQL}
SELECT r.store_name, r.sku, cast(coalesce(sum(x.stock), 0) AS BIGINT) AS stock
FROM x_req r LEFT JOIN v_store s ON s.name = r.store_name LEFT JOIN v_item i ON i.sku = r.sku
LEFT JOIN x_wh_stock x ON x.warehouse_id = s.warehouse_id AND x.item_id = i.id
GROUP BY r.store_name, r.sku""",
)
def stock_by_store_name(t: RetailTables) -> DataFrame:
    """Stock for (store name, sku) requests; a missing sum is 0."""
    return S.stock_by_store_name(t, stock_requests(t))


@register(
    "item_availability",
    f"""WITH {STOCK_REQUESTS_SQL}, y AS (
SELECT r.store_name, r.sku, cast(coalesce(sum(x.stock), 0) AS BIGINT) AS quantity
FROM x_req r LEFT JOIN v_store s ON s.name = r.store_name LEFT JOIN v_item i ON i.sku = r.sku
LEFT JOIN x_wh_stock x ON x.warehouse_id = s.warehouse_id AND x.item_id = i.id
GROUP BY r.store_name, r.sku)
SELECT store_name, sku, quantity, CASE WHEN quantity > 0 THEN 'Available' ELSE 'Unavailable' END AS availability FROM y""",
)
def item_availability(t: RetailTables) -> DataFrame:
    """Available / Unavailable per requested (store name, sku)."""
    return S.item_availability(t, stock_requests(t))


@register(
    "outbound_bin_contents",
    """SELECT w.id AS warehouse_id, i.*, l.quantity
FROM v_warehouse w JOIN v_storagebin s ON s.warehouse_id = w.id JOIN v_line l ON l.bin_id = s.id
JOIN v_item i ON i.id = l.item_id WHERE s.type = 'Outbound'""",
)
def outbound_bin_contents(t: RetailTables) -> DataFrame:
    """Items and quantities in every warehouse's Outbound bin."""
    return S.outbound_bin_contents(t)


@register(
    "first_inbound_bin",
    """SELECT w.id AS warehouse_id, b.bin_id FROM v_warehouse w
LEFT JOIN (SELECT warehouse_id, min(id) AS bin_id FROM v_storagebin WHERE type = 'Inbound' GROUP BY warehouse_id) b
ON b.warehouse_id = w.id""",
)
def first_inbound_bin(t: RetailTables) -> DataFrame:
    """First (lowest id) Inbound bin of every warehouse, NULL when none."""
    return S.first_inbound_bin(t)


def shipped_receipt_requests(t: RetailTables) -> DataFrame:
    """(bin_id, item_id) that receiving every Shipped order would touch."""
    inbound = S.first_inbound_bin(t).withColumnRenamed("warehouse_id", "destination_id")
    shipped = t.shippingorder.filter(F.col("status") == K.SHIPPED).select(F.col("id").alias("order_id"), "destination_id")
    lines = t.line.select("order_id", "item_id")
    return (
        shipped.join(inbound, "destination_id")
        .filter(F.col("bin_id").isNotNull())
        .join(lines, "order_id")
        .select("bin_id", "item_id")
        .distinct()
    )


@register(
    "item_in_bin",
    """WITH req AS (SELECT DISTINCT b.bin_id, l.item_id FROM v_shippingorder so
  JOIN (SELECT warehouse_id, min(id) AS bin_id FROM v_storagebin WHERE type = 'Inbound' GROUP BY warehouse_id) b
    ON b.warehouse_id = so.destination_id
  JOIN v_line l ON l.order_id = so.id WHERE so.status = 'Shipped')
SELECT r.bin_id, r.item_id, EXISTS (SELECT 1 FROM v_line l WHERE l.bin_id = r.bin_id AND l.item_id = r.item_id) AS present
FROM req r""",
)
def item_in_bin(t: RetailTables) -> DataFrame:
    """Does the destination's inbound bin already hold each received item?"""
    return S.item_in_bin(t, shipped_receipt_requests(t))


def cart_adds(t: RetailTables) -> DataFrame:
    """Cart adds with the item folded to 10 products so the stock guard fires;
    each session shops at store ``session % 10``."""
    return t.cart.select(
        "session", (F.col("item_id") % 10).alias("item_id"), "ts", (F.col("session") % 10).alias("store_id")
    )


def cart_stock(t: RetailTables) -> DataFrame:
    """Stock per (store, item) as the cart sees it, kept small (% 4)."""
    return S.store_item_stock(t).select("store_id", "item_id", (F.col("stock") % 4).alias("stock"))


@register(
    "cart_fold",
    """WITH adds AS (SELECT session, item_id % 10 AS item_id, ts FROM v_cart),
agg AS (SELECT session, item_id, count(*) AS adds, min(ts) AS first_ts FROM adds GROUP BY session, item_id)
SELECT a.session, a.item_id, a.adds, cast(x.stock % 4 AS BIGINT) AS stock,
  cast(least(a.adds, greatest(coalesce(x.stock % 4, 0), 0)) AS BIGINT) AS accepted
FROM agg a LEFT JOIN x_store_stock x ON x.store_id = a.session % 10 AND x.item_id = a.item_id""",
)
def cart_fold(t: RetailTables) -> DataFrame:
    """Add-to-cart folds under the stock guard."""
    return S.cart_fold(cart_adds(t), cart_stock(t), on=("store_id", "item_id"))


@register(
    "cart_add_outcomes",
    """SELECT l.bin_id // 2 AS session, l.item_id, l.id AS add_id,
  row_number() OVER (PARTITION BY l.bin_id // 2, l.item_id ORDER BY o.o_orderdate, l.id) <= greatest(coalesce(x.stock % 4, 0), 0) AS accepted
FROM v_line l JOIN orders o ON o.o_orderkey = l.order_id
LEFT JOIN x_store_stock x ON x.store_id = l.bin_id // 2 AND x.item_id = l.item_id""",
)
def cart_add_outcomes(t: RetailTables) -> DataFrame:
    """Every ordered line as an add at the kiosk of its supplier's store, over all stores and items: accepted or refused."""
    at = t.sale.select(F.col("id").alias("order_id"), F.col("createddate").alias("ts"))
    adds = t.line.join(at, "order_id").select(F.expr("bin_id div 2").alias("session"), "item_id", F.col("id").alias("add_id"), "ts")
    stock = S.store_item_stock(t).select(F.col("store_id").alias("session"), "item_id", (F.col("stock") % 4).alias("stock"))
    return S.cart_outcomes(adds, stock)
