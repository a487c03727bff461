"""Registered snapshot-write queries.

Change batches are derived from the fixture tables (so they grow with the
data): supplier offers become new prices, promotions become price updates,
proposed SKUs become new items, soft-deleted items are purged, order
priorities become status requests, and so on.  Each key returns the whole
new snapshot (or the rejects) of one table.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import constants as K
from .operators import changes as X
from .operators import links as L
from .plans.ids import max_id, number_rows
from .queries import COUNTRY, ORDER_AS_OF, PROMO_AS_OF, register
from .sources.fixtures import RetailTables

_SETS: list[RetailTables] = []


def _memo(t: RetailTables, name: str, build):
    """Build a multi-output change once per fixture set (its outputs share one plan); kept on the set itself."""
    kept = t.__dict__.setdefault("_changes", {})
    if name not in kept:
        kept[name] = build()
        _SETS.append(t)
    return kept[name]


def reset() -> None:
    """Forget memoized multi-output changes (the bench times each key in full)."""
    for t in _SETS:
        t.__dict__.pop("_changes", None)
    _SETS.clear()


def _latest(sql_from: str, keys: str, order: str, cols: str) -> str:
    return f"""SELECT {cols} FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS _rn
  FROM {sql_from}) z WHERE _rn = 1"""


# ---- prices ---------------------------------------------------------------


def price_adds(t: RetailTables) -> DataFrame:
    """Supplier offers as prices in the supplier's country (cost + 25%)."""
    sup = t.supplier.select(F.col("id").alias("supplier_id"), "country_id")
    items = t.item.select(F.col("id").alias("item_id"), "sku")
    offers = t.supplier_item.join(sup, "supplier_id").join(items, "item_id")
    known = offers.select("sku", "country_id", (F.col("costprice") * 1.25).alias("retailprice"), F.col("supplier_id").alias("seq"))
    # single-lot offers also arrive under a withdrawn SKU
    gone = offers.filter("lotsize = 1").select(
        F.concat(F.lit("GONE_"), "sku").alias("sku"), "country_id", F.col("costprice").alias("retailprice"), F.col("supplier_id").alias("seq")
    )
    return known.unionByName(gone)


_ADDS_SQL = """adds AS (SELECT i.sku, s.country_id, si.costprice * 1.25 AS retailprice, si.supplier_id AS seq
  FROM v_supplier_item si JOIN v_supplier s ON s.id = si.supplier_id JOIN v_item i ON i.id = si.item_id
  UNION ALL SELECT concat('GONE_', i.sku), s.country_id, si.costprice, si.supplier_id
  FROM v_supplier_item si JOIN v_supplier s ON s.id = si.supplier_id JOIN v_item i ON i.id = si.item_id WHERE si.lotsize = 1),
judged AS (SELECT a.*, i.id AS item_id,
  CASE WHEN i.id IS NULL THEN 'unknown sku'
    WHEN EXISTS (SELECT 1 FROM v_item_country p WHERE p.item_id = i.id AND p.country_id = a.country_id) THEN 'already priced'
    WHEN row_number() OVER (PARTITION BY i.id, a.country_id ORDER BY a.seq, a.retailprice) > 1 THEN 'repeated in the batch' END AS reason
  FROM adds a LEFT JOIN v_item i ON i.sku = a.sku)"""


def _add_prices(t: RetailTables) -> X.PricesChange:
    return _memo(t, "add_prices", lambda: X.add_prices(t.item_country, t.item, price_adds(t)))


@register(
    "add_prices",
    f"""WITH {_ADDS_SQL} SELECT item_id, country_id, retailprice FROM v_item_country
UNION ALL SELECT item_id, country_id, retailprice FROM judged WHERE reason IS NULL""",
)
def add_prices(t: RetailTables) -> DataFrame:
    """Price snapshot after adding supplier-offer prices where none exist."""
    return _add_prices(t).prices


@register("add_prices_rejects", f"WITH {_ADDS_SQL} SELECT sku, country_id, retailprice, reason FROM judged WHERE reason IS NOT NULL")
def add_prices_rejects(t: RetailTables) -> DataFrame:
    """Offers that were not added as prices, with the reason."""
    return _add_prices(t).rejects


def price_updates(t: RetailTables) -> DataFrame:
    """Promotions as price changes: old price (100 when none) less the discount."""
    prices = t.item_country.select("item_id", F.col("country_id").cast("long").alias("country_id"), "retailprice")
    return t.promotion.join(prices, ["item_id", "country_id"], "left").select(
        "item_id",
        "country_id",
        (F.coalesce(F.col("retailprice"), F.lit(100.0)) * (1 - F.col("discountrate"))).alias("retailprice"),
        F.col("startdate").alias("seq"),
    )


@register(
    "update_prices",
    f"""WITH upd AS (SELECT p.item_id, p.country_id, coalesce(ic.retailprice, 100.0) * (1 - p.discountrate) AS retailprice,
  p.startdate AS seq FROM v_promotion p LEFT JOIN v_item_country ic ON ic.item_id = p.item_id AND ic.country_id = p.country_id),
one AS ({_latest("upd", "item_id, country_id", "seq DESC, retailprice DESC", "item_id, country_id, floor(retailprice * 10 + 0.5) / 10 AS retailprice")})
SELECT p.item_id, p.country_id, CASE WHEN o.item_id IS NOT NULL THEN o.retailprice ELSE p.retailprice END AS retailprice
FROM v_item_country p LEFT JOIN one o ON o.item_id = p.item_id AND o.country_id = p.country_id""",
)
def update_prices(t: RetailTables) -> DataFrame:
    """Price snapshot after promotion price changes (one-decimal half-up)."""
    return X.update_prices(t.item_country, price_updates(t))


@register(
    "update_prices_rejects",
    """WITH upd AS (SELECT p.item_id, p.country_id, coalesce(ic.retailprice, 100.0) * (1 - p.discountrate) AS retailprice,
  p.startdate AS seq, ic.item_id IS NULL AS gone,
  row_number() OVER (PARTITION BY p.item_id, p.country_id ORDER BY p.startdate DESC, coalesce(ic.retailprice, 100.0) * (1 - p.discountrate) DESC) AS rn
  FROM v_promotion p LEFT JOIN v_item_country ic ON ic.item_id = p.item_id AND ic.country_id = p.country_id)
SELECT item_id, country_id, retailprice, CASE WHEN gone THEN 'unknown' ELSE 'superseded' END AS reason FROM upd WHERE gone OR rn > 1""",
)
def update_prices_rejects(t: RetailTables) -> DataFrame:
    """Price changes that were not applied: no such price, or a later change of the same price."""
    return X.update_prices_rejects(t.item_country, price_updates(t)).select("item_id", "country_id", "retailprice", "reason")


@register(
    "remove_prices",
    f"""SELECT p.* FROM v_item_country p WHERE NOT EXISTS (SELECT 1 FROM v_promotion q
  WHERE q.enddate < DATE '{PROMO_AS_OF.isoformat()}' AND q.item_id = p.item_id AND q.country_id = p.country_id)""",
)
def remove_prices(t: RetailTables) -> DataFrame:
    """Price snapshot after withdrawing prices of ended promotions."""
    ended = t.promotion.filter(F.col("enddate") < F.lit(PROMO_AS_OF).cast("timestamp_ntz"))
    return X.remove_prices(t.item_country, ended.select("item_id", "country_id"))


# ---- items ----------------------------------------------------------------


def new_items(t: RetailTables) -> DataFrame:
    """Proposed items: every part re-listed under SKU key + size (many collide, some invalid)."""
    p = t.raw("part")
    nk = F.col("p_partkey") + F.col("p_size")
    return p.select(
        F.concat(F.lit("SKU_"), nk.cast("string")).alias("sku"),
        F.concat(F.col("p_name"), F.lit(" II")).alias("name"),
        F.col("p_type").alias("category"),
        F.col("p_brand").alias("description"),
        F.when(nk % 3 == 0, "FurnitureEntity").when(nk % 3 == 1, "RetailProductEntity").otherwise("RawMaterialEntity").alias("dtype"),
        F.col("p_size").alias("length"),
        (F.col("p_partkey") % 7).alias("width"),
        (F.col("p_partkey") % 25 + 1).alias("height"),
        F.col("p_partkey").alias("seq"),
    )


_NEW_ITEMS_SQL = """new AS (SELECT concat('SKU_', cast(p_partkey + p_size AS VARCHAR)) AS sku, concat(p_name, ' II') AS name,
  p_type AS category, p_brand AS description,
  CASE (p_partkey + p_size) % 3 WHEN 0 THEN 'FurnitureEntity' WHEN 1 THEN 'RetailProductEntity' ELSE 'RawMaterialEntity' END AS dtype,
  p_size AS length, p_partkey % 7 AS width, p_partkey % 25 + 1 AS height, p_partkey AS seq FROM part),
chk AS (SELECT *, concat_ws('; ',
    CASE WHEN NOT (length(trim(sku)) > 0 AND length(trim(name)) > 0 AND length(trim(category)) > 0 AND length(trim(description)) > 0)
      THEN 'missing required field' END,
    CASE WHEN NOT (length >= 1 AND width >= 1 AND height >= 1) THEN 'dimension below 1' END,
    CASE WHEN sku IN (SELECT sku FROM v_item) THEN 'sku already in use' END) AS reason FROM new),
one AS (SELECT *, row_number() OVER (PARTITION BY sku ORDER BY seq) AS nth FROM chk WHERE reason = ''),
fresh AS (SELECT (SELECT max(id) FROM v_item) + row_number() OVER (ORDER BY sku) AS id, * FROM one WHERE nth = 1)"""


def _add_items(t: RetailTables) -> X.ItemsChange:
    return _memo(t, "add_items", lambda: X.add_items(t.item, t.subtype, new_items(t)))


@register(
    "add_items",
    f"""WITH {_NEW_ITEMS_SQL}
SELECT * FROM v_item UNION ALL
SELECT id, sku, name, category, description, dtype, length, width, height, FALSE FROM fresh""",
)
def add_items(t: RetailTables) -> DataFrame:
    """Item snapshot after adding the proposed items."""
    return _add_items(t).items


@register(
    "add_items_subtype",
    f"""WITH {_NEW_ITEMS_SQL}
SELECT * FROM v_subtype UNION ALL
SELECT id, CASE WHEN dtype = 'RawMaterialEntity' THEN NULL ELSE concat('/img/products/', sku, '.jpg') END FROM fresh""",
)
def add_items_subtype(t: RetailTables) -> DataFrame:
    """Subtype snapshot after adding the proposed items."""
    return _add_items(t).subtypes


@register(
    "add_items_rejects",
    f"""WITH {_NEW_ITEMS_SQL}
SELECT sku, reason FROM chk WHERE reason <> ''
UNION ALL SELECT sku, 'repeated in the batch' FROM one WHERE nth > 1""",
)
def add_items_rejects(t: RetailTables) -> DataFrame:
    """Proposed items refused (invalid fields, SKU in use or repeated)."""
    return _add_items(t).rejects


@register(
    "update_items",
    """WITH u AS (SELECT p_partkey AS id, upper(p_name) AS name, p_type AS category,
  concat(p_brand, ' (updated)') AS description FROM part WHERE p_size >= 45)
SELECT i.id, i.sku, CASE WHEN u.id IS NOT NULL THEN u.name ELSE i.name END AS name,
  CASE WHEN u.id IS NOT NULL THEN u.category ELSE i.category END AS category,
  CASE WHEN u.id IS NOT NULL THEN u.description ELSE i.description END AS description,
  i.dtype, i.length, i.width, i.height, i.isdeleted
FROM v_item i LEFT JOIN u ON u.id = i.id""",
)
def update_items(t: RetailTables) -> DataFrame:
    """Item snapshot after renaming every large item."""
    p = t.raw("part").filter(F.col("p_size") >= 45)
    changes = p.select(
        F.col("p_partkey").alias("id"),
        F.upper("p_name").alias("name"),
        F.col("p_type").alias("category"),
        F.concat(F.col("p_brand"), F.lit(" (updated)")).alias("description"),
    )
    return X.update_items(t.item, changes)


@register(
    "update_items_rejects",
    """WITH asked AS (SELECT p_partkey AS id, p_partkey AS seq FROM part WHERE p_size >= 45
  UNION ALL SELECT p_partkey * 2, p_partkey FROM part WHERE p_size >= 45),
judged AS (SELECT a.id, a.seq, i.id IS NULL AS gone, row_number() OVER (PARTITION BY a.id ORDER BY a.seq DESC) AS nth
  FROM asked a LEFT JOIN v_item i ON i.id = a.id)
SELECT id, seq, CASE WHEN gone THEN 'unknown' ELSE 'superseded' END AS reason FROM judged WHERE gone OR nth > 1""",
)
def update_items_rejects(t: RetailTables) -> DataFrame:
    """Renames of large items and of the items of twice their number that are not applied."""
    large = t.raw("part").filter(F.col("p_size") >= 45).select(F.col("p_partkey").alias("seq"), F.upper("p_name").alias("name"), "p_type", "p_brand")
    fields = ["seq", "name", F.col("p_type").alias("category"), F.col("p_brand").alias("description")]
    asked = large.select(F.col("seq").alias("id"), *fields).unionByName(large.select((F.col("seq") * 2).alias("id"), *fields))
    return X.update_items_rejects(t.item, asked).select("id", "seq", "reason")


def _remove_items(t: RetailTables) -> X.RemoveItems:
    ids = t.item.filter(F.col("isdeleted") == F.lit(True)).select("id")
    return _memo(t, "remove_items", lambda: X.remove_items(t.item, t.subtype, t.item_country, ids))


@register("remove_items", "SELECT * FROM v_item WHERE id NOT IN (SELECT id FROM v_item WHERE isdeleted = TRUE)")
def remove_items(t: RetailTables) -> DataFrame:
    """Item snapshot after purging soft-deleted items."""
    return _remove_items(t).items


@register(
    "remove_items_subtype",
    "SELECT * FROM v_subtype WHERE id NOT IN (SELECT id FROM v_item WHERE isdeleted = TRUE)",
)
def remove_items_subtype(t: RetailTables) -> DataFrame:
    """Subtype snapshot after the purge."""
    return _remove_items(t).subtypes


@register(
    "remove_items_prices",
    "SELECT * FROM v_item_country WHERE item_id NOT IN (SELECT id FROM v_item WHERE isdeleted = TRUE)",
)
def remove_items_prices(t: RetailTables) -> DataFrame:
    """Price snapshot after the purge (prices of every removed item go too)."""
    return _remove_items(t).prices


# ---- lines ----------------------------------------------------------------


def store_quantity_requests(t: RetailTables) -> DataFrame:
    """Each supplier's store sets the stock of the items it supplies to ten lots; some name an unknown store or SKU."""
    stores = t.store.select(F.col("id").alias("supplier_id"), F.col("name").alias("store_name"))
    items = t.item.select(F.col("id").alias("item_id"), "sku")
    return t.supplier_item.join(stores, "supplier_id").join(items, "item_id").select(
        F.when(F.col("leadtime") == 1, F.concat("store_name", F.lit(" (closed)"))).otherwise(F.col("store_name")).alias("store_name"),
        F.when(F.col("leadtime") == 2, F.concat(F.lit("GONE_"), "sku")).otherwise(F.col("sku")).alias("sku"),
        (F.col("lotsize") * 10).alias("quantity"), F.col("supplier_id").alias("seq"),
    )


_STORE_QUANTITY_SQL = """req AS MATERIALIZED (SELECT CASE si.leadtime WHEN 1 THEN concat(s.name, ' (closed)') ELSE s.name END AS store_name,
    CASE si.leadtime WHEN 2 THEN concat('GONE_', i.sku) ELSE i.sku END AS sku, si.lotsize * 10 AS quantity, si.supplier_id AS seq,
    row_number() OVER () AS rid
  FROM v_supplier_item si JOIN v_store s ON s.id = si.supplier_id JOIN v_item i ON i.id = si.item_id),
held AS (SELECT DISTINCT bin_id, item_id FROM v_line WHERE bin_id IS NOT NULL),
tg AS MATERIALIZED (SELECT r.*, b.id AS bin_id, i.id AS item_id, CASE WHEN s.id IS NULL THEN 1
    WHEN i.id IS NULL THEN 2 WHEN b.id IS NULL THEN 3 WHEN h.bin_id IS NULL THEN 4 END AS lacks
  FROM req r LEFT JOIN v_store s ON s.name = r.store_name
  LEFT JOIN v_storagebin b ON b.warehouse_id = s.warehouse_id AND b.type = 'Outbound' LEFT JOIN v_item i ON i.sku = r.sku
  LEFT JOIN held h ON h.bin_id = b.id AND h.item_id = i.id)"""


def _store_quantity(t: RetailTables) -> X.LinesChange:
    return _memo(t, "store_quantity", lambda: X.set_store_quantity(t.line, t.store, t.storagebin, t.item, store_quantity_requests(t)))


@register(
    "set_store_quantity",
    f"""WITH {_STORE_QUANTITY_SQL},
one AS ({_latest("tg WHERE lacks IS NULL", "bin_id, item_id", "seq DESC, quantity DESC", "bin_id, item_id, quantity")})
SELECT l.id, l.item_id, CASE WHEN o.bin_id IS NOT NULL THEN o.quantity ELSE l.quantity END AS quantity, l.order_id, l.bin_id
FROM v_line l LEFT JOIN one o ON o.bin_id = l.bin_id AND o.item_id = l.item_id""",
)
def set_store_quantity(t: RetailTables) -> DataFrame:
    """Line snapshot after stores set their stock of supplied items."""
    return _store_quantity(t).lines


@register(
    "set_store_quantity_rejects",
    f"""WITH {_STORE_QUANTITY_SQL}
SELECT any_value(store_name) AS store_name, any_value(sku) AS sku, any_value(quantity) AS quantity,
  CASE max(lacks) WHEN 1 THEN 'unknown store' WHEN 2 THEN 'unknown sku' WHEN 3 THEN 'no outbound bin' ELSE 'no line of the item' END AS reason
FROM tg GROUP BY rid HAVING bool_and(lacks IS NOT NULL)""",
)
def set_store_quantity_rejects(t: RetailTables) -> DataFrame:
    """Stock requests that reach no line, each once, with the reason."""
    return _store_quantity(t).rejects


def _order_lines(t: RetailTables) -> DataFrame:
    """Lines of shipping orders, whatever their status."""
    return t.line.join(t.shippingorder.select(F.col("id").alias("order_id")), "order_id", "left_semi")


@register(
    "update_line_quantity",
    """SELECT l.id, l.item_id, CASE WHEN s.status = 'Pending' AND l.quantity > 40 THEN 40 ELSE l.quantity END AS quantity,
  l.order_id, l.bin_id FROM v_line l LEFT JOIN v_shippingorder s ON s.id = l.order_id""",
)
def update_line_quantity(t: RetailTables) -> DataFrame:
    """Line snapshot after a request to cap all order lines at 40: only Pending orders' lines change."""
    changes = _order_lines(t).filter(F.col("quantity") > 40).select("id", F.lit(40).cast("long").alias("quantity"))
    return X.update_line_quantity(t.line, changes, mode="set", orders=t.shippingorder)


@register(
    "add_line_quantity",
    """SELECT l.id, l.item_id, cast(l.quantity + CASE WHEN s.status = 'Pending' THEN 3 ELSE 0 END AS BIGINT) AS quantity,
  l.order_id, l.bin_id FROM v_line l LEFT JOIN v_shippingorder s ON s.id = l.order_id""",
)
def add_line_quantity(t: RetailTables) -> DataFrame:
    """Line snapshot after two top-ups (+1, +2) asked for every order line: only Pending orders' lines change."""
    lines = _order_lines(t)
    deltas = lines.select("id", F.lit(1).cast("long").alias("quantity")).unionByName(
        lines.select("id", F.lit(2).cast("long").alias("quantity"))
    )
    return X.update_line_quantity(t.line, deltas, mode="add", orders=t.shippingorder)


@register(
    "remove_order_lines",
    """SELECT * FROM v_line l WHERE NOT EXISTS (SELECT 1 FROM v_shippingorder s
  WHERE s.id = l.order_id AND s.status = 'Pending' AND l.quantity > 45)""",
)
def remove_order_lines(t: RetailTables) -> DataFrame:
    """Line snapshot after a request to drop order lines over 45: only Pending orders' lines go."""
    return X.remove_order_lines(t.line, _order_lines(t).filter(F.col("quantity") > 45).select("id"), t.shippingorder)


@register(
    "remove_order_lines_rejects",
    """SELECT l.id, CASE WHEN s.status IS NULL OR s.status = 'Pending' THEN 'superseded' ELSE 'locked' END AS reason
FROM v_line l JOIN v_shippingorder s ON s.id = l.order_id, (VALUES (1), (2)) twice(n)
WHERE l.quantity > 45 AND (n = 1 OR s.status <> 'Pending')""",
)
def remove_order_lines_rejects(t: RetailTables) -> DataFrame:
    """Removals of order lines over 45, each asked for twice, that do nothing: locked or repeated."""
    asked = _order_lines(t).filter(F.col("quantity") > 45).select("id")
    return X.remove_order_lines_rejects(t.line, asked.unionByName(asked), t.shippingorder)


# ---- orders ---------------------------------------------------------------


@register(
    "update_orders",
    """WITH ch AS (SELECT id, expecteddate + INTERVAL 7 DAY AS expecteddate, (origin_id + 1) % 10 AS origin_id
  FROM v_shippingorder WHERE year(createddate) = 1998 AND status = 'Pending')
SELECT s.id, s.createddate, CASE WHEN ch.id IS NOT NULL THEN ch.expecteddate ELSE s.expecteddate END AS expecteddate,
  s.shippeddate, s.status, CASE WHEN ch.id IS NOT NULL THEN ch.origin_id ELSE s.origin_id END AS origin_id, s.destination_id
FROM v_shippingorder s LEFT JOIN ch ON ch.id = s.id""",
)
def update_orders(t: RetailTables) -> DataFrame:
    """Shipping-order snapshot after re-planning the 1998 orders (only Pending ones change)."""
    so = t.shippingorder
    changes = so.filter(F.year("createddate") == 1998).select(
        "id",
        (F.col("expecteddate") + F.expr("INTERVAL 7 DAYS")).alias("expecteddate"),
        ((F.col("origin_id") + 1) % 10).alias("origin_id"),
    )
    return X.update_orders(so, changes)


@register(
    "update_orders_rejects",
    """SELECT o.o_orderkey AS id, o.o_custkey % 10 AS origin_id, CASE WHEN s.id IS NULL THEN 'unknown' ELSE 'locked' END AS reason
FROM orders o LEFT JOIN v_shippingorder s ON s.id = o.o_orderkey WHERE year(o.o_orderdate) = 1998 AND (s.id IS NULL OR s.status <> 'Pending')""",
)
def update_orders_rejects(t: RetailTables) -> DataFrame:
    """New origins asked for every order of 1998 that are not set: purchase orders (unknown here) and orders past Pending."""
    asked = t.raw("orders").filter(F.year("o_orderdate") == 1998).select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 10).alias("origin_id"))
    return X.update_orders_rejects(t.shippingorder, asked)


@register(
    "update_line_quantity_rejects",
    """SELECT l.id, cast(40 AS BIGINT) AS quantity, 'locked' AS reason FROM v_line l JOIN v_shippingorder s ON s.id = l.order_id
WHERE l.quantity > 40 AND s.status <> 'Pending'""",
)
def update_line_quantity_rejects(t: RetailTables) -> DataFrame:
    """Caps asked for the lines of all shipping orders that the edit lock refuses."""
    changes = _order_lines(t).filter(F.col("quantity") > 40).select("id", F.lit(40).cast("long").alias("quantity"))
    return X.update_line_quantity_rejects(t.line, changes, orders=t.shippingorder)


_STATUS_BY_PRIORITY = {"1": K.SUBMITTED, "2": K.SHIPPED, "3": K.COMPLETED, "4": K.UNFULFILLABLE, "5": K.PENDING}


def status_requests(t: RetailTables) -> DataFrame:
    """Requested status of every shipping order, from its order priority."""
    o = t.raw("orders").select(F.col("o_orderkey").alias("id"), F.substring("o_orderpriority", 1, 1).alias("_p"))
    status = F.lit(K.PENDING)
    for digit, st in reversed(list(_STATUS_BY_PRIORITY.items())):
        status = F.when(F.col("_p") == digit, F.lit(st)).otherwise(status)
    return t.shippingorder.select("id").join(o, "id").select("id", status.alias("new_status"))


def _status(t: RetailTables) -> X.StatusChange:
    return _memo(t, "apply_status", lambda: X.apply_status(t.shippingorder, t.line, status_requests(t), ORDER_AS_OF))


def _rules_values() -> str:
    return ", ".join(f"('{a}', '{b}', {str(n).upper()})" for a, b, n in K.STATUS_TRANSITIONS)


_STATUS_SQL = f"""ch AS (SELECT s.id, CASE left(o.o_orderpriority, 1) {" ".join(f"WHEN '{d}' THEN '{st}'" for d, st in _STATUS_BY_PRIORITY.items())}
  ELSE 'Pending' END AS new_status FROM v_shippingorder s JOIN orders o ON o.o_orderkey = s.id),
rules AS (SELECT * FROM (VALUES {_rules_values()}) AS r(status, new_status, needs_lines)),
cnt AS (SELECT order_id AS id, count(*) AS n FROM v_line GROUP BY order_id),
chk AS (SELECT c.id, s.status, c.new_status, r.needs_lines, coalesce(n.n, 0) AS n FROM ch c
  LEFT JOIN v_shippingorder s ON s.id = c.id LEFT JOIN rules r ON r.status = s.status AND r.new_status = c.new_status
  LEFT JOIN cnt n ON n.id = c.id),
res AS (SELECT *, CASE WHEN status IS NULL THEN 'unknown order'
  WHEN needs_lines IS NULL THEN concat('not allowed: ', status, ' -> ', new_status)
  WHEN needs_lines AND n = 0 THEN 'order has no lines' END AS reason FROM chk)"""


@register(
    "apply_status",
    f"""WITH {_STATUS_SQL}
SELECT s.id, s.createddate, s.expecteddate,
  CASE WHEN r.id IS NOT NULL AND r.new_status = 'Shipped' THEN TIMESTAMP '{ORDER_AS_OF.isoformat()} 00:00:00' ELSE s.shippeddate END AS shippeddate,
  coalesce(r.new_status, s.status) AS status, s.origin_id, s.destination_id
FROM v_shippingorder s LEFT JOIN (SELECT id, new_status FROM res WHERE reason IS NULL) r ON r.id = s.id""",
)
def apply_status(t: RetailTables) -> DataFrame:
    """Shipping-order snapshot after the requested status changes."""
    return _status(t).orders


@register(
    "apply_status_rejects",
    f"""WITH {_STATUS_SQL}
SELECT id, status AS from_status, new_status AS to_status, reason FROM res WHERE reason IS NOT NULL""",
)
def apply_status_rejects(t: RetailTables) -> DataFrame:
    """Status changes the state machine refuses, with the reason."""
    return _status(t).rejects


@register(
    "set_purchase_status",
    f"""SELECT p.id, p.createddate, p.expecteddate, CASE left(o.o_orderpriority, 1)
  {" ".join(f"WHEN '{d}' THEN '{st}'" for d, st in _STATUS_BY_PRIORITY.items())} ELSE 'Pending' END AS status,
  p.supplier_id, p.destination_id FROM v_purchaseorder p JOIN orders o ON o.o_orderkey = p.id""",
)
def set_purchase_status(t: RetailTables) -> DataFrame:
    """Purchase-order snapshot after every order's requested status (set as it is)."""
    digit = F.substring("o_orderpriority", 1, 1)
    status = F.lit(K.PENDING)
    for d, st in _STATUS_BY_PRIORITY.items():
        status = F.when(digit == d, F.lit(st)).otherwise(status)
    asked = t.raw("orders").select(F.col("o_orderkey").alias("id"), status.alias("new_status"))
    return X.set_status(t.purchaseorder, asked)


def _receipt(t: RetailTables) -> X.Receipt:
    receipts = t.shippingorder.filter(F.col("status").isin(K.SHIPPED, K.SUBMITTED)).select("id")
    return _memo(t, "receive", lambda: X.receive_shipments(t.shippingorder, t.line, t.storagebin, receipts))


_RECEIPT_SQL = """rc AS (SELECT id FROM v_shippingorder WHERE status IN ('Shipped', 'Submitted')),
ib AS (SELECT warehouse_id, min(id) AS bin_id FROM v_storagebin WHERE type = 'Inbound' GROUP BY warehouse_id),
loc AS (SELECT s.id, s.status, ib.bin_id FROM rc JOIN v_shippingorder s ON s.id = rc.id LEFT JOIN ib ON ib.warehouse_id = s.destination_id),
acc AS (SELECT id AS order_id, bin_id FROM loc WHERE status = 'Shipped' AND bin_id IS NOT NULL),
recv AS (SELECT a.bin_id, l.item_id, sum(l.quantity) AS q FROM v_line l JOIN acc a ON a.order_id = l.order_id GROUP BY a.bin_id, l.item_id),
hold AS (SELECT l.bin_id, l.item_id, min(l.id) AS id FROM v_line l JOIN recv r ON r.bin_id = l.bin_id AND r.item_id = l.item_id
  GROUP BY l.bin_id, l.item_id),
cred AS (SELECT h.id, r.q FROM recv r JOIN hold h ON h.bin_id = r.bin_id AND h.item_id = r.item_id),
fresh AS (SELECT r.* FROM recv r WHERE NOT EXISTS (SELECT 1 FROM hold h WHERE h.bin_id = r.bin_id AND h.item_id = r.item_id))"""


@register(
    "receive_shipments",
    f"""WITH {_RECEIPT_SQL}
SELECT l.id, l.item_id, cast(l.quantity + coalesce(c.q, 0) AS BIGINT) AS quantity, l.order_id, l.bin_id
FROM v_line l LEFT JOIN cred c ON c.id = l.id
UNION ALL
SELECT (SELECT max(id) FROM v_line) + row_number() OVER (ORDER BY bin_id, item_id), item_id, cast(q AS BIGINT),
  cast(NULL AS BIGINT), bin_id FROM fresh""",
)
def receive_shipments(t: RetailTables) -> DataFrame:
    """Line snapshot after receiving every shipped order into its inbound bin."""
    return _receipt(t).lines


@register(
    "receive_shipments_rejects",
    f"""WITH {_RECEIPT_SQL}
SELECT order_id, reason FROM (SELECT id AS order_id, CASE WHEN status IS NULL THEN 'unknown order'
  WHEN status <> 'Shipped' THEN concat('not shipped: ', status) WHEN bin_id IS NULL THEN 'no inbound bin' END AS reason FROM loc) z
WHERE reason IS NOT NULL""",
)
def receive_shipments_rejects(t: RetailTables) -> DataFrame:
    """Receipts refused: order not shipped, or no inbound bin at the destination."""
    return _receipt(t).rejects


@register(
    "receive_shipments_orders",
    f"""WITH {_RECEIPT_SQL}
SELECT s.id, s.createddate, s.expecteddate, s.shippeddate, CASE WHEN a.order_id IS NOT NULL THEN 'Completed' ELSE s.status END AS status,
  s.origin_id, s.destination_id FROM v_shippingorder s LEFT JOIN acc a ON a.order_id = s.id""",
)
def receive_shipments_orders(t: RetailTables) -> DataFrame:
    """Shipping-order snapshot after receipt (received orders are Completed)."""
    return _receipt(t).orders


# ---- people ---------------------------------------------------------------


@register(
    "update_members",
    """WITH ch AS (SELECT m.email, upper(m.name) AS name, m.phone, concat(m.address, ' #01-01') AS address, m.zipcode
  FROM v_member m JOIN customer c ON c.c_custkey = m.id WHERE c.c_acctbal < 0)
SELECT m.id, m.email, CASE WHEN ch.email IS NOT NULL THEN ch.name ELSE m.name END AS name,
  CASE WHEN ch.email IS NOT NULL THEN ch.phone ELSE m.phone END AS phone, m.city,
  CASE WHEN ch.email IS NOT NULL THEN ch.address ELSE m.address END AS address,
  CASE WHEN ch.email IS NOT NULL THEN ch.zipcode ELSE m.zipcode END AS zipcode
FROM v_member m LEFT JOIN ch ON ch.email = m.email""",
)
def update_members(t: RetailTables) -> DataFrame:
    """Member snapshot after members in arrears update their address."""
    debtors = t.raw("customer").filter(F.col("c_acctbal") < 0).select(F.col("c_custkey").alias("id"))
    changes = t.member.join(debtors, "id", "left_semi").select(
        "email", F.upper("name").alias("name"), "phone", F.concat(F.col("address"), F.lit(" #01-01")).alias("address"), "zipcode"
    )
    return X.update_members(t.member, changes)


@register(
    "update_members_rejects",
    """WITH asked AS (SELECT CASE WHEN c.c_acctbal < -500 THEN concat('gone.', m.email) ELSE m.email END AS email, z.n AS seq, c.c_acctbal < -500 AS gone
  FROM v_member m JOIN customer c ON c.c_custkey = m.id, (VALUES (1), (2)) z(n) WHERE c.c_acctbal < 0)
SELECT email, seq, CASE WHEN gone THEN 'unknown' ELSE 'superseded' END AS reason FROM asked WHERE gone OR seq = 1""",
)
def update_members_rejects(t: RetailTables) -> DataFrame:
    """Two address changes of every member in arrears, the deepest under an unknown address: those not applied."""
    debtors = t.raw("customer").filter(F.col("c_acctbal") < 0).select(F.col("c_custkey").alias("id"), "c_acctbal")
    email = F.when(F.col("c_acctbal") < -500, F.concat(F.lit("gone."), "email")).otherwise(F.col("email"))
    asked = t.member.join(debtors, "id").select(email.alias("email"), "address", F.explode(F.array(F.lit(1), F.lit(2))).alias("seq"))
    return X.update_profiles_rejects(t.member, asked).select("email", "seq", "reason")


@register(
    "update_staff",
    """SELECT s.id, CASE WHEN c.c_acctbal < 0 THEN upper(s.name) ELSE s.name END AS name
FROM v_staff s JOIN customer c ON c.c_custkey = s.id""",
)
def update_staff(t: RetailTables) -> DataFrame:
    """Staff snapshot after a name change of some."""
    ids = t.raw("customer").filter(F.col("c_acctbal") < 0).select(F.col("c_custkey").alias("id"))
    changes = t.staff.join(ids, "id", "left_semi").select("id", F.upper("name").alias("name"))
    return X.update_staff(t.staff, changes, key="id")


@register(
    "update_purchase_orders",
    """SELECT id, createddate, CASE WHEN status = 'Pending' THEN expecteddate + INTERVAL 7 DAY ELSE expecteddate END AS expecteddate,
  status, CASE WHEN status = 'Pending' THEN (supplier_id + 1) % 10 ELSE supplier_id END AS supplier_id, destination_id
FROM v_purchaseorder""",
)
def update_purchase_orders(t: RetailTables) -> DataFrame:
    """Purchase-order snapshot after re-planning all orders (only Pending ones change)."""
    changes = t.purchaseorder.select(
        "id", (F.col("expecteddate") + F.expr("INTERVAL 7 DAYS")).alias("expecteddate"), ((F.col("supplier_id") + 1) % 10).alias("supplier_id")
    )
    return X.update_orders(t.purchaseorder, changes)


# ---- appends --------------------------------------------------------------

REISSUE_AS_OF = dt.date(2001, 9, 1)


def _reissued(t: RetailTables) -> DataFrame:
    """Unfulfillable shipping orders are re-issued as new Pending orders."""
    return t.shippingorder.filter(F.col("status") == K.UNFULFILLABLE).select(
        F.col("id").alias("old_id"),
        (F.lit(REISSUE_AS_OF).cast("timestamp_ntz") + F.expr("INTERVAL 14 DAYS")).alias("expecteddate"),
        "origin_id",
        "destination_id",
    )


def _order_id_floor(t: RetailTables) -> int:
    # purchase and shipping orders share the line -> order link here, so new ids
    # continue after every order id
    return max_id(t.raw("orders"), "o_orderkey")


_REISSUE_SQL = f"""re AS (SELECT id AS old_id, (SELECT max(o_orderkey) FROM orders) + row_number() OVER (ORDER BY id) AS id,
  TIMESTAMP '{REISSUE_AS_OF.isoformat()} 00:00:00' + INTERVAL 14 DAY AS expecteddate, origin_id, destination_id
  FROM v_shippingorder WHERE status = 'Unfulfillable')"""


@register(
    "append_orders",
    f"""WITH {_REISSUE_SQL}
SELECT * FROM v_shippingorder UNION ALL
SELECT id, TIMESTAMP '{REISSUE_AS_OF.isoformat()} 00:00:00', expecteddate, NULL, 'Pending', origin_id, destination_id FROM re""",
)
def append_orders(t: RetailTables) -> DataFrame:
    """Shipping-order snapshot with every unfulfillable order re-issued."""
    return X.append_orders(t.shippingorder, _reissued(t), REISSUE_AS_OF, ["old_id"], after=_order_id_floor(t))


@register(
    "append_purchase_orders",
    f"""SELECT * FROM v_purchaseorder UNION ALL
SELECT (SELECT max(o_orderkey) FROM orders) + row_number() OVER (ORDER BY id), TIMESTAMP '{REISSUE_AS_OF.isoformat()} 00:00:00',
  expecteddate + INTERVAL 30 DAY, 'Pending', supplier_id, destination_id FROM v_purchaseorder WHERE status = 'Completed'""",
)
def append_purchase_orders(t: RetailTables) -> DataFrame:
    """Purchase-order snapshot with every completed order placed again."""
    new = t.purchaseorder.filter(F.col("status") == K.COMPLETED).select(
        F.col("id").alias("old_id"), (F.col("expecteddate") + F.expr("INTERVAL 30 DAYS")).alias("expecteddate"), "supplier_id", "destination_id"
    )
    return X.append_orders(t.purchaseorder, new, REISSUE_AS_OF, ["old_id"], after=_order_id_floor(t))


@register(
    "append_order_lines",
    f"""WITH {_REISSUE_SQL},
nl AS (SELECT l.item_id, l.quantity, re.id AS order_id, l.id AS old_line FROM v_line l JOIN re ON re.old_id = l.order_id)
SELECT * FROM v_line UNION ALL
SELECT (SELECT max(id) FROM v_line) + row_number() OVER (ORDER BY order_id, old_line), item_id, quantity, order_id, cast(NULL AS BIGINT)
FROM nl""",
)
def append_order_lines(t: RetailTables) -> DataFrame:
    """Line snapshot with the lines of every re-issued order copied to the new order."""
    mapping = number_rows(_reissued(t).select("old_id"), ["old_id"], id_col="new_order_id", start=_order_id_floor(t))
    copies = t.line.join(mapping, F.col("order_id") == F.col("old_id"))
    new = copies.select("item_id", "quantity", F.col("new_order_id").alias("order_id"), F.col("id").alias("old_line"))
    return X.append_lines(t.line, new, ["order_id", "old_line"])


def _repeated_lines(t: RetailTables) -> DataFrame:
    """Every line asked for once more in its order."""
    return t.line.select("item_id", "quantity", "order_id", F.col("id").alias("old_line"))


@register(
    "append_lines_open",
    """SELECT * FROM v_line UNION ALL
SELECT (SELECT max(id) FROM v_line) + row_number() OVER (ORDER BY l.order_id, l.id), l.item_id, l.quantity, l.order_id, cast(NULL AS BIGINT)
FROM v_line l JOIN v_shippingorder s ON s.id = l.order_id WHERE s.status = 'Pending'""",
)
def append_lines_open(t: RetailTables) -> DataFrame:
    """Line snapshot after every line was asked for once more: only Pending shipping orders take theirs."""
    return X.append_lines(t.line, _repeated_lines(t), ["order_id", "old_line"], t.shippingorder)


@register(
    "append_lines_rejects",
    """SELECT l.order_id, l.id AS old_line, CASE WHEN s.id IS NULL THEN 'unknown' ELSE 'locked' END AS reason
FROM v_line l LEFT JOIN v_shippingorder s ON s.id = l.order_id WHERE s.id IS NULL OR s.status <> 'Pending'""",
)
def append_lines_rejects(t: RetailTables) -> DataFrame:
    """Lines asked for once more whose order is no shipping order or past Pending."""
    return X.append_lines_rejects(_repeated_lines(t), t.shippingorder).select("order_id", "old_line", "reason")


@register(
    "append_delivery",
    """SELECT * FROM v_delivery UNION ALL
SELECT s.id, s.member_id, c.c_name, 'SELF PICKUP' FROM v_sale s JOIN customer c ON c.c_custkey = s.member_id
WHERE NOT EXISTS (SELECT 1 FROM v_delivery d WHERE d.salerecord_id = s.id)""",
)
def append_delivery(t: RetailTables) -> DataFrame:
    """Delivery snapshot with a self-pickup row for every sale that has none."""
    names = t.raw("customer").select(F.col("c_custkey").alias("member_id"), F.col("c_name").alias("name"))
    missing = t.sale.join(t.delivery.select(F.col("salerecord_id").alias("id")), "id", "left_anti")
    new = missing.join(names, "member_id").select(
        F.col("id").alias("salerecord_id"), "member_id", "name", F.lit("SELF PICKUP").alias("delivery_address")
    )
    return X.append_rows(t.delivery, new)


# ---- link rows --------------------------------------------------------------


@register(
    "line_links",
    """WITH in_bin AS (SELECT bin_id, id AS lineitem_id FROM v_line WHERE bin_id IS NOT NULL),
in_order AS (SELECT l.order_id, l.id AS lineitem_id FROM v_line l WHERE l.order_id IN (SELECT id FROM v_shippingorder))
SELECT l.id, l.item_id, l.quantity, o.order_id, b.bin_id FROM v_line l
LEFT JOIN in_order o ON o.lineitem_id = l.id LEFT JOIN in_bin b ON b.lineitem_id = l.id""",
)
def line_links(t: RetailTables) -> DataFrame:
    """Lines joined to their bin and shipping-order link rows."""
    rows = t.line.select("id", "item_id", "quantity")
    return L.fold_links(rows, L.bin_links(t.line), L.order_links(t.line, t.shippingorder))


@register(
    "append_order_lines_bridge",
    f"""WITH {_REISSUE_SQL},
nl AS (SELECT re.id AS order_id, l.id AS old_line FROM v_line l JOIN re ON re.old_id = l.order_id)
SELECT order_id, id AS lineitem_id FROM v_line UNION ALL
SELECT order_id, (SELECT max(id) FROM v_line) + row_number() OVER (ORDER BY order_id, old_line) FROM nl""",
)
def append_order_lines_bridge(t: RetailTables) -> DataFrame:
    """Order link rows after the lines of every re-issued order are copied."""
    return L.order_links(append_order_lines(t))


@register(
    "remove_order_lines_bridge",
    """SELECT s.id AS order_id, l.id AS lineitem_id FROM v_line l JOIN v_shippingorder s ON s.id = l.order_id
WHERE NOT (s.status = 'Pending' AND l.quantity > 45)""",
)
def remove_order_lines_bridge(t: RetailTables) -> DataFrame:
    """Shipping-order link rows after lines over 45 were dropped from Pending orders."""
    return L.order_links(remove_order_lines(t), t.shippingorder)


@register(
    "receive_shipments_bridge",
    f"""WITH {_RECEIPT_SQL}
SELECT bin_id, id AS lineitem_id FROM v_line WHERE bin_id IS NOT NULL UNION ALL
SELECT bin_id, (SELECT max(id) FROM v_line) + row_number() OVER (ORDER BY bin_id, item_id) FROM fresh""",
)
def receive_shipments_bridge(t: RetailTables) -> DataFrame:
    """Bin link rows after every shipped order was received."""
    return L.bin_links(_receipt(t).lines)


CHECKOUT_AS_OF = dt.date(2024, 2, 1)


def checkout_amounts(t: RetailTables) -> DataFrame:
    """Amount of every cart at checkout: accepted adds times the item's price in the fixture country.

    Money is summed as decimal(18,2) (exact in every engine), then shown as double.
    """
    from .operators.stock import cart_fold
    from .queries_stock import cart_adds, cart_stock

    carts = cart_fold(cart_adds(t), cart_stock(t), on=("store_id", "item_id")).filter(F.col("accepted") > 0)
    prices = t.item_country.filter(F.col("country_id") == COUNTRY).select("item_id", "retailprice")
    line = F.col("retailprice").cast("decimal(18,2)") * F.col("accepted")
    return (
        carts.join(prices, "item_id")
        .groupBy(F.col("session").alias("member_id"))
        .agg(F.sum(line).cast("double").alias("amount"))
    )


@register(
    "append_sales",
    f"""WITH adds AS (SELECT session, item_id % 10 AS item_id, ts FROM v_cart),
agg AS (SELECT session, item_id, count(*) AS adds FROM adds GROUP BY session, item_id),
cf AS (SELECT a.session, a.item_id, least(a.adds, greatest(coalesce(x.stock % 4, 0), 0)) AS accepted
  FROM agg a LEFT JOIN x_store_stock x ON x.store_id = a.session % 10 AND x.item_id = a.item_id),
amt AS (SELECT cf.session AS member_id, cast(sum(cast(ic.retailprice AS DECIMAL(18,2)) * cf.accepted) AS DOUBLE) AS amount
  FROM cf JOIN v_item_country ic ON ic.item_id = cf.item_id AND ic.country_id = {COUNTRY} WHERE cf.accepted > 0 GROUP BY cf.session)
SELECT * FROM v_sale UNION ALL
SELECT (SELECT max(id) FROM v_sale) + row_number() OVER (ORDER BY member_id), member_id,
  TIMESTAMP '{CHECKOUT_AS_OF.isoformat()} 00:00:00', amount, amount, 'SGD' FROM amt""",
)
def append_sales(t: RetailTables) -> DataFrame:
    """Sales snapshot with one new sale record per cart checked out."""
    return X.append_sales(t.sale, checkout_amounts(t), CHECKOUT_AS_OF, ["member_id"])
