"""Registered order, supplier, history and people queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import constants as K
from .operators import grid as G
from .operators import orders as O
from .operators import people as P
from .queries import COUNTRY, ORDER_AS_OF, register
from .sources.fixtures import RetailTables

_ITEM_COLS = "i.id, i.sku, i.name, i.category, i.description, i.dtype, i.length, i.width, i.height, i.isdeleted"


@register(
    "purchase_orders",
    """SELECT p.*, s.suppliername, w.warehousename FROM v_purchaseorder p JOIN v_warehouse w ON p.destination_id = w.id
JOIN v_supplier s ON p.supplier_id = s.id ORDER BY p.createddate DESC, p.id DESC""",
)
def purchase_orders(t: RetailTables) -> DataFrame:
    """Purchase orders, newest first, with supplier and warehouse names."""
    return O.purchase_orders(t)


@register(
    "shipping_orders",
    """SELECT s.*, w.warehousename AS destination_name, w2.warehousename AS origin_name
FROM v_shippingorder s JOIN v_warehouse w ON s.destination_id = w.id JOIN v_warehouse w2 ON s.origin_id = w2.id""",
)
def shipping_orders(t: RetailTables) -> DataFrame:
    """Shipping orders with destination and origin warehouse names."""
    return O.shipping_orders(t)


@register(
    "purchase_orders_order",
    "SELECT id, row_number() OVER (ORDER BY createddate DESC, id DESC) AS row_pos FROM v_purchaseorder",
)
def purchase_orders_order(t: RetailTables) -> DataFrame:
    """Place of every purchase order in the listing (newest first), to check the order itself."""
    listed = O.purchase_orders(t, newest_first=False).select("id", "createddate", F.lit(None).cast("string").alias("blank"))
    return G.grid_rank(listed, [("createddate", "desc"), ("id", "desc")]).select("id", "row_pos")


def _full_order_ids(t: RetailTables) -> DataFrame:
    """Orders named by a line of the largest quantity."""
    return t.line.filter(F.col("quantity") == 50).select(F.col("order_id").alias("id"))


@register(
    "purchase_order_by_id",
    """SELECT p.*, maker.suppliername, depot.warehousename FROM v_purchaseorder p
JOIN v_supplier maker ON maker.id = p.supplier_id JOIN v_warehouse depot ON depot.id = p.destination_id
WHERE p.id IN (SELECT order_id FROM v_line WHERE quantity = 50)""",
)
def purchase_order_by_id(t: RetailTables) -> DataFrame:
    """Purchase orders looked up by id."""
    return P.lookup_by_keys(O.purchase_orders(t, newest_first=False), _full_order_ids(t), "id")


@register(
    "shipping_order_by_id",
    """SELECT s.*, goal.warehousename AS destination_name, start.warehousename AS origin_name FROM v_shippingorder s
JOIN v_warehouse goal ON goal.id = s.destination_id JOIN v_warehouse start ON start.id = s.origin_id
WHERE s.id IN (SELECT order_id FROM v_line WHERE quantity = 50)""",
)
def shipping_order_by_id(t: RetailTables) -> DataFrame:
    """Shipping orders looked up by id."""
    return P.lookup_by_keys(O.shipping_orders(t), _full_order_ids(t), "id")


@register(
    "supplier_items",
    "SELECT * FROM v_supplier_item WHERE supplier_id IN (SELECT supplier_id FROM v_purchaseorder WHERE status = 'Submitted')",
)
def supplier_items(t: RetailTables) -> DataFrame:
    """Offers of every supplier that has a submitted purchase order."""
    keys = t.purchaseorder.filter(F.col("status") == K.SUBMITTED).select("supplier_id")
    return P.lookup_by_keys(t.supplier_item, keys, "supplier_id")


def _lines_sql(view: str) -> str:
    return f"""SELECT p.id AS order_id, l.id AS lineitem_id, l.quantity, {_ITEM_COLS}
FROM {view} p JOIN v_line l ON l.order_id = p.id JOIN v_item i ON i.id = l.item_id"""


@register("purchase_order_lines", _lines_sql("v_purchaseorder"))
def purchase_order_lines(t: RetailTables) -> DataFrame:
    """Lines of every purchase order with the item."""
    return O.order_lines(t, t.purchaseorder)


@register("shipping_order_lines", _lines_sql("v_shippingorder"))
def shipping_order_lines(t: RetailTables) -> DataFrame:
    """Lines of every shipping order with the item."""
    return O.order_lines(t, t.shippingorder)


@register(
    "supplier_catalog",
    """SELECT si.supplier_id, si.item_id, si.costprice, si.leadtime, si.lotsize, i.sku, i.name, i.dtype
FROM v_supplier_item si JOIN v_item i ON si.item_id = i.id""",
)
def supplier_catalog(t: RetailTables) -> DataFrame:
    """Items of every supplier with cost, lead time and lot size."""
    return O.supplier_catalog(t)


@register(
    "purchase_history",
    f"""WITH bought AS (
  SELECT order_id AS sale_id, item_id, quantity FROM v_line),
offer AS (
  SELECT art.id AS item_id, art.sku, art.name AS item_name, pic.imageurl, tag.retailprice
  FROM v_item art
  JOIN v_subtype pic USING (id)
  JOIN v_item_country tag ON tag.item_id = art.id AND tag.country_id = {COUNTRY}
  WHERE art.dtype = 'FurnitureEntity')
SELECT buy.member_id, offer.sku, offer.item_name, offer.retailprice, bought.quantity, buy.createddate, offer.imageurl,
  buy.id AS sale_id, parcel.name, parcel.delivery_address
FROM v_sale buy
JOIN v_delivery parcel ON parcel.salerecord_id = buy.id
JOIN bought ON bought.sale_id = buy.id
JOIN offer USING (item_id)""",
)
def purchase_history(t: RetailTables) -> DataFrame:
    """Furniture bought by every member, priced in one country, with delivery details."""
    return O.purchase_history(t, COUNTRY)


@register(
    "line_with_sku",
    "SELECT l.*, i.sku FROM v_line l JOIN v_item i ON l.item_id = i.id",
)
def line_with_sku(t: RetailTables) -> DataFrame:
    """Every line item with its SKU."""
    return O.line_with_sku(t)


_VALIDATE_SQL = f"""WITH b AS (SELECT order_id, count(*) FILTER (WHERE quantity < 1 OR quantity > 9999) AS bad_lines
  FROM v_line GROUP BY order_id),
c AS (SELECT s.id, coalesce(s.origin_id = s.destination_id, FALSE) AS same_place,
  coalesce(s.expecteddate < DATE '{ORDER_AS_OF.isoformat()}', FALSE) AS past_expected, coalesce(b.bad_lines, 0) AS bad_lines
  FROM v_shippingorder s LEFT JOIN b ON b.order_id = s.id WHERE s.status = 'Pending')
SELECT id, same_place, past_expected, bad_lines, NOT same_place AND NOT past_expected AND bad_lines = 0 AS ok,
  concat_ws('; ', CASE WHEN same_place THEN 'origin equals destination' END,
    CASE WHEN past_expected THEN 'expected date before today' END,
    CASE WHEN bad_lines > 0 THEN 'quantity out of range' END) AS reason FROM c"""


@register("validate_orders", _VALIDATE_SQL)
def validate_orders(t: RetailTables) -> DataFrame:
    """Checks of every editable (Pending) shipping order."""
    return O.validate_orders(t, t.shippingorder.filter(F.col("status") == K.PENDING), ORDER_AS_OF)


@register("validate_orders_rejects", f"SELECT * FROM ({_VALIDATE_SQL}) v WHERE NOT ok")
def validate_orders_rejects(t: RetailTables) -> DataFrame:
    """Pending shipping orders failing a check."""
    return validate_orders(t).filter(~F.col("ok"))


@register(
    "staff_roles",
    "SELECT staff_id, min(role_id) AS role_id FROM v_staff_role GROUP BY staff_id",
)
def staff_roles(t: RetailTables) -> DataFrame:
    """Role every staff member acts in (lowest role id)."""
    return P.staff_roles(t)


@register(
    "staff_location",
    """SELECT s.id AS staff_id, coalesce(CASE WHEN a.facility_id IS NOT NULL THEN f.name
  WHEN a.office_id IS NOT NULL THEN o.name WHEN a.store_id IS NOT NULL THEN st.name
  WHEN a.warehouse_id IS NOT NULL THEN w.warehousename END, '') AS location
FROM v_staff s LEFT JOIN v_accessright a ON a.staff_id = s.id LEFT JOIN v_facility f ON f.id = a.facility_id
LEFT JOIN v_office o ON o.id = a.office_id LEFT JOIN v_store st ON st.id = a.store_id
LEFT JOIN v_warehouse w ON w.id = a.warehouse_id""",
)
def staff_location(t: RetailTables) -> DataFrame:
    """Workplace name of every staff member ('' when none)."""
    return P.staff_location(t)


def _areas_values() -> str:
    return ", ".join(f"({r}, '{a}')" for a, roles in K.AREA_ROLES.items() for r in roles)


@register(
    "staff_areas",
    f"""SELECT r.staff_id, r.role_id, m.area FROM (SELECT staff_id, min(role_id) AS role_id FROM v_staff_role GROUP BY staff_id) r
JOIN (VALUES {_areas_values()}) AS m(role_id, area) ON m.role_id = r.role_id""",
)
def staff_areas(t: RetailTables) -> DataFrame:
    """Menu areas each staff member may open."""
    return P.staff_areas(t)


@register(
    "stores_by_country",
    "SELECT c.name AS country_name, s.* FROM v_store s JOIN v_country c ON c.id = s.country_id",
)
def stores_by_country(t: RetailTables) -> DataFrame:
    """Stores of every country by country name."""
    return P.stores_by_country(t)


@register(
    "lookup_by_keys",
    "SELECT s.* FROM v_store s WHERE s.id IN (SELECT store_id FROM v_accessright WHERE store_id IS NOT NULL)",
)
def lookup_by_keys(t: RetailTables) -> DataFrame:
    """Stores looked up by every store id named in an access right."""
    keys = t.accessright.select(F.col("store_id").alias("id")).filter(F.col("id").isNotNull())
    return P.lookup_by_keys(t.store, keys, "id")


def email_requests(t: RetailTables) -> DataFrame:
    """Sign-up emails: every delivery name (members) and every supplier name (not members)."""
    def as_email(c):
        return F.concat(F.lower(F.regexp_replace(c, "#", ".")), F.lit("@example.com")).alias("email")

    return t.delivery.select(as_email(F.col("name"))).unionByName(t.supplier.select(as_email(F.col("suppliername"))))


@register(
    "email_known",
    """WITH r AS (SELECT concat(lower(replace(name, '#', '.')), '@example.com') AS email FROM v_delivery
  UNION SELECT concat(lower(replace(suppliername, '#', '.')), '@example.com') FROM v_supplier)
SELECT r.email, EXISTS (SELECT 1 FROM v_member m WHERE m.email = r.email) AS known FROM r""",
)
def email_known(t: RetailTables) -> DataFrame:
    """Is each sign-up email already a member's?"""
    return P.email_known(t.member, email_requests(t))


@register("scan_dimension", "SELECT * FROM v_warehouse")
def scan_dimension(t: RetailTables) -> DataFrame:
    """Full scan of the warehouse dimension (renamed columns)."""
    return P.scan_dimension(t, "warehouse")


@register("scan_country", "SELECT * FROM v_country")
def scan_country(t: RetailTables) -> DataFrame:
    """Full scan of the country dimension."""
    return P.scan_dimension(t, "country")


@register("scan_supplier", "SELECT * FROM v_supplier")
def scan_supplier(t: RetailTables) -> DataFrame:
    """Full scan of the supplier dimension."""
    return P.scan_dimension(t, "supplier")
