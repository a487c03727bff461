"""Registered catalogue, showroom and promotion queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import constants as K
from .operators import catalog as C
from .queries import COUNTRY, PROMO_AS_OF, register
from .sources.fixtures import RetailTables

_LISTING = "i.id, i.name, f.imageurl, i.sku, i.description, i.length, i.width, i.height, i.category"


def _listing_sql(dtype: str, extra: str = "") -> str:
    return f"""SELECT {_LISTING} FROM v_item i JOIN v_subtype f ON i.id = f.id
WHERE i.dtype = '{dtype}' AND i.isdeleted = FALSE {extra}"""


@register("list_furniture", _listing_sql(C.FURNITURE))
def list_furniture(t: RetailTables) -> DataFrame:
    """Live furniture with image."""
    return C.list_items(t, C.FURNITURE)


@register("list_retail_products", _listing_sql(C.RETAIL))
def list_retail_products(t: RetailTables) -> DataFrame:
    """Live retail products with image."""
    return C.list_items(t, C.RETAIL)


@register(
    "list_raw_materials",
    """SELECT i.* FROM v_item i JOIN v_subtype r ON r.id = i.id WHERE i.dtype = 'RawMaterialEntity' AND i.isdeleted = FALSE""",
)
def list_raw_materials(t: RetailTables) -> DataFrame:
    """Live raw materials (base item columns)."""
    return C.list_items(t, C.RAW)


def _priced_sql(dtype: str, cols: str = _LISTING) -> str:
    return f"""SELECT {cols}, ic.retailprice AS price FROM v_item i JOIN v_subtype f ON i.id = f.id
JOIN v_item_country ic ON ic.item_id = i.id
WHERE i.dtype = '{dtype}' AND i.isdeleted = FALSE AND ic.country_id = {COUNTRY}"""


@register("catalog_by_category", _priced_sql(C.FURNITURE))
def catalog_by_category(t: RetailTables) -> DataFrame:
    """Priced furniture of every category in one country (category argument left out)."""
    return C.catalog_by_category(t, COUNTRY, None)


CATEGORY = "MEDIUM"


@register("catalog_one_category", f"SELECT * FROM ({_priced_sql(C.FURNITURE)}) AS priced WHERE category = '{CATEGORY}'")
def catalog_one_category(t: RetailTables) -> DataFrame:
    """Priced furniture of one category in one country."""
    return C.catalog_by_category(t, COUNTRY, CATEGORY)


@register("retail_by_category", _priced_sql(C.RETAIL, "i.id, i.name, f.imageurl, i.sku, i.description, i.category"))
def retail_by_category(t: RetailTables) -> DataFrame:
    """Priced retail products, pseudo category 'All Retail Products'."""
    return C.retail_by_category(t, COUNTRY, K.ALL_RETAIL)


def cart_skus(t: RetailTables) -> DataFrame:
    """SKUs looked up by shoppers: every item clicked in a cart event."""
    return t.cart.select(F.concat(F.lit("SKU_"), F.col("item_id").cast("string")).alias("sku"))


@register(
    "items_by_sku",
    f"""WITH req AS (SELECT DISTINCT concat('SKU_', cast(item_id AS VARCHAR)) AS sku FROM v_cart)
SELECT i.id, i.name, f.imageurl, i.sku, i.description,
  CASE WHEN i.dtype = 'FurnitureEntity' THEN i.length END AS length,
  CASE WHEN i.dtype = 'FurnitureEntity' THEN i.width END AS width,
  CASE WHEN i.dtype = 'FurnitureEntity' THEN i.height END AS height,
  i.category, ic.retailprice AS price, i.dtype FROM v_item i JOIN v_subtype f ON i.id = f.id
JOIN v_item_country ic ON ic.item_id = i.id
WHERE i.dtype IN ('FurnitureEntity', 'RetailProductEntity') AND i.isdeleted = FALSE AND ic.country_id = {COUNTRY}
AND i.sku IN (SELECT sku FROM req)""",
)
def items_by_sku(t: RetailTables) -> DataFrame:
    """Priced furniture and retail products for every SKU shoppers looked at."""
    return C.items_by_sku(t, cart_skus(t), COUNTRY)


@register(
    "price_list",
    """SELECT ic.item_id, i.sku, c.name AS country_name, ic.country_id, ic.retailprice
FROM v_item i JOIN v_item_country ic ON i.id = ic.item_id JOIN v_country c ON ic.country_id = c.id""",
)
def price_list(t: RetailTables) -> DataFrame:
    """Every price with SKU and country name."""
    return C.price_list(t)


_SHOWROOM_SELECT = """i.id, i.name, i.category, i.sku, i.description, i.length, i.width, i.height, f.imageurl,
  max(p.retailprice) AS retailprice"""
_SHOWROOM_VIEW = """SELECT *, printf('%.2f', coalesce(nullif(retailprice, 0), 0.0)) AS price_text,
  CASE WHEN imageurl IS NULL OR imageurl = '' THEN '/img/products/default.jpg'
       WHEN strpos(imageurl, '/') > 0 THEN imageurl ELSE concat('/img/products/', imageurl) END AS image_path"""


@register(
    "showroom_items",
    f"""WITH g AS (SELECT {_SHOWROOM_SELECT}
FROM v_item i JOIN v_subtype f ON i.id = f.id LEFT JOIN v_item_country p ON i.id = p.item_id
WHERE i.dtype = 'FurnitureEntity'
GROUP BY i.id, i.name, i.category, i.sku, i.description, i.length, i.width, i.height, f.imageurl)
{_SHOWROOM_VIEW} FROM g""",
)
def showroom_items(t: RetailTables) -> DataFrame:
    """All furniture with its highest price, price text and image path."""
    return C.showroom_items(t)


# Fixture stand-ins for the room categories: the six real category names, in
# order of first use, map to the six fixture categories in sorted order.
FIXTURE_CATEGORY = {
    "Sofas & Chair": "ECONOMY",
    "Tables & Desks": "LARGE",
    "Lightings": "MEDIUM",
    "Beds & Mattresses": "PROMO",
    "Cabinets & Storage": "SMALL",
    "Study": "STANDARD",
}
FIXTURE_ROOMS = {room: [FIXTURE_CATEGORY[c] for c in cats] for room, cats in K.ROOM_CATEGORIES.items()}


def _room_values_sql() -> str:
    rows = ", ".join(f"('{room}', '{cat}')" for room, cats in FIXTURE_ROOMS.items() for cat in cats)
    return f"(VALUES {rows}) AS m(room, category)"


def requested_rooms(t: RetailTables) -> DataFrame:
    """The four named rooms plus every category used as a room name of its own."""
    named = t.spark.createDataFrame([(r,) for r in FIXTURE_ROOMS], "room string")
    return named.unionByName(t.item.select(F.col("category").alias("room"))).distinct()


@register(
    "showroom_by_room",
    f"""WITH rooms AS (SELECT room FROM (VALUES {", ".join(f"('{r}')" for r in FIXTURE_ROOMS)}) AS r(room)
  UNION SELECT DISTINCT category FROM v_item),
rm AS (SELECT r.room, coalesce(m.category, r.room) AS category FROM rooms r LEFT JOIN {_room_values_sql()} ON m.room = r.room),
g AS (SELECT rm.room, {_SHOWROOM_SELECT}
FROM v_item i JOIN v_subtype f ON i.id = f.id JOIN rm ON rm.category = i.category
LEFT JOIN v_item_country p ON i.id = p.item_id
WHERE i.dtype = 'FurnitureEntity'
GROUP BY rm.room, i.id, i.name, i.category, i.sku, i.description, i.length, i.width, i.height, f.imageurl)
{_SHOWROOM_VIEW} FROM g""",
)
def showroom_by_room(t: RetailTables) -> DataFrame:
    """Furniture for every requested room with its highest price."""
    return C.showroom_by_room(t, requested_rooms(t), C.room_table(t.spark, FIXTURE_ROOMS))


@register(
    "active_promotions",
    f"""SELECT p.item_id, p.country_id, p.discountrate, p.startdate, p.enddate, i.sku, i.name AS itemname, i.category,
  CASE WHEN p.discountrate > 0 AND p.discountrate < 1 THEN concat(cast(cast(floor(p.discountrate * 100 + 0.5) AS BIGINT) AS VARCHAR), '%')
       ELSE cast(p.discountrate AS VARCHAR) END AS rate_text
FROM v_promotion p JOIN v_item i ON p.item_id = i.id WHERE p.enddate >= DATE '{PROMO_AS_OF.isoformat()}'""",
)
def active_promotions(t: RetailTables) -> DataFrame:
    """Promotions not ended on the as-of date, with item and percent text."""
    return C.active_promotions(t, PROMO_AS_OF)


@register(
    "promo_image_path",
    """SELECT p.item_id, p.country_id, p.startdate, s.imageurl,
  CASE WHEN s.imageurl IS NULL OR s.imageurl = '' THEN '/img/products/default.jpg'
       WHEN starts_with(s.imageurl, '/img/') THEN s.imageurl
       WHEN starts_with(s.imageurl, 'http://') OR starts_with(s.imageurl, 'https://') THEN s.imageurl
       WHEN strpos(s.imageurl, '/') > 0 AND NOT starts_with(s.imageurl, '/') THEN concat('/', s.imageurl)
       ELSE concat('/img/promotions/', s.imageurl) END AS image_path
FROM v_promotion p LEFT JOIN v_subtype s ON s.id = p.item_id""",
)
def promo_image_path(t: RetailTables) -> DataFrame:
    """Promotion image path from every promoted item's image."""
    return C.promo_image_path(t)


@register("item_volume", "SELECT id, sku, length * width * height AS volume FROM v_item")
def item_volume(t: RetailTables) -> DataFrame:
    """Length x width x height of every item."""
    return C.item_volume(t)


def candidate_skus(t: RetailTables) -> DataFrame:
    """New-item SKU proposals: every part re-listed under key + size."""
    p = t.raw("part")
    return p.select(F.concat(F.lit("SKU_"), (F.col("p_partkey") + F.col("p_size")).cast("string")).alias("sku"))


@register(
    "sku_available",
    """WITH c AS (SELECT DISTINCT concat('SKU_', cast(p_partkey + p_size AS VARCHAR)) AS sku FROM part)
SELECT c.sku, NOT EXISTS (SELECT 1 FROM v_item i WHERE i.sku = c.sku) AS available FROM c""",
)
def sku_available(t: RetailTables) -> DataFrame:
    """Is each proposed SKU still free?"""
    return C.sku_available(t, candidate_skus(t))
