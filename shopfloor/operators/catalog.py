"""Catalogue listings, priced catalogue, SKU lookups, showroom and promotions."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.exprs import catalogue_image, live, percent_text, price_text, promotion_image, volume
from ..plans.joins import maybe_broadcast
from ..plans.materialize import sized_side
from ..sources.fixtures import RetailTables

FURNITURE = "FurnitureEntity"
RETAIL = "RetailProductEntity"
RAW = "RawMaterialEntity"

LISTING_COLUMNS = ["id", "name", "imageurl", "sku", "description", "length", "width", "height", "category"]
# the retail category pages list no dimensions
RETAIL_CATEGORY_COLUMNS = ["id", "name", "imageurl", "sku", "description", "category"]


def subtype_items(t: RetailTables, dtype: str) -> DataFrame:
    """Items of one subtype joined to their subtype row (image url)."""
    return t.item.filter(F.col("dtype") == dtype).join(t.subtype, "id")


def list_items(t: RetailTables, dtype: str) -> DataFrame:
    """Live items of a subtype; raw materials list the base item columns."""
    rows = subtype_items(t, dtype).filter(live())
    if dtype == RAW:
        return rows.select(*t.item.columns)
    return rows.select(*LISTING_COLUMNS)


def _priced(rows: DataFrame, t: RetailTables, country_id) -> DataFrame:
    prices = t.item_country.filter(F.col("country_id") == F.lit(country_id)).select(
        F.col("item_id").alias("id"), F.col("retailprice").alias("price")
    )
    return rows.join(prices, "id")


def catalog_by_category(
    t: RetailTables, country_id=None, category: str | None = None, dtype: str = FURNITURE,
    columns: list[str] | None = None,
) -> DataFrame:
    """Live items of a subtype, optionally one category, priced in a country.

    Conditions whose argument is empty are left out when the plan is built;
    without a country there is no price column (and no price join).
    """
    rows = subtype_items(t, dtype).filter(live())
    if category:
        rows = rows.filter(F.col("category") == category)
    rows = rows.select(*(columns or LISTING_COLUMNS))
    if country_id is None or country_id == "":
        return rows
    return _priced(rows, t, country_id)


def retail_by_category(t: RetailTables, country_id=None, category: str | None = K.ALL_RETAIL) -> DataFrame:
    """Retail products; the pseudo category 'All Retail Products' lifts the filter."""
    cat = None if category in (None, "", K.ALL_RETAIL) else category
    return catalog_by_category(t, country_id, cat, dtype=RETAIL, columns=RETAIL_CATEGORY_COLUMNS)


def items_by_sku(t: RetailTables, skus: DataFrame, country_id=None) -> DataFrame:
    """Live furniture and retail products for many SKUs, priced in a country.

    Retail products answer without dimensions (NULL here, so both kinds share
    one schema); without a country there is no price column.
    """
    wanted = sized_side(skus.select("sku").distinct(), "wanted_skus")
    # both subtypes in one pass over items and prices
    rows = (
        t.item.filter(F.col("dtype").isin(FURNITURE, RETAIL))
        .join(t.subtype, "id")
        .filter(live())
        .join(wanted, "sku", "left_semi")
    )
    furniture = F.col("dtype") == FURNITURE
    rows = rows.select(
        *[F.when(furniture, F.col(c)).alias(c) if c in ("length", "width", "height") else F.col(c) for c in LISTING_COLUMNS],
        "dtype",
    )
    return rows if country_id is None or country_id == "" else _priced(rows, t, country_id)


def price_list(t: RetailTables) -> DataFrame:
    """Every price with the item's SKU and the country's name."""
    countries = t.country.select(F.col("id").alias("country_id"), F.col("name").alias("country_name"))
    items = t.item.select(F.col("id").alias("item_id"), "sku")
    return (
        t.item_country.join(items, "item_id")
        .join(maybe_broadcast(countries), "country_id")
        .select("item_id", "sku", "country_name", "country_id", "retailprice")
    )


SHOWROOM_COLUMNS = ["id", "name", "category", "sku", "description", "length", "width", "height", "imageurl"]


def _max_price(t: RetailTables) -> DataFrame:
    # one row per item before the join: the big price table shrinks map-side
    return t.item_country.groupBy(F.col("item_id").alias("id")).agg(F.max("retailprice").alias("retailprice"))


def _showroom_view(rows: DataFrame) -> DataFrame:
    return rows.withColumn("price_text", price_text("retailprice")).withColumn("image_path", catalogue_image("imageurl"))


def showroom_items(t: RetailTables) -> DataFrame:
    """All furniture (soft-deleted included) with its highest price over countries."""
    rows = subtype_items(t, FURNITURE).select(*SHOWROOM_COLUMNS)
    return _showroom_view(rows.join(_max_price(t), "id", "left"))


def room_table(spark: SparkSession, room_categories: dict[str, list[str]] | None = None) -> DataFrame:
    """(room, category) pairs from a room -> categories mapping."""
    mapping = K.ROOM_CATEGORIES if room_categories is None else room_categories
    pairs = [(room, cat) for room, cats in mapping.items() for cat in cats]
    return spark.createDataFrame(pairs, "room string, category string")


def showroom_by_room(t: RetailTables, rooms: DataFrame, room_map: DataFrame) -> DataFrame:
    """Furniture shown in each requested room; a room without a mapping shows the category of its name."""
    wanted = rooms.select("room").distinct()
    mapped = wanted.join(maybe_broadcast(room_map), "room", "left").select(
        "room", F.coalesce("category", "room").alias("category")
    )
    rows = subtype_items(t, FURNITURE).select(*SHOWROOM_COLUMNS)
    # joined on category, a key with few values: as a shuffle join each category
    # would sit in one task, so the (room, category) list is written once (its
    # size is then known) and broadcast when small
    in_room = rows.join(sized_side(mapped, "room_categories"), "category")
    return _showroom_view(in_room.join(_max_price(t), "id", "left"))


def active_promotions(t: RetailTables, as_of: _dt.date, require_started: bool = False) -> DataFrame:
    """Promotions not yet ended on ``as_of`` with their item and display fields."""
    day = F.lit(as_of).cast("timestamp_ntz")
    promos = t.promotion.filter(F.col("enddate") >= day)
    if require_started:
        promos = promos.filter(F.col("startdate") <= day)
    items = t.item.select(F.col("id").alias("item_id"), "sku", F.col("name").alias("itemname"), "category")
    return promos.join(items, "item_id").select(
        "item_id", "country_id", "discountrate", "startdate", "enddate", "sku", "itemname", "category",
        percent_text("discountrate").alias("rate_text"),
    )


def promo_image_path(t: RetailTables, legacy_prefix: str | None = None) -> DataFrame:
    """Image path of every promotion, from its item's image."""
    images = t.subtype.select(F.col("id").alias("item_id"), "imageurl")
    return t.promotion.join(images, "item_id", "left").select(
        "item_id", "country_id", "startdate", "imageurl",
        promotion_image("imageurl", legacy_prefix).alias("image_path"),
    )


def item_volume(t: RetailTables) -> DataFrame:
    """Volume of every item (a projection, no shuffle)."""
    return t.item.select("id", "sku", volume("length", "width", "height").alias("volume"))


def sku_available(t: RetailTables, candidates: DataFrame) -> DataFrame:
    """For each candidate SKU: true when no item has it."""
    asked = sized_side(candidates.select("sku").distinct(), "candidate_skus")
    # the items are cut to the candidates map-side, before anything is shuffled
    known = t.item.select("sku").join(asked, "sku", "left_semi").distinct().withColumn("_known", F.lit(True))
    return asked.join(known, "sku", "left").select("sku", F.col("_known").isNull().alias("available"))
