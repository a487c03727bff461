"""Staff roles, work locations, menu areas; stores by country; key lookups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as K
from ..plans.joins import fixed_broadcast, maybe_broadcast
from ..plans.materialize import sized_side
from ..sources.fixtures import RetailTables


def staff_roles(t: RetailTables) -> DataFrame:
    """The role each staff member acts in: the lowest role id they hold.

    An aggregate (min) rather than a ranking window, so it combines map-side.
    """
    return t.staff_role.groupBy("staff_id").agg(F.min("role_id").alias("role_id"))


def staff_location(t: RetailTables) -> DataFrame:
    """Name of each staff member's workplace.

    The first set id wins in the order facility, regional office, store,
    warehouse (by id, not by whether a name exists); no access row or no id
    gives ''.  One access row per staff member is used: the lowest facility,
    office, store and warehouse ids of the first row by (facility, office,
    store, warehouse) when several exist.
    """
    rights = t.accessright.groupBy("staff_id").agg(
        F.min(F.struct("facility_id", "office_id", "store_id", "warehouse_id")).alias("r")
    ).select("staff_id", "r.*")
    fac = t.facility.select(F.col("id").alias("facility_id"), F.col("name").alias("_fac"))
    off = t.office.select(F.col("id").alias("office_id"), F.col("name").alias("_off"))
    sto = t.store.select(F.col("id").alias("store_id"), F.col("name").alias("_sto"))
    wh = t.warehouse.select(F.col("id").alias("warehouse_id"), F.col("warehousename").alias("_wh"))
    named = (
        rights.join(maybe_broadcast(fac), "facility_id", "left")
        .join(maybe_broadcast(off), "office_id", "left")
        .join(maybe_broadcast(sto), "store_id", "left")
        .join(maybe_broadcast(wh), "warehouse_id", "left")
    )
    name = (
        F.when(F.col("facility_id").isNotNull(), F.col("_fac"))
        .when(F.col("office_id").isNotNull(), F.col("_off"))
        .when(F.col("store_id").isNotNull(), F.col("_sto"))
        .when(F.col("warehouse_id").isNotNull(), F.col("_wh"))
    )
    located = named.select("staff_id", F.coalesce(name, F.lit("")).alias("location"))
    staff = t.staff.select(F.col("id").alias("staff_id"))
    return staff.join(located, "staff_id", "left").select(
        "staff_id", F.coalesce("location", F.lit("")).alias("location")
    )


def area_table(spark: SparkSession, area_roles: dict[str, Sequence[int]] | None = None) -> DataFrame:
    """(role_id, area) rows from the fixed area -> roles lists."""
    mapping = K.AREA_ROLES if area_roles is None else area_roles
    rows = [(int(r), area) for area, roles in mapping.items() for r in roles]
    return spark.createDataFrame(rows, "role_id long, area string")


def staff_areas(t: RetailTables) -> DataFrame:
    """Menu areas each staff member may open, from the role they act in."""
    areas = area_table(t.spark)
    return staff_roles(t).join(fixed_broadcast(areas), "role_id").select("staff_id", "role_id", "area")


def stores_by_country(t: RetailTables) -> DataFrame:
    """Stores of every country, with the country's name."""
    countries = t.country.select(F.col("id").alias("country_id"), F.col("name").alias("country_name"))
    return t.store.join(maybe_broadcast(countries), "country_id").select("country_name", *t.store.columns)


def lookup_by_keys(df: DataFrame, keys: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Rows of ``df`` whose key is among ``keys`` (equality lookup for many keys at once)."""
    cols = [on] if isinstance(on, str) else list(on)
    return df.join(sized_side(keys.select(*cols).distinct(), "lookup_keys"), cols, "left_semi")


def email_known(members: DataFrame, emails: DataFrame) -> DataFrame:
    """For each requested email: does a member already use it?"""
    asked = sized_side(emails.select("email").distinct(), "emails")
    # the members are cut to the requested addresses map-side, before anything is shuffled
    known = members.select("email").join(asked, "email", "left_semi").distinct().withColumn("_known", F.lit(True))
    return asked.join(known, "email", "left").select("email", F.coalesce(F.col("_known"), F.lit(False)).alias("known"))


DIMENSIONS = ("country", "supplier", "warehouse", "store", "storagebin", "facility", "office", "staff", "member")


def scan_dimension(t: RetailTables, name: str) -> DataFrame:
    """Every row of a dimension table with the library's column names."""
    if name not in DIMENSIONS:
        raise ValueError(f"unknown dimension {name!r}; one of {DIMENSIONS}")
    return getattr(t, name)
