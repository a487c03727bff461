"""Retail tables derived from the shared parquet fixtures.

The driver's TPC-H-like tables stand in for the retail store's tables.  Each
property below is a lazily built DataFrame view (see FIXTURES.md §2 for the
same definitions as SQL).  Nothing is collected; every view is a plan over
the parquet scans, so filters and column pruning reach the files.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.ids import number_rows
from ..plans.materialize import write_table

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()

def _days(n: int):
    return F.expr(f"INTERVAL {n} DAYS")


class RetailTables:
    """All retail views over one fixture folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}.parquet")

    # ---- catalogue -------------------------------------------------------
    @cached_property
    def item(self) -> DataFrame:
        p = self.raw("part")
        k = F.col("p_partkey")
        return p.select(
            k.alias("id"),
            F.concat(F.lit("SKU_"), k.cast("string")).alias("sku"),
            F.col("p_name").alias("name"),
            F.col("p_type").alias("category"),
            F.col("p_brand").alias("description"),
            F.when(k % 3 == 0, "FurnitureEntity")
            .when(k % 3 == 1, "RetailProductEntity")
            .otherwise("RawMaterialEntity")
            .alias("dtype"),
            F.col("p_size").alias("length"),
            (k % 40 + 1).alias("width"),
            (k % 25 + 1).alias("height"),
            F.when(k % 19 == 0, F.lit(None).cast("boolean")).otherwise(k % 17 == 0).alias("isdeleted"),
        )

    @cached_property
    def subtype(self) -> DataFrame:
        k = F.col("p_partkey")
        return self.raw("part").select(
            k.alias("id"),
            F.when(k % 5 == 0, F.lit(None).cast("string"))
            .when(k % 2 == 0, F.concat(F.lit("p"), k.cast("string"), F.lit(".jpg")))
            .otherwise(F.concat(F.lit("/img/products/"), k.cast("string"), F.lit(".jpg")))
            .alias("imageurl"),
        )

    @cached_property
    def country(self) -> DataFrame:
        return self.raw("nation").select(
            F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region_id")
        )

    @cached_property
    def item_country(self) -> DataFrame:
        li = self.raw("lineitem").select("l_partkey", "l_suppkey", "l_extendedprice")
        s = self.raw("supplier").select("s_suppkey", "s_nationkey")
        return (
            li.filter(F.col("l_partkey") % 7 != 0)
            .join(s, li.l_suppkey == s.s_suppkey)
            .groupBy(F.col("l_partkey").alias("item_id"), F.col("s_nationkey").alias("country_id"))
            .agg(F.max("l_extendedprice").alias("retailprice"))
        )

    @cached_property
    def promotion(self) -> DataFrame:
        li = self.raw("lineitem")
        return (
            li.filter(F.col("l_discount") > 0.085)
            .select(
                F.col("l_partkey").alias("item_id"),
                (F.col("l_suppkey") % 25).alias("country_id"),
                F.col("l_discount").alias("discountrate"),
                F.col("l_shipdate").alias("startdate"),
                (F.col("l_shipdate") + _days(30)).alias("enddate"),
            )
            .distinct()
        )

    # ---- places ----------------------------------------------------------
    @cached_property
    def warehouse(self) -> DataFrame:
        return self.raw("supplier").select(
            F.col("s_suppkey").alias("id"),
            F.concat(F.lit("WH "), F.col("s_name")).alias("warehousename"),
            F.col("s_nationkey").alias("country_id"),
        )

    @cached_property
    def store(self) -> DataFrame:
        k = F.col("s_suppkey")
        return self.raw("supplier").select(
            k.alias("id"),
            F.concat(F.lit("Store "), F.col("s_name")).alias("name"),
            F.col("s_nationkey").alias("country_id"),
            (k - k % 2).alias("warehouse_id"),
        )

    @cached_property
    def supplier(self) -> DataFrame:
        return self.raw("supplier").select(
            F.col("s_suppkey").alias("id"),
            F.col("s_name").alias("suppliername"),
            F.col("s_nationkey").alias("country_id"),
        )

    @cached_property
    def storagebin(self) -> DataFrame:
        s = self.raw("supplier").select("s_suppkey")
        k = F.col("s_suppkey")
        inbound = s.filter(k % 10 != 9).select((k * 2).alias("id"), F.lit("Inbound").alias("type"), k.alias("warehouse_id"))
        outbound = s.select((k * 2 + 1).alias("id"), F.lit("Outbound").alias("type"), k.alias("warehouse_id"))
        return inbound.unionByName(outbound)

    @cached_property
    def facility(self) -> DataFrame:
        return self.raw("nation").select(
            F.col("n_nationkey").alias("id"), F.concat(F.lit("Facility "), F.col("n_name")).alias("name")
        )

    @cached_property
    def office(self) -> DataFrame:
        return self.raw("region").select(
            F.col("r_regionkey").alias("id"), F.concat(F.lit("Office "), F.col("r_name")).alias("name")
        )

    # ---- lines and orders ------------------------------------------------
    @cached_property
    def line(self) -> DataFrame:
        """Line items with a generated unique id (sorted once, materialized)."""
        li = self.raw("lineitem")
        order = [
            "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice",
            "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
        ]
        cols = [
            F.col("l_partkey").alias("item_id"),
            F.col("l_quantity").cast("long").alias("quantity"),
            F.col("l_orderkey").alias("order_id"),
            (F.col("l_suppkey") * 2 + F.when(F.col("l_linestatus") == "O", 1).otherwise(0)).alias("bin_id"),
        ]
        numbered = number_rows(li.select(*order), order, id_col="id", keep=cols).select("id", "item_id", "quantity", "order_id", "bin_id")
        # written once as parquet: later readers prune columns and push filters
        return write_table(numbered, "line")

    @cached_property
    def sale(self) -> DataFrame:
        return self.raw("orders").select(
            F.col("o_orderkey").alias("id"),
            F.col("o_custkey").alias("member_id"),
            F.col("o_orderdate").alias("createddate"),
            F.col("o_totalprice").alias("amountdue"),
            F.col("o_totalprice").alias("amountpaid"),
            F.lit("SGD").alias("currency"),
        )

    @cached_property
    def delivery(self) -> DataFrame:
        o = self.raw("orders").select("o_orderkey", "o_custkey")
        c = self.raw("customer").select("c_custkey", "c_name", "c_mktsegment")
        return (
            o.filter(F.col("o_orderkey") % 10 != 0)
            .join(c, o.o_custkey == c.c_custkey)
            .select(
                F.col("o_orderkey").alias("salerecord_id"),
                F.col("o_custkey").alias("member_id"),
                F.col("c_name").alias("name"),
                F.col("c_mktsegment").alias("delivery_address"),
            )
        )

    @cached_property
    def purchaseorder(self) -> DataFrame:
        o = self.raw("orders")
        k = F.col("o_orderkey")
        return o.filter(k % 2 == 0).select(
            k.alias("id"),
            F.col("o_orderdate").alias("createddate"),
            (F.col("o_orderdate") + _days(14)).alias("expecteddate"),
            F.when(F.col("o_orderstatus") == "O", "Pending")
            .when(F.col("o_orderstatus") == "P", "Submitted")
            .otherwise("Completed")
            .alias("status"),
            (k % 10).alias("supplier_id"),
            (F.col("o_custkey") % 10).alias("destination_id"),
        )

    @cached_property
    def shippingorder(self) -> DataFrame:
        o = self.raw("orders")
        k = F.col("o_orderkey")
        m = k % 5
        return o.filter(k % 2 == 1).select(
            k.alias("id"),
            F.col("o_orderdate").alias("createddate"),
            (F.col("o_orderdate") + _days(14)).alias("expecteddate"),
            F.when(m.isin(2, 3), F.col("o_orderdate") + _days(3)).alias("shippeddate"),
            F.when(m == 0, "Pending")
            .when(m == 1, "Submitted")
            .when(m == 2, "Shipped")
            .when(m == 3, "Completed")
            .otherwise("Unfulfillable")
            .alias("status"),
            (k % 10).alias("origin_id"),
            (F.col("o_custkey") % 10).alias("destination_id"),
        )

    @cached_property
    def supplier_item(self) -> DataFrame:
        li = self.raw("lineitem").select("l_suppkey", "l_partkey", "l_extendedprice")
        grouped = li.groupBy(F.col("l_suppkey").alias("supplier_id"), F.col("l_partkey").alias("item_id")).agg(
            F.min("l_extendedprice").alias("costprice")
        )
        return grouped.select(
            "supplier_id",
            "item_id",
            "costprice",
            (F.col("item_id") % 21 + 1).alias("leadtime"),
            (F.col("item_id") % 5 + 1).alias("lotsize"),
        )

    # ---- people ----------------------------------------------------------
    @cached_property
    def staff(self) -> DataFrame:
        return self.raw("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))

    @cached_property
    def member(self) -> DataFrame:
        k = F.col("c_custkey")
        return self.raw("customer").select(
            k.alias("id"),
            F.concat(F.lower(F.regexp_replace("c_name", "#", ".")), F.lit("@example.com")).alias("email"),
            F.col("c_name").alias("name"),
            F.concat(F.lit("6"), F.lpad(k.cast("string"), 7, "0")).alias("phone"),
            F.col("c_mktsegment").alias("city"),
            F.concat(F.lit("Block "), (k % 500).cast("string")).alias("address"),
            F.lpad((k % 1000000).cast("string"), 6, "0").alias("zipcode"),
        )

    @cached_property
    def staff_role(self) -> DataFrame:
        c = self.raw("customer").select("c_custkey", "c_nationkey")
        k = F.col("c_custkey")
        first = c.filter(k % 13 != 0).select(k.alias("staff_id"), (k % 11 + 1).alias("role_id"))
        second = c.filter(k % 4 == 0).select(k.alias("staff_id"), (F.col("c_nationkey") % 11 + 1).cast("long").alias("role_id"))
        return first.unionByName(second)

    @cached_property
    def accessright(self) -> DataFrame:
        k = F.col("c_custkey")
        m = k % 6
        return self.raw("customer").filter(m != 5).select(
            k.alias("staff_id"),
            F.when(m == 0, k % 25).alias("facility_id"),
            F.when(m == 1, k % 5).alias("office_id"),
            F.when(m.isin(1, 2), k % 10).alias("store_id"),
            F.when(m == 3, k % 10).alias("warehouse_id"),
        )

    @cached_property
    def cart(self) -> DataFrame:
        e = self.raw("events")
        return e.filter(F.col("event_type") == "click").select(
            F.col("user_id").alias("session"),
            F.get_json_object("props", "$.k").cast("long").alias("item_id"),
            F.col("ts"),
        )


_CACHE: dict[tuple[int, str], RetailTables] = {}


def tables(spark: SparkSession, root: str) -> RetailTables:
    """One shared ``RetailTables`` per session and folder (views built once)."""
    key = (id(spark), root.rstrip("/"))
    cached = _CACHE.get(key)
    if cached is None or cached.spark is not spark:
        cached = _CACHE[key] = RetailTables(spark, root)
    return cached
