"""Link rows between lines and what holds them (bins, orders, sales).

The store keeps lines and their links apart: a line row, and one link row per
bin, order or sale it stands in.  The library's line view carries the links
as columns (``bin_id``, ``order_id``), so reads need no join between two
line-sized tables.  These operators go between the two forms: ``fold_links``
reads link tables into the line view, and the others give the link rows of a
line snapshot, as every write on lines must store them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bin_links(lines: DataFrame) -> DataFrame:
    """(bin_id, lineitem_id) of every line that stands in a bin."""
    return lines.filter(F.col("bin_id").isNotNull()).select("bin_id", F.col("id").alias("lineitem_id"))


def order_links(lines: DataFrame, orders: DataFrame | None = None) -> DataFrame:
    """(order_id, lineitem_id) of every line of an order; with ``orders``, of those orders only."""
    linked = lines.filter(F.col("order_id").isNotNull()).select("order_id", F.col("id").alias("lineitem_id"))
    if orders is None:
        return linked
    return linked.join(orders.select(F.col("id").alias("order_id")), "order_id", "left_semi")


def fold_links(lines: DataFrame, in_bins: DataFrame, in_orders: DataFrame) -> DataFrame:
    """Lines (id, item_id, quantity) with their ``order_id`` and ``bin_id``; a row per pair of links, null where none.

    Both joins are on the line id, so the lines are shuffled once for both.
    """
    bins = in_bins.select(F.col("lineitem_id").alias("id"), "bin_id")
    orders = in_orders.select(F.col("lineitem_id").alias("id"), "order_id")
    return lines.join(orders, "id", "left").join(bins, "id", "left").select("id", "item_id", "quantity", "order_id", "bin_id")
