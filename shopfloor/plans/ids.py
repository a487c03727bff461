"""New row ids without a single-task window.

``row_number() OVER (ORDER BY k)`` with no partition runs in one task.  Here
the rows are range-partitioned and sorted on ``k``; each partition counts its
rows, the per-partition counts (one row per partition, so bounded by the
partition count, not by the data) give running offsets, and every row gets
``offset + position in partition``.  The result equals the global row number
for a total order ``k``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import fixed_broadcast, sort_partitions
from .materialize import write_table


def number_rows(
    df: DataFrame,
    order: Sequence[str | Column],
    id_col: str = "id",
    start: int | Column = 0,
    keep: Sequence[str | Column] | None = None,
) -> DataFrame:
    """Add ``id_col = start + row_number() over (order by order)`` (1-based).

    ``order`` must be a total order for deterministic ids.  The sorted rows
    (with their partition and position) are written to the session's shared
    checkpoint folder before they are counted.  This is needed for correctness, not only speed: the range
    partitioner samples with a seed tied to the plan's RDD, so two separate
    executions of the sort may cut the ranges differently, and offsets counted
    in one would not fit the rows of the other.  ``keep`` limits the columns
    carried past the sort; columns derived from others belong there, so the sort
    does not move them.
    """
    ordered = (
        df.repartitionByRange(sort_partitions(df), *order)
        .sortWithinPartitions(*order)
        .withColumn("_pid", F.spark_partition_id())
        .withColumn("_mid", F.monotonically_increasing_id())
    )
    if keep is not None:
        ordered = ordered.select(*keep, "_pid", "_mid")
    # written once as parquet (fast, columnar; the lineage is cut): the ids use the
    # stored _pid / _mid, so they do not depend on how the files are read back
    ordered = write_table(ordered, "numbered")
    counts = ordered.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    base = start if isinstance(start, Column) else F.lit(start)
    position = F.col("_mid") - F.shiftleft(F.col("_pid").cast("long"), 33)
    return (
        ordered.join(fixed_broadcast(offsets), "_pid")
        .withColumn(id_col, (base + F.col("_off") + position + 1).cast("long"))
        .drop("_pid", "_mid", "_off")
    )


def max_id(df: DataFrame, col: str = "id") -> int:
    """Largest id of a table (one scalar to the driver); 0 when empty."""
    value = df.agg(F.max(col)).first()[0]
    return int(value) if value is not None else 0
