"""Join strategy helpers.

Broadcasting is only requested for a side whose size is bounded: either a
table built from fixed values (room map, status rules, access areas), or a
dimension whose optimizer size estimate, scaled by a safety factor for
decompression, stays under the session broadcast threshold.  Anything larger
is joined by shuffle; AQE may still turn that into a broadcast at runtime,
from measured shuffle sizes, and splits skewed partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Parquet is compressed on disk; in-memory rows are usually several times larger.
EXPANSION = 8
DEFAULT_LIMIT = 10 * 1024 * 1024


def estimated_bytes(df: DataFrame) -> int:
    """Optimizer size estimate of a DataFrame (no job is run).

    Where the estimate is not reachable (e.g. a remote session) the answer is
    "unbounded", so nothing is broadcast on a guess.
    """
    try:
        stats = df._jdf.queryExecution().optimizedPlan().stats()
        return int(str(stats.sizeInBytes()))
    except Exception:  # noqa: BLE001
        return 1 << 62


_UNITS = {"": 1, "b": 1, "k": 1 << 10, "kb": 1 << 10, "m": 1 << 20, "mb": 1 << 20, "g": 1 << 30, "gb": 1 << 30}


def broadcast_limit(df: DataFrame) -> int:
    """The session's broadcast threshold in bytes; 0 when broadcasting is switched off (-1)."""
    raw = str(df.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold", str(DEFAULT_LIMIT))).strip().lower()
    digits = raw.lstrip("-0123456789")
    number, unit = raw[: len(raw) - len(digits)], digits.strip()
    try:
        value = int(number) * _UNITS.get(unit, 1)
    except ValueError:
        value = DEFAULT_LIMIT
    return max(value, 0)


def is_small(df: DataFrame, limit: int | None = None) -> bool:
    """True when the size estimate times the decompression margin is within the threshold."""
    limit = broadcast_limit(df) if limit is None else limit
    return limit > 0 and estimated_bytes(df) * EXPANSION <= limit


def maybe_broadcast(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Broadcast ``df`` only behind a size check; otherwise leave the choice to AQE."""
    return F.broadcast(df) if is_small(df, limit) else df


def counted_side(df: DataFrame, rows: int) -> DataFrame:
    """A join side of a known number of rows: broadcast when its decoded rows fit the threshold, else never.

    A file of numbers is far smaller than its rows in a hash table, so beyond the
    bound Spark is kept from broadcasting it by the file's size.
    """
    width = 48 + 24 * len(df.columns)
    return F.broadcast(df) if 0 < rows * width <= broadcast_limit(df) else df.hint("merge")


def fixed_broadcast(df: DataFrame) -> DataFrame:
    """Broadcast a table built from fixed values (its size does not grow with data)."""
    return F.broadcast(df)


def input_bytes(df: DataFrame) -> int:
    """Bytes of the plan's leaf inputs (scanned files, local tables).

    A proxy for the data volume of a derived table that does not inflate
    like the optimizer's estimate of a join output.
    """
    try:
        leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
        return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    except Exception:  # noqa: BLE001
        return 1 << 62


# Input bytes (as estimated on disk) per partition of a range-partitioned sort: few enough that
# its decoded rows are sorted in memory, and more only where the partitions would be too many.
SORT_PARTITION_BYTES = 32 * 1024 * 1024
SORT_PARTITION_MAX_BYTES = 512 * 1024 * 1024
SORT_PARTITIONS = 20_000


def sort_partitions(df: DataFrame) -> int:
    """Partition count for a range-partitioned sort of ``df``.

    AQE can merge small shuffle partitions but cannot split a range
    partition, so the count is sized from the input estimate (at least the
    session's shuffle partitions) to keep every sorted partition within memory.
    """
    try:
        base = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    except ValueError:
        base = 200
    est = input_bytes(df)
    if est >= 1 << 60:
        return base
    return int(max(base, min(-(-est // SORT_PARTITION_BYTES), SORT_PARTITIONS), -(-est // SORT_PARTITION_MAX_BYTES)))
