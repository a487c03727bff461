"""Write a derived table once into the session's shared checkpoint folder.

A parquet table (unlike an RDD checkpoint) keeps column pruning and filter
pushdown for every later reader, and cuts the lineage: losing an executor
later never recomputes the upstream sort.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as parquet under ``<checkpoint dir>/tables/`` and read it back."""
    spark = df.sparkSession
    root = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{root}/tables/{name}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    return spark.read.parquet(path)


def write_counted(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """``write_table`` and the number of rows, counted while they are written."""
    seen = Observation()
    written = write_table(df.observe(seen, F.count(F.lit(1)).alias("rows")), name)
    return written, seen.get["rows"]


def sized_side(df: DataFrame, name: str) -> DataFrame:
    """A derived join side with a proven size: written once, so its plan size
    is the real file size; broadcast only when that passes the size check."""
    from .joins import maybe_broadcast

    return maybe_broadcast(write_table(df, name))
