"""Change-batch helpers shared by the snapshot operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def last_per_key(batch: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Keep one change per key: the greatest by ``order`` (e.g. seq, then value).

    Written as an aggregate of ``max_by`` over a struct, so it combines
    map-side and a hot key never lands whole in one task.
    """
    value_cols = [c for c in batch.columns if c not in keys]
    if not value_cols:
        return batch.dropDuplicates(list(keys))
    rank = F.struct(*order) if len(order) > 1 else order[0]
    picked = batch.groupBy(*keys).agg(
        F.max_by(F.struct(*[F.col(c) for c in value_cols]), rank).alias("_v")
    )
    return picked.select(*keys, *[F.col(f"_v.{c}").alias(c) for c in value_cols])


def last_value(batch: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Keep one number per key: the last by ``seq`` (when the batch has it), ties by the larger value.

    Both steps are hash aggregates over plain values.
    """
    if "seq" not in batch.columns:
        return batch.groupBy(*keys).agg(F.max(value).alias(value))
    per_seq = batch.groupBy(*keys, "seq").agg(F.max(value).alias(value))
    # a row without seq comes before all others
    return per_seq.groupBy(*keys).agg(F.coalesce(F.max_by(value, "seq"), F.max(value)).alias(value))


def first_rows(batch: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``batch`` (with a row id ``_rid``) and ``_first``: whether the row is its key's first by ``order``."""
    firsts = batch.groupBy(*keys).agg(F.min(F.struct(*order, "_rid")).alias("_f")).select(F.col("_f._rid").alias("_rid"), F.lit(True).alias("_first"))
    return batch.join(firsts, "_rid", "left").withColumn("_first", F.coalesce("_first", F.lit(False)))


def sum_per_key(batch: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Pre-sum deltas per key so a join never multiplies rows."""
    return batch.groupBy(*keys).agg(F.sum(value).alias(value))
