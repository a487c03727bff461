"""Helpers shared by the corpus operators: word splitting as Columns, text digests, held-out folds."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.materialize import write_table

# Separators of the two word definitions (regular expression classes).
SPACE_CLASS = r"[\x20\x09-\x0D]+"
NON_WORD_CLASS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def whole_text(col: str | Column) -> Column:
    """The text, with null read as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only.  Pure ASCII text takes the byte-wise ``lower``, which does the same there."""
    ascii_only = F.octet_length(text) == F.length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


def words(text: Column, separators: str = SPACE_CLASS) -> Column:
    """The words of a text as an array (empty array for a text without words)."""
    return F.array_remove(F.split(text, separators), "")


def fold(doc_id: str, modulus: int) -> Column:
    """crc32 of the id's text modulo ``modulus`` (null for a null id)."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus


# Whole texts are handed to Python in Arrow batches of at most this many rows, which bounds a worker's memory.
TEXT_BATCH = 1024


def bound_text_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch size to TEXT_BATCH rows where it is larger."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= TEXT_BATCH:
        spark.conf.set(key, str(TEXT_BATCH))


# A key table is broadcast up to this many rows (a long key takes about 24 bytes there: 48 MB).
BROADCAST_ROWS = 2_000_000


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have (names are compared without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def keys_side(keys: DataFrame, name: str) -> DataFrame:
    """A side of distinct keys, written once and counted: broadcast up to BROADCAST_ROWS, joined by shuffle beyond."""
    written = write_table(keys.distinct(), name)
    return F.broadcast(written) if written.count() <= BROADCAST_ROWS else written
