"""Registered queries: one Spark plan and one oracle SQL text per key.

Every query reads the whole fixture tables (or views Spark derives from
them).  Parameters that the store takes per request (country, as-of date,
search text, page) are fixed per key; request and change batches are derived
from the tables themselves, so they grow with the data.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .oracle import with_views
from .sources.fixtures import RetailTables, tables

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

# Fixture parameters.
COUNTRY = 19  # stands for the store's fixed history country (nation keys are 0..24)
PROMO_AS_OF = dt.date(2001, 1, 1)
ORDER_AS_OF = dt.date(1998, 1, 1)


def register(name: str, sql: str | None):
    """Register ``fn(t: RetailTables) -> DataFrame`` under ``name`` with its oracle SQL."""

    def wrap(fn: Callable[[RetailTables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(tables(spark, sf_dir))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = with_views(sql)
        return fn

    return wrap


# Importing the query modules fills the registries.
from . import queries_catalog, queries_changes, queries_grid, queries_orders, queries_stock  # noqa: E402,F401
