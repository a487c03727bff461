"""Column helpers for the store's row rules (all JVM-side expressions)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round_half_up_1(x: str | Column) -> Column:
    """Half-up rounding to one decimal: floor(x*10 + 0.5) / 10."""
    return F.floor(_c(x) * 10 + 0.5) / 10


def volume(length: str | Column, width: str | Column, height: str | Column) -> Column:
    """Length x width x height, as stored with a new item."""
    return _c(length) * _c(width) * _c(height)


def price_text(price: str | Column) -> Column:
    """Price shown with two decimals; NULL or 0 shows 0.00."""
    p = F.coalesce(F.nullif(_c(price).cast("double"), F.lit(0.0)), F.lit(0.0))
    return F.format_string("%.2f", p)


def availability(qty: str | Column) -> Column:
    """'Available' when the stock is above zero (NULL counts as 0)."""
    return F.when(F.coalesce(_c(qty), F.lit(0)) > 0, "Available").otherwise("Unavailable")


def percent_text(rate: str | Column) -> Column:
    """A rate strictly between 0 and 1 as a whole percent ('20%'); else the value as text."""
    r = _c(rate).cast("double")
    pct = F.floor(r * 100 + 0.5).cast("long").cast("string")
    return F.when((r > 0) & (r < 1), F.concat(pct, F.lit("%"))).otherwise(_c(rate).cast("string"))


def first_non_empty(cols: Sequence[str | Column], fallback: str | Column) -> Column:
    """First value that is neither NULL nor '' (``pick`` of the shop pages)."""
    fb = fallback if isinstance(fallback, Column) else F.lit(fallback)
    return F.coalesce(*[F.nullif(_c(c).cast("string"), F.lit("")) for c in cols], fb)


def catalogue_image(url: str | Column) -> Column:
    """NULL/'' -> default image; a path with '/' as is; a bare file name in the products folder."""
    u = _c(url)
    return (
        F.when(u.isNull() | (u == ""), F.lit(K.DEFAULT_PRODUCT_IMAGE))
        .when(F.instr(u, "/") > 0, u)
        .otherwise(F.concat(F.lit(K.PRODUCT_IMAGE_DIR), u))
    )


def promotion_image(url: str | Column, legacy_prefix: str | None = None) -> Column:
    """Promotion image path.

    NULL/'' -> default; '/img/...' as is; ``legacy_prefix`` + rest -> '/img/' + rest;
    http(s) URLs as is; a relative path with '/' gets a leading '/'; a bare
    file name goes to the promotions folder.
    """
    u = _c(url)
    rule = F.when(u.isNull() | (u == ""), F.lit(K.DEFAULT_PRODUCT_IMAGE)).when(u.startswith(K.IMAGE_PREFIX), u)
    if legacy_prefix:
        rest = F.substring(u, len(legacy_prefix) + 1, 1 << 30)
        rule = rule.when(u.startswith(legacy_prefix), F.concat(F.lit(K.IMAGE_PREFIX), rest))
    return (
        rule.when(u.startswith("http://") | u.startswith("https://"), u)
        .when((F.instr(u, "/") > 0) & ~u.startswith("/"), F.concat(F.lit("/"), u))
        .otherwise(F.concat(F.lit(K.PROMOTION_IMAGE_DIR), u))
    )


def sku_image(sku: str | Column) -> Column:
    """Image path a new furniture or retail item gets from its SKU."""
    return F.concat(F.lit(K.PRODUCT_IMAGE_DIR), _c(sku), F.lit(".jpg"))


def live(isdeleted: str | Column = "isdeleted") -> Column:
    """Not soft-deleted.  ``isdeleted = FALSE``: NULL is dropped as in SQL."""
    return _c(isdeleted) == F.lit(False)
