"""Small column-expression helpers shared by the operators (all JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def pct(num, den, digits: int | None = 2) -> Column:
    """100 * num / den in double; NULL when den is 0 or NULL (SQL NULLIF)."""
    v = F.lit(100.0) * col(num).cast("double") / F.nullif(col(den).cast("double"), F.lit(0.0))
    return F.round(v, digits) if digits is not None else v


def ratio(num, den) -> Column:
    return col(num).cast("double") / F.nullif(col(den).cast("double"), F.lit(0.0))


def to_double(c, digits: int | None = None) -> Column:
    """Cast to double; with ``digits`` round first (exact for decimals)."""
    v = col(c)
    return (F.round(v, digits) if digits is not None else v).cast("double")


def month_text(ts) -> Column:
    """'YYYY-MM' month text, as the reference stores months."""
    return F.date_format(col(ts), "yyyy-MM")


def quarter_index(ts) -> Column:
    """Calendar quarter as one increasing integer: year*4 + quarter-1."""
    return F.year(col(ts)) * 4 + F.quarter(col(ts)) - 1


def quarter_label_from_index(qidx) -> Column:
    q = col(qidx)
    return F.concat(F.floor(q / 4).cast("string"), F.lit("-Q"), (F.pmod(q, F.lit(4)) + 1).cast("string"))
