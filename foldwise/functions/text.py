"""Text forms of estimates for report tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    """The number, or NULL for NaN and infinities."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def stars(p: Column, thresholds=(0.01, 0.05, 0.10)) -> Column:
    a, b, c = thresholds
    p = finite(p)
    return F.when(p < a, "***").when(p < b, "**").when(p < c, "*").otherwise("")


def fixed(x: Column, digits: int) -> Column:
    """Fixed number of decimals, ``--`` where there is no finite number."""
    return F.when(finite(x).isNotNull(), F.format_string(f"%.{digits}f", finite(x))).otherwise("--")
