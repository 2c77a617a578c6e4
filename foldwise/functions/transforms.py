"""Stationarity transformations by code, as window expressions."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

# The known codes, and how many earlier rows each one reads.
ROWS_BACK = {1: 0, 2: 1, 3: 2, 4: 0, 5: 1, 6: 2, 7: 1, 8: 12, 81: 4, 9: 0, 10: 12, 101: 4, 11: 12, 111: 4}

TRANSFORM_CODES = tuple(ROWS_BACK)
TREND_CODE = 9


def positive_log(x: Column) -> Column:
    return F.when(x > 0, F.ln(x))


def transformed(x: Column, code: int, w: Window) -> Column:
    """The transformed series; NULL where it is not defined."""
    if code not in TRANSFORM_CODES:
        raise ValueError(f"unknown transformation code {code}; known codes: {sorted(TRANSFORM_CODES)}")
    if code == TREND_CODE:
        raise ValueError("code 9 smooths a whole series; use operators.trend.trend_ratio")
    back = ROWS_BACK[code]
    base = positive_log(x) if code in (4, 5, 6, 8, 81) else x
    if code in (1, 4):
        return base
    if code in (3, 6):
        return base - 2 * F.lag(base, 1).over(w) + F.lag(base, 2).over(w)
    change = base - F.lag(base, back).over(w)
    if code in (7, 11, 111):
        return 100 * F.try_divide(change, F.lag(base, back).over(w))
    return 100 * change if code == 5 else change
