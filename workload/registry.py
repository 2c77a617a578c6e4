"""Where queries and their SQL meet."""

from __future__ import annotations

from pyspark.sql import functions as F

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return keep


def rnd(name: str, digits: int = 6, out: str | None = None):
    """A double rounded for comparison, under its own name or ``out``."""
    return F.round(F.col(name), digits).alias(out or name)


def day(name: str = "ts"):
    return F.date_format(name, "yyyy-MM-dd HH:mm").alias(name)
