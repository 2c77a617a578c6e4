"""Time series aggregated (or read row by row) from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bucket(unit: str, ts: str) -> Column:
    return F.date_trunc(unit, F.col(ts)).cast("timestamp_ntz")


def sales(spark: SparkSession, sf_dir: str, unit: str = "week") -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return lines.groupBy(bucket(unit, "l_shipdate").alias("ts")).agg(
        F.sum("l_quantity").alias("qty"),
        F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"),
        F.avg("l_discount").alias("avg_disc"), F.avg("l_tax").alias("avg_tax"),
        F.count(F.lit(1)).cast("double").alias("n_lines"),
        F.sum(F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0)).alias("n_returned"))


def event_buckets(spark: SparkSession, sf_dir: str, hours: int = 6) -> DataFrame:
    events = table(spark, sf_dir, "events")
    hour = F.floor(F.hour("ts") / hours) * hours
    start = (F.date_trunc("day", F.col("ts")) + F.make_dt_interval(hours=hour)).cast("timestamp_ntz")
    count_of = lambda t: F.sum(F.when(F.col("event_type") == t, 1.0).otherwise(0.0))
    return events.groupBy(start.alias("ts")).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum("value").alias("value_sum"), F.avg("value").alias("value_avg"),
        *[count_of(t).alias(f"n_{t}") for t in ("click", "view", "purchase", "error", "signup")])


def orders_by(spark: SparkSession, sf_dir: str, keys=()) -> DataFrame:
    """Monthly orders, all together or by a column of the orders."""
    orders = table(spark, sf_dir, "orders")
    return orders.groupBy(*keys, bucket("month", "o_orderdate").alias("ts")).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum("o_totalprice").alias("total"),
        F.avg("o_totalprice").alias("avg_total"),
        F.sum(F.when(F.col("o_orderpriority") == "1-URGENT", 1.0).otherwise(0.0)).alias("n_urgent"))


def events_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event in order: one long series, as long as the table."""
    return table(spark, sf_dir, "events").select(
        "event_id", "user_id", F.col("value").cast("double").alias("value"),
        F.regexp_extract("props", "([0-9]+)", 1).cast("double").alias("k"),
        F.when(F.col("event_type") == "click", 1.0).otherwise(0.0).alias("click"))


def user_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many short series: the days on which each user was active."""
    return table(spark, sf_dir, "events").groupBy("user_id", bucket("day", "ts").alias("ts")).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum("value").alias("value_sum"))
