"""CSV tables whose first two rows describe the columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Labels of the two describing rows.
SPEED_ROW = "speed"
CODE_ROW = "Transform:"

# Date layouts, day before month where both could be meant.
DATE_LAYOUTS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "yyyy/M/d", "d/M/yyyy", "d-M-yyyy", "d.M.yyyy", "M/d/yyyy", "yyyy-MM")


def parsed_date(c: Column) -> Column:
    return F.coalesce(*[F.try_to_timestamp(F.trim(c), F.lit(f)) for f in DATE_LAYOUTS])


def read_metadata_wide(spark: SparkSession, path: str, time_col: str = "ts") -> tuple[DataFrame, DataFrame]:
    """``series_meta(series, speed, tcode)`` and ``obs(time, series... DOUBLE)``.

    Cells that are no numbers become NULL.  Dates that cannot be read are an
    error when the rows are read.
    """
    raw = spark.read.csv(path, header=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    label, names = raw.columns[0], raw.columns[1:]
    key = F.col(f"`{label}`")
    # Every file of a folder may repeat the two rows; they have to agree.
    heads = raw.where(key.isin(SPEED_ROW, CODE_ROW)).withColumnRenamed(label, "_label").distinct()
    seen = {r["_label"]: r["n"] for r in heads.groupBy("_label").agg(F.count(F.lit(1)).alias("n")).collect()}
    for wanted in (SPEED_ROW, CODE_ROW):
        if wanted not in seen:
            raise ValueError(f"the table has no row {wanted!r}")
        if seen[wanted] > 1:
            raise ValueError(f"the rows {wanted!r} contradict each other")
    cells = F.array(*[F.struct(F.lit(n).alias("series"), F.col(f"`{n}`").alias("value")) for n in names])
    tall = heads.select("_label", F.explode(cells).alias("_c")).select("_label", "_c.series", "_c.value")
    meta = tall.groupBy("series").agg(
        F.max(F.when(F.col("_label") == SPEED_ROW, F.lower(F.trim("value")))).alias("speed"),
        F.max(F.when(F.col("_label") == CODE_ROW, F.col("value").try_cast("double").cast("int"))).alias("tcode"))
    when = parsed_date(key)
    checked = F.when(when.isNull(), F.raise_error(F.concat(F.lit("not a date: "), key))).otherwise(when)
    body = raw.where(~key.isin(SPEED_ROW, CODE_ROW) | key.isNull())
    obs = body.select(checked.cast("timestamp").alias(time_col), *[F.col(f"`{n}`").try_cast("double").alias(n) for n in names])
    return meta, obs


def meta_dicts(meta: DataFrame) -> tuple[dict[str, str], dict[str, int]]:
    """Speeds and codes by series (one row per column of the table)."""
    rows = meta.collect()
    return {r["series"]: r["speed"] for r in rows}, {r["series"]: r["tcode"] for r in rows}


def wide_with_metadata(obs: DataFrame, speeds: dict[str, str], codes: dict[str, int], time_col: str = "ts") -> DataFrame:
    """The reverse: text rows in the layout ``read_metadata_wide`` reads."""
    names = list(speeds)
    spark = obs.sparkSession
    schema = ", ".join(f"`{c}` string" for c in [time_col, *names])
    heads = spark.createDataFrame([(SPEED_ROW, *[speeds[n] for n in names]),
                                   (CODE_ROW, *[str(codes[n]) for n in names])], schema)
    body = obs.select(F.date_format(time_col, "yyyy-MM-dd").alias(time_col), *[F.col(n).cast("string").alias(n) for n in names])
    return heads.unionByName(body)
