"""Input from any DataFrame, and result writers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldwise.operators.position import add_position, check_times


def from_dataframe(df: DataFrame, time_col: str, y: str, d: str, features, keys=(), n_blocks: int | None = None,
                   check: bool = True) -> DataFrame:
    """Positioned rows of an ordered table, after checks on columns, types and times."""
    features, keys = list(features), list(keys)
    types = dict((f.name, f.dataType) for f in df.schema.fields)
    for c in [*keys, time_col, y, d, *features]:
        if c not in types:
            raise KeyError(f"no column {c!r}")
    for c in [y, d, *features]:
        if not isinstance(types[c], T.NumericType):
            raise TypeError(f"column {c!r} is {types[c].simpleString()}, not a number")
    if check:
        bad = check_times(df, time_col, keys).first()
        if bad is not None:
            raise ValueError(f"times must be given and unique in a series: {bad.asDict()}")
    wanted = list(dict.fromkeys([*keys, time_col, y, d, *features]))
    return add_position(nan_to_null(df.select(*[F.col(f"`{c}`") for c in wanted]), [y, d, *features]), time_col, keys, n_blocks)


def nan_to_null(df: DataFrame, columns) -> DataFrame:
    """NULL for NaN in floating columns: there is one kind of missing value."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    floats = [c for c in dict.fromkeys(columns) if isinstance(kinds.get(c), (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.nanvl(F.col(f"`{c}`"), F.lit(None).cast(kinds[c])) for c in floats}) if floats else df


def write_irf(irf: DataFrame, path: str, by=(), format: str = "csv") -> None:
    """Impulse-response rows as csv (with header) or parquet, one folder per value of ``by``."""
    writer = irf.write.mode("overwrite").format(format)
    if format == "csv":
        writer = writer.option("header", True)
    (writer.partitionBy(*by) if by else writer).save(path)


def effect_frame(effect: DataFrame, keys=()) -> DataFrame:
    """The headline row of a fit."""
    return effect.select(*keys, F.col("coef").alias("coefficient"), "std_error", "t_stat", "p_value", "ci_lower", "ci_upper",
                         "n_obs", "n_blocks")
