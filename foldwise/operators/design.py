"""From raw series to the estimation sample: transform, lag, lead, scale, trim."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwise.functions.transforms import ROWS_BACK, TREND_CODE, transformed
from foldwise.operators.position import add_position, exact_quantiles, ordered_select, reposition, with_blocks
from foldwise.operators.storage import CHUNK_ROWS, attach, materialize, pinned
from foldwise.operators.trend import trend_ratio
from foldwise.plans.spec import Design
from foldwise.sources.frames import nan_to_null

SCALINGS = ("none", "l2", "standard", "robust", "minmax")


def coded(name: str, code: int) -> str:
    return f"{name}_{code}"


def transform_all(series: DataFrame, codes: dict[str, int], time_col: str, keys=(), carry=(),
                  chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``{name}_{code}`` for every series; ``series`` carries ``pos`` and ``n_rows``.

    A time that occurs twice in a key leaves the order open and fails the job.
    """
    keys = list(keys)
    smooth = [n for n, c in codes.items() if c == TREND_CODE]
    plain = {n: c for n, c in codes.items() if c != TREND_CODE}
    back = max([ROWS_BACK[c] for c in plain.values() if c in ROWS_BACK], default=0)

    def once(w):
        again = F.lag(time_col).over(w) == F.col(time_col)
        error = F.raise_error(F.concat(F.lit("the same time twice in a series: "), F.col(time_col).cast("string")))
        return F.when(again, error.cast("boolean")).otherwise(F.lit(True)).alias("_once")

    out = ordered_select(
        series,
        lambda w: [*keys, time_col, "pos", "n_rows", *carry, once(w),
                   *[transformed(F.col(n).cast("double"), c, w).alias(coded(n, c)) for n, c in plain.items()]],
        keys, before=max(back, 1), chunk_rows=chunk_rows).where("_once").drop("_once")
    for name in smooth:
        out = out.join(trend_ratio(series, name, coded(name, TREND_CODE), keys), [*keys, "pos"], "left")
    return out.select(*keys, time_col, "pos", "n_rows", *carry, *[coded(n, c) for n, c in codes.items()])


def speeds(meta: dict[str, str], to_fast=(), remove=()) -> tuple[list[str], list[str]]:
    """Names that enter with lags only, and names that enter in the same period too."""
    slow = [n for n, s in meta.items() if s == "slow" and n not in to_fast]
    fast = [n for n, s in meta.items() if s == "fast"]
    fast += [n for n in to_fast if n not in fast]
    return [n for n in slow if n not in remove], [n for n in fast if n not in remove]


def scaled(df: DataFrame, columns, method: str, keys=(), minmax_range=(-1.0, 1.0)) -> DataFrame:
    """Scale ``columns`` by key; columns without spread keep their scale."""
    keys, columns = list(keys), list(columns)
    if method not in SCALINGS:
        raise ValueError(f"unknown scaling {method!r}; known: {SCALINGS}")
    if method == "none" or not columns:
        return df
    if method == "robust":
        stats = _quartiles(df, columns, keys)
    else:
        # Per-column NULL where a lag does not exist; aggregates skip it.
        makers = {
            "l2": lambda c: [F.lit(0.0), F.sqrt(F.sum(F.col(c) * F.col(c)))],
            "standard": lambda c: [F.avg(c), F.stddev_pop(c)],
            "minmax": lambda c: [F.min(c), F.max(c) - F.min(c)],
        }
        aggs = []
        for i, c in enumerate(columns):
            center, spread = makers[method](c)
            aggs += [center.alias(f"_c{i}"), spread.alias(f"_s{i}")]
        stats = df.groupBy(*keys).agg(*([(F.max("pos") + 1).alias("n_rows")] if keys else []), *aggs)
    joined = attach(df, pinned(stats, keys), keys)
    low, high = minmax_range if method == "minmax" else (0.0, 1.0)
    new = {}
    for i, c in enumerate(columns):
        spread = F.coalesce(F.expr(f"nullif(_s{i}, 0D)"), F.lit(1.0))
        new[c] = F.lit(float(low)) + (F.col(c) - F.col(f"_c{i}")) * F.lit(float(high - low)) / spread
    return joined.withColumns(new).select(df.columns)


def _quartiles(df: DataFrame, columns, keys) -> DataFrame:
    values = F.explode(F.array(*[
        F.struct(F.lit(i).alias("_i"), F.col(c).cast("double").alias("_v")) for i, c in enumerate(columns)]))
    tall = df.select(*keys, values.alias("_e")).select(*keys, "_e._i", "_e._v")
    q = exact_quantiles(tall, "_v", [0.25, 0.5, 0.75], [*keys, "_i"])
    picks = []
    for i in range(len(columns)):
        mine = F.col("_i") == i
        picks += [F.max(F.when(mine, F.col("q50"))).alias(f"_c{i}"),
                  F.max(F.when(mine, F.col("q75") - F.col("q25"))).alias(f"_s{i}")]
    stats = q.groupBy(*keys).agg(*picks)
    if keys:
        stats = stats.join(df.groupBy(*keys).agg((F.max("pos") + 1).alias("n_rows")), keys)
    return stats


def feature_names(spec: Design) -> list[str]:
    """Column order of the control matrix."""
    kept = [n for n in spec.codes if n not in spec.remove]
    y, d = coded(spec.outcome, spec.codes[spec.outcome]), coded(spec.policy, spec.codes[spec.policy])
    fast = [*spec.fast, *[n for n in spec.to_fast if n not in spec.fast]]
    same_period = [coded(n, spec.codes[n]) for n in fast if n in kept]
    lagged = [f"lag{k}_{coded(n, spec.codes[n])}" for k in range(1, spec.lags + 1) for n in kept]
    return [*(["cons"] if spec.constant else []), *[c for c in same_period if c not in (y, d)], *lagged]


def check_names(spec: Design) -> None:
    for role, name in (("outcome", spec.outcome), ("policy", spec.policy)):
        if name not in spec.codes or name in spec.remove:
            raise KeyError(f"{role} series {name!r} is not among the transformed series")


def build_design(raw: DataFrame, spec: Design, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``keys, time, pos, n_rows, block_id, y, d, features..., lead0..leadH``, materialized.

    Three positions follow each other: on raw rows for the transformations, on
    complete rows for lags and leads, and on the final sample for the blocks.
    """
    check_names(spec)
    keys, t = list(spec.keys), spec.time_col
    series = add_position(nan_to_null(raw.select(*keys, t, *spec.codes), list(spec.codes)), t, keys)
    names = {n: coded(n, c) for n, c in spec.codes.items()}
    complete = transform_all(series, spec.codes, t, keys, chunk_rows=chunk_rows).dropna("any", subset=list(names.values()))
    numbered = reposition(materialize(complete), keys, chunk_rows).drop("old_pos")
    kept = [names[n] for n in spec.codes if n not in spec.remove]
    y, d = names[spec.outcome], names[spec.policy]
    features = feature_names(spec)

    def columns(w):
        made = {"cons": F.lit(1.0)}
        made.update({c: F.col(c) for c in kept})
        made.update({f"lag{k}_{c}": F.lag(c, k).over(w) for k in range(1, spec.lags + 1) for c in kept})
        leads = [(F.col(y) if h == 0 else F.lead(y, h).over(w)).alias(f"lead{h}") for h in range(spec.horizons + 1)]
        return [*keys, t, "pos", "n_rows", F.col(y).alias("y"), F.col(d).alias("d"),
                *[made[f].alias(f) for f in features], *leads]

    wide = ordered_select(numbered, columns, keys, before=spec.lags, after=spec.horizons, chunk_rows=chunk_rows)
    if spec.scaling != "none":
        targets = ["y", "d"] if spec.scale_outcome_policy else []
        wide = scaled(materialize(wide), [*targets, *[f for f in features if f != "cons"]],
                      spec.scaling, keys, spec.minmax_range)
    inside = (F.col("pos") >= spec.lags) & (F.col("pos") < F.col("n_rows") - spec.horizons)
    if spec.start is not None:
        inside &= F.col(t) >= F.lit(spec.start).cast("timestamp")
    if spec.end is not None:
        inside &= F.col(t) <= F.lit(spec.end).cast("timestamp")
    return final_sample(materialize(wide.where(inside)), spec.n_blocks, keys, chunk_rows)


def final_sample(rows: DataFrame, n_blocks: int, keys=(), chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Re-number a contiguous range, drop the tail that fills no block, add blocks.

    Keys with fewer than two rows per block are left out (see ``sample_status``);
    a single series that short is an error.
    """
    keys = list(keys)
    spans = pinned(sample_status(rows, n_blocks, keys), keys)
    if not keys:
        status, n = spans.select("status", "n_kept").first()
        if status != "ok":
            raise ValueError(f"only {n} rows are left for {n_blocks} folds")
    ends = spans.where("status = 'ok'").select(
        *keys, F.col("_first"), F.col("n_kept").alias("_kept"),
        *([F.col("_length").alias("n_rows")] if keys else []))
    new = F.col("pos") - F.col("_first")
    kept = (attach(rows, ends, keys, chunk_rows=chunk_rows)
            .withColumns({"pos": new, "n_rows": F.col("_kept")})
            .where("pos < n_rows").drop("_first", "_kept"))
    final = with_blocks(kept, n_blocks)
    return materialize(final) if keys else final  # without keys only arithmetic on the written rows


def sample_status(rows: DataFrame, n_blocks: int, keys=()) -> DataFrame:
    """Rows kept per key, and whether they fill the folds."""
    n = F.count(F.lit(1))
    spans = rows.groupBy(*keys).agg(n.alias("n_found"), F.min("pos").alias("_first"), F.max("n_rows").alias("_length"))
    kept = F.col("n_found") - F.col("n_found") % n_blocks
    return spans.withColumn("n_kept", kept).withColumn(
        "status", F.when(F.col("n_kept") < 2 * n_blocks, "too_short").otherwise("ok"))


def simple_design(series: DataFrame, y: str, d: str, features, n_blocks: int, keys=(), time_col: str = "ts",
                  leads=()) -> DataFrame:
    """The same sample table from columns that are ready to use.

    ``series`` carries ``pos`` and ``n_rows``.  Rows past the last full block
    keep a NULL block and take part in nothing.
    """
    cols = [F.col(c).cast("double").alias(c) for c in [*features]]
    lead_cols = leads or [y]
    out = series.select(*keys, time_col, "pos", "n_rows", F.col(y).cast("double").alias("y"),
                        F.col(d).cast("double").alias("d"), *cols,
                        *[F.col(c).cast("double").alias(f"lead{h}") for h, c in enumerate(lead_cols)])
    return with_blocks(out, n_blocks)
