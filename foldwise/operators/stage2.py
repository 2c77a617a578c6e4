"""Effect of the policy from residuals, with standard errors that allow serial dependence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldwise.functions.dist import (
    critical_value, fixed_b_bartlett, normal_p_value, t_critical, t_p_value)
from foldwise.operators.hac import (
    LAG_COLUMNS, centred_lrv, clipped, default_bandwidth, first_autocorrelation, kernel_named, kernel_sum, lag_products, rule_bandwidth,
    side_by_side_lrv)
from foldwise.operators.position import reposition
from foldwise.operators.storage import CHUNK_ROWS, attach, beside, literals, materialize, pinned
from foldwise.plans.spec import Inference


#: Lag columns of all leads together that one pass may have.
SIDE_BY_SIDE_LAGS = 300


def _line(intercept: bool, outcome: str = "chi") -> dict[str, Column]:
    """Least-squares aggregates of ``outcome`` on ``xi``."""
    x, y, n = F.col("xi"), F.col(outcome), F.count(F.lit(1))
    if intercept:
        sxx, sxy, syy = F.regr_sxx(y, x), F.regr_sxy(y, x), F.regr_syy(y, x)
        slope = F.try_divide(sxy, sxx)
        const = F.avg(y) - slope * F.avg(x)
    else:
        sxx, sxy, syy = F.sum(x * x), F.sum(x * y), F.sum(y * y)
        slope, const = F.try_divide(sxy, sxx), F.lit(0.0)
    left = n - (2 if intercept else 1)
    error = F.greatest(syy - slope * sxy, F.lit(0.0))
    return {"n_obs": n, "coef": slope, "const": const, "std_error": F.sqrt(F.try_divide(error, left * sxx)),
            "spread": sxx, "mean_xi": F.avg(x), "sum_xx": F.sum(x * x),
            "sum_score": F.sum(x * y) - const * F.sum(x), "n_rows": F.max("n_rows"), "var_xi": F.var_pop(x)}


def complete(resid: DataFrame) -> DataFrame:
    """The rows in folds that have both residuals; NaN counts as missing."""
    known = [F.col(c).isNotNull() & ~F.isnan(c) for c in ("chi", "xi")]
    return resid.where(F.col("block_id").isNotNull() & known[0] & known[1])


def fold_fits(resid: DataFrame, by=(), intercept: bool = True) -> DataFrame:
    """One least-squares line per fold: ``by, block_id, n_obs, coef, const, std_error, ...``."""
    places = [F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos")] if "pos" in resid.columns else []
    return complete(resid).groupBy(*by, "block_id").agg(*[c.alias(n) for n, c in _line(intercept).items()], *places)


def _gapless(scores: DataFrame, fits: DataFrame, by, chunk_rows: int, shift: Column) -> DataFrame:
    """``scores`` numbered 0, 1, 2, ... as the long-run variances need them.

    ``fits`` (a small stored table) knows from the first and last position whether
    rows are missing inside; only then the rows are numbered anew, else ``shift`` does.
    """
    if fits.where(F.col("last_pos") - F.col("first_pos") + 1 != F.col("n_obs")).isEmpty():
        return scores.withColumn("pos", F.col("pos") + shift).drop("shift", "first_pos")
    scores = scores.drop("shift", "first_pos")
    if "n_rows" not in scores.columns:
        scores = scores.withColumn("n_rows", F.lit(0).cast("bigint"))
    return reposition(materialize(scores), by, chunk_rows).drop("old_pos")


def with_inference(df: DataFrame, level: float, intercept: bool, crit: Column | None = None) -> DataFrame:
    """t, p and interval columns from ``coef, std_error, n_obs``."""
    se, n = F.col("std_error"), F.col("n_obs")
    normal = critical_value(level, n)
    df = df.withColumn("_crit", normal if crit is None else F.coalesce(crit, normal))
    df = df.withColumn("t_stat", F.when(se > 1e-10, F.abs(F.try_divide(F.col("coef"), se))).otherwise(0.0))
    df = df.withColumn("p_value", t_p_value(F.col("t_stat"), n - (2 if intercept else 1)))
    return (df.withColumn("ci_lower", F.col("coef") - F.col("_crit") * se)
            .withColumn("ci_upper", F.col("coef") + F.col("_crit") * se).drop("_crit"))


def _block_folds(fits: DataFrame, by) -> tuple[DataFrame, DataFrame]:
    """``(folds, stats)``: the usable folds, stored, with the common slope and their place in the order, and one row per group."""
    whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    usable = fits.where((F.col("n_obs") > 1) & F.col("coef").isNotNull())
    # At most K rows per group: the windows below stay small.
    folds = usable.withColumn("theta", F.avg("coef").over(whole))
    folds = folds.withColumn("score_mean", F.sum(F.col("sum_score") - F.col("theta") * F.col("sum_xx")).over(whole)
                             / F.sum("n_obs").over(whole))
    # A fold without a slope leaves no hole in the order of the scores: later folds move up.
    earlier = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy("block_id").rowsBetween(
        Window.unboundedPreceding, -1)
    folds = folds.withColumn("shift", F.coalesce(F.sum("n_obs").over(earlier), F.lit(0)) - F.col("first_pos"))
    folds = materialize(folds)
    ordered = F.array_sort(F.collect_list(F.struct("block_id", "coef", "std_error")))
    stats = folds.groupBy(*by).agg(
        F.max("n_rows").alias("n_rows"), F.avg("coef").alias("coef"), F.sum("n_obs").alias("n_obs"),
        F.count(F.lit(1)).alias("n_blocks"), (F.sum("sum_xx") / F.sum("n_obs")).alias("jacobian"),
        F.sum(F.col("std_error") * F.col("std_error")).alias("_se2"), ordered.alias("_folds"))
    return folds, stats.withColumn("block_coefs", F.transform("_folds", lambda f: f["coef"])).withColumn(
        "block_ses", F.transform("_folds", lambda f: f["std_error"])).drop("_folds")


def _asked_width(spec: Inference, by, rho: Column | None = None) -> tuple[Column, bool]:
    """The bandwidth that ``spec`` asks for, and whether it is an explicit one."""
    rule, n = (spec.rule or "small").lower(), F.col("n_obs")
    if spec.lag is not None:
        return F.lit(int(spec.lag)), True
    if rule == "small" and spec.value is None:
        return (F.col("h") + 1, True) if "h" in by else (default_bandwidth(kernel_named(spec.kernel), n), False)
    if rule.startswith("andrews"):
        return rule_bandwidth(rule, n, rho=rho), True
    return rule_bandwidth(rule, n, F.col("h") if "h" in by else 0, spec.value), True


def _block_errors(both: DataFrame, spec: Inference, by, explicit: bool) -> DataFrame:
    """The result rows from group rows with ``lrv_0_0, jacobian, asked``."""
    kernel, n = kernel_named(spec.kernel), F.col("n_obs")
    # Rounding can leave a tiny negative variance where a kernel allows it.
    se = F.when(F.col("lrv_0_0") >= 0, F.sqrt(F.try_divide(F.col("lrv_0_0"), F.col("jacobian") * F.col("jacobian") * n)))
    out = both.select(*by, "coef", se.alias("std_error"), "n_obs", "n_blocks", "bandwidth", "asked", "block_coefs", "block_ses")
    crit = None
    if spec.fixed_b and kernel == "ewc":
        terms = F.col("asked") if explicit else rule_bandwidth("lls_ewc", n)
        crit = t_critical(spec.level, F.greatest(terms, F.lit(1)))
    elif spec.fixed_b and kernel == "bartlett" and explicit:
        crit = fixed_b_bartlett(spec.level, F.col("asked") / n)
    return _result(with_inference(out, spec.level, spec.intercept, crit).drop("asked"), by)


def _stacked_scores(resid: DataFrame, folds: DataFrame, by, chunk_rows: int) -> DataFrame:
    """The centred scores of all usable folds, ``by, pos, score``, numbered 0, 1, 2, ..."""
    slopes = folds.select(*by, "block_id", *(["n_rows"] if by else []), "const", "theta", "score_mean", "shift")
    rows = attach(complete(resid).select(*by, "pos", "block_id", "chi", "xi"), slopes, by, ["block_id"], chunk_rows)
    error = F.col("chi") - F.col("const") - F.col("theta") * F.col("xi")
    scores = rows.select(*by, "pos", "shift", *(["n_rows"] if "n_rows" in rows.columns else []),
                         (F.col("xi") * error - F.col("score_mean")).alias("score"))
    return _gapless(scores, folds, by, chunk_rows, F.col("shift"))


def _andrews(spec: Inference) -> bool:
    return spec.lag is None and (spec.rule or "small").lower().startswith("andrews")


def _with_width(stats: DataFrame, spec: Inference, by) -> tuple[DataFrame, bool]:
    """``stats`` with ``asked, bandwidth, dof``; for the plug-in rule it has ``rho``."""
    width, explicit = _asked_width(spec, by, F.col("rho") if _andrews(spec) else None)
    return stats.withColumn("asked", width.cast("int")).withColumn(
        "bandwidth", clipped(spec.kernel, F.col("asked"), F.col("n_obs"))).withColumn("dof", F.col("n_blocks")), explicit


def _with_rho(stats: DataFrame, scores: DataFrame, by, chunk_rows: int) -> DataFrame:
    found = pinned(first_autocorrelation(scores, "score", by, chunk_rows), by)
    return stats.join(found, by, "left") if by else stats.withColumns(literals(found))


def _fold_average(stats: DataFrame, spec: Inference, by) -> DataFrame:
    plain = stats.select(*by, "coef", (F.sqrt("_se2") / F.col("n_blocks")).alias("std_error"), "n_obs", "n_blocks",
                         F.lit(None).cast("int").alias("bandwidth"), "block_coefs", "block_ses")
    return _result(with_inference(plain, spec.level, spec.intercept), by)


def stage2_block(resid: DataFrame, spec: Inference = Inference(), by=(), chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Average of the fold slopes; standard error from the stacked, ordered scores.

    ``resid`` has ``by, pos, n_rows, block_id, chi, xi``.  With ``h`` among ``by``
    the rule ``small`` means a bandwidth of ``h + 1``.
    """
    by = list(by)
    folds, stats = _block_folds(fold_fits(resid, by, spec.intercept), by)
    if spec.se == "fold_average":
        return _fold_average(stats, spec, by)
    if spec.se != "stacked_hac":
        raise ValueError(f"unknown standard error {spec.se!r}; known: stacked_hac, fold_average")
    scores = _stacked_scores(resid, folds, by, chunk_rows)
    if _andrews(spec):
        stats = _with_rho(stats, scores, by, chunk_rows)
    stats, explicit = _with_width(stats, spec, by)
    long_run = centred_lrv(scores, ["score"], stats, spec.kernel, by, chunk_rows).select(*by, "lrv_0_0")
    return _block_errors(beside(long_run, stats, by), spec, by, explicit)


def stage2_specs(resid: DataFrame, specs: dict[str, Inference], by=(), chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``stage2`` for several specifications, with their names in ``spec``.

    Specifications with the same intercept share the lines of the folds, the scores (stored
    once) and, for bandwidths up to ``LAG_COLUMNS``, one table of lag products: kernels, rules and
    critical values are then work on one row per group.
    """
    by, out = list(by), None

    def add(name, rows):
        nonlocal out
        rows = rows.withColumn("spec", F.lit(name))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)

    for name, spec in specs.items():
        if spec.method != "block":
            add(name, stage2(resid, spec, by, chunk_rows))
    for intercept in (True, False):
        mine = {name: spec for name, spec in specs.items() if spec.method == "block" and spec.intercept == intercept}
        if not mine:
            continue
        unknown = {spec.se for spec in mine.values()} - {"stacked_hac", "fold_average"}
        if unknown:
            raise ValueError(f"unknown standard errors {sorted(unknown)}; known: stacked_hac, fold_average")
        folds, stats = _block_folds(fold_fits(resid, by, intercept), by)
        stats = pinned(stats, by)
        stacked = {name: spec for name, spec in mine.items() if spec.se == "stacked_hac"}
        scores = materialize(_stacked_scores(resid, folds, by, chunk_rows)) if stacked else None
        if any(_andrews(spec) for spec in stacked.values()):
            stats = pinned(_with_rho(stats, scores, by, chunk_rows), by)
        short = {}
        for name, spec in mine.items():
            if name not in stacked:
                add(name, _fold_average(stats, spec, by))
                continue
            sized, explicit = _with_width(stats, spec, by)
            largest = sized.agg(F.max("bandwidth")).first()[0] or 0
            if kernel_named(spec.kernel) != "ewc" and largest <= LAG_COLUMNS:
                short[name] = spec, sized, explicit, largest
            else:
                long_run = centred_lrv(scores, ["score"], sized, spec.kernel, by, chunk_rows).select(*by, "lrv_0_0")
                add(name, _block_errors(beside(long_run, sized, by), spec, by, explicit))
        if short:
            products = pinned(lag_products(scores, ["score"], max(x[3] for x in short.values()), by, chunk_rows), by)
            for name, (spec, sized, explicit, _) in short.items():
                both = beside(sized, products, by)
                value = F.try_divide(kernel_sum(F.col("p_0_0"), spec.kernel, F.col("bandwidth")), F.col("n_obs") - F.col("dof"))
                add(name, _block_errors(both.withColumn("lrv_0_0", value), spec, by, explicit))
    return out


def stage2_horizons(resid: DataFrame, spec: Inference = Inference(), keys=(), chunk_rows: int = CHUNK_ROWS) -> DataFrame | None:
    """``stage2_block`` for every lead of a residual table (``xi, chi0..chiH``) at once, by ``keys`` and ``h``.

    Two passes over the rows as they are, whatever the number of leads: one for the lines of all
    folds and leads, one for the scores, side by side in a row, and their lag products, each
    with the bandwidth of its lead.  None if the table does not allow it: residuals are
    missing, a fold has no slope, or the lags are many; rows then go through ``stage2`` by lead.
    """
    keys, by = list(keys), [*keys, "h"]
    chis = sorted([c for c in resid.columns if c.startswith("chi") and c[3:].isdigit()], key=lambda c: int(c[3:]))
    if spec.method != "block" or spec.se != "stacked_hac" or kernel_named(spec.kernel) == "ewc" or _andrews(spec):
        return None
    rows = resid.where(F.col("block_id").isNotNull())
    known = lambda c: F.col(c).isNotNull() & ~F.isnan(c)
    lines = [F.struct(F.lit(int(c[3:])).alias("h"), F.count_if(known(c) & known("xi")).alias("_known"),
                      *[v.alias(n) for n, v in _line(spec.intercept, c).items()]).alias(f"_{c}") for c in chis]
    wide = rows.groupBy(*keys, "block_id").agg(F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), *lines)
    fits = materialize(wide.select(*keys, "block_id", "first_pos", "last_pos", F.explode(F.array(*[f"_{c}" for c in chis])).alias("_l")).select(
        *keys, "block_id", "first_pos", "last_pos", "_l.*"))
    whole = (F.col("_known") == F.col("n_obs")) & (F.col("last_pos") - F.col("first_pos") + 1 == F.col("n_obs")) & (F.col("n_obs") > 1) & F.col("coef").isNotNull()
    if not fits.where(~whole).isEmpty():
        return None
    folds, stats = _block_folds(fits, by)
    stats, explicit = _with_width(stats, spec, by)
    stats = materialize(stats)
    lags = {r["h"]: r["b"] for r in stats.groupBy("h").agg(F.max("bandwidth").alias("b")).collect()}  # one row per lead
    if max(lags.values(), default=0) > LAG_COLUMNS or sum(lags.values()) > SIDE_BY_SIDE_LAGS:
        return None
    by_lead = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("h", c))), lambda x: x[c]).alias(c)
    slopes = folds.groupBy(*keys, "block_id").agg(F.max("n_rows").alias("n_rows"), F.max("shift").alias("shift"), *[by_lead(c) for c in ("const", "theta", "score_mean")])
    slopes = materialize(slopes.select(*keys, "block_id", *(["n_rows"] if keys else []), "shift", "const", "theta", "score_mean"))
    placed = attach(rows.select(*keys, "pos", "block_id", "xi", *chis), slopes, keys, ["block_id"], chunk_rows)
    score = lambda i, c: F.col("xi") * (F.col(c) - F.col("const")[i] - F.col("theta")[i] * F.col("xi")) - F.col("score_mean")[i]
    scores = placed.select(*keys, (F.col("pos") + F.col("shift")).alias("pos"), *[score(i, c).alias(c) for i, c in enumerate(chis)])
    long_run = side_by_side_lrv(scores, {int(c[3:]): c for c in chis}, stats, lags, spec.kernel, keys, chunk_rows)
    return _block_errors(stats.join(long_run, by), spec, by, explicit)


def _result(df: DataFrame, by) -> DataFrame:
    return df.select(*by, "coef", "std_error", "t_stat", "p_value", "ci_lower", "ci_upper", "n_obs", "n_blocks",
                     "bandwidth", "block_coefs", "block_ses")


def _slope_score() -> Column:
    """Centred policy residual times the error of the line."""
    return (F.col("xi") - F.col("_center")) * (F.col("chi") - F.col("const") - F.col("coef") * F.col("xi"))


def stage2_full(resid: DataFrame, spec: Inference = Inference(), by=(), chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """One regression over all rows, with a serially robust (or plain) covariance."""
    by = list(by)
    rows = complete(resid)
    fits = rows.groupBy(*by).agg(*[c.alias(n) for n, c in _line(spec.intercept).items()],
                                 F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))
    fits = fits.withColumn("_center", F.col("mean_xi") if spec.intercept else F.lit(0.0))
    n = F.col("n_obs")
    if spec.hac:
        width = rule_bandwidth(spec.rule, n, F.col("h") if "h" in by else 0, spec.value)
        fits = pinned(fits.withColumn("bandwidth", clipped(spec.kernel, width, n)).withColumn("dof", F.lit(0)), by)
        line = fits.select(*by, *(["n_rows"] if by else []), "const", "coef", "_center", "first_pos")
        joined = attach(rows.select(*by, "pos", "chi", "xi"), line, by, chunk_rows=chunk_rows)
        scores = joined.select(*by, "pos", "first_pos", *(["n_rows"] if by else []), _slope_score().alias("score"))
        scores = _gapless(scores, fits, by, chunk_rows, -F.col("first_pos"))
        long_run = centred_lrv(scores, ["score"], fits, spec.kernel, by, chunk_rows).select(*by, "lrv_0_0")
        fits = beside(long_run, fits, by)
        fits = fits.withColumn("std_error", F.try_divide(F.sqrt(F.greatest(F.col("lrv_0_0"), F.lit(0.0)) * n), F.col("spread")))
    else:
        fits = fits.withColumn("bandwidth", F.lit(None).cast("int"))
    out = fits.select(*by, "coef", "std_error", "n_obs", F.lit(None).cast("bigint").alias("n_blocks"), "bandwidth",
                      F.lit(None).cast("array<double>").alias("block_coefs"),
                      F.lit(None).cast("array<double>").alias("block_ses"))
    return _result(with_inference(out, spec.level, spec.intercept), by)


def stage2(resid: DataFrame, spec: Inference = Inference(), by=(), chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    if spec.method == "block":
        return stage2_block(resid, spec, by, chunk_rows)
    if spec.method == "full":
        return stage2_full(resid, spec, by, chunk_rows)
    raise ValueError(f"unknown estimation method {spec.method!r}; known: block, full")


def block_statistics(resid: DataFrame, spec: Inference = Inference(), by=(), lag: int | Column | None = None,
                     chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Descriptive least squares per fold.

    ``lag`` asks for a robust error with that bandwidth; by horizon it may be
    ``F.col("h") + 1``.

    Folds with one row, or a policy residual without spread, give coefficient 0
    and NULL statistics.  p-values are normal for the Bartlett error, t otherwise.
    """
    by = list(by)
    rows = complete(resid)
    fits = fold_fits(rows, by, spec.intercept).withColumn(
        "_center", F.col("mean_xi") if spec.intercept else F.lit(0.0))
    return _statistics(rows, fits, spec, by, ["block_id"], lag, chunk_rows)


def full_statistics(resid: DataFrame, spec: Inference = Inference(), by=(), lag: int | Column | None = None,
                    chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """The same over all rows."""
    by = list(by)
    rows = complete(resid)
    places = [F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos")] if "pos" in rows.columns else []
    fits = rows.groupBy(*by).agg(*[c.alias(n) for n, c in _line(spec.intercept).items()], *places).withColumn(
        "_center", F.col("mean_xi") if spec.intercept else F.lit(0.0))
    return _statistics(rows, fits, spec, by, [], lag, chunk_rows)


def _statistics(rows, fits, spec, by, extra, lag, chunk_rows):
    n = F.col("n_obs")
    group = [*by, *extra]
    fits = fits.withColumn("_ok", (n > 1) & (F.col("var_xi") > 1e-10))
    robust = spec.hac and lag is not None
    if robust:
        width = F.greatest(lag if isinstance(lag, Column) else F.lit(int(lag)), F.lit(1))
        fits = pinned(fits.withColumn("bandwidth", clipped(spec.kernel, width, n)).withColumn("dof", F.lit(0)), group)
        line = fits.select(*group, *(["n_rows"] if by else []), "const", "coef", "_center", "first_pos")
        joined = attach(rows.select(*group, "pos", "chi", "xi"), line, by, extra, chunk_rows)
        scores = joined.select(*group, "pos", "first_pos", *(["n_rows"] if by else []), _slope_score().alias("score"))
        scores = _gapless(scores, fits, group, chunk_rows, -F.col("first_pos"))
        long_run = centred_lrv(scores, ["score"], fits, spec.kernel, group, chunk_rows).select(*group, "lrv_0_0")
        fits = beside(long_run, fits, group)
        fits = fits.withColumn("std_error", F.try_divide(F.sqrt(F.greatest(F.col("lrv_0_0"), F.lit(0.0)) * n), F.col("spread")))
    fits = fits.withColumn("df", n - (2 if spec.intercept else 1))
    t = F.abs(F.try_divide(F.col("coef"), F.col("std_error")))
    normal = robust and kernel_named(spec.kernel) == "bartlett"
    fits = fits.withColumn("_t", t).withColumn(
        "_p", normal_p_value(F.col("_t")) if normal else t_p_value(F.col("_t"), F.col("df"))).withColumn(
        "_crit", t_critical(spec.level, F.greatest(F.col("df"), F.lit(1))))
    ok = F.col("_ok")
    return fits.select(
        *group, F.when(ok, F.col("coef")).otherwise(0.0).alias("coefficient"),
        *[F.when(ok, c).alias(name) for name, c in (
            ("std_error", F.col("std_error")), ("t_statistic", F.col("_t")), ("p_value", F.col("_p")),
            ("ci_lower", F.col("coef") - F.col("_crit") * F.col("std_error")),
            ("ci_upper", F.col("coef") + F.col("_crit") * F.col("std_error")))],
        "n_obs", F.when(ok, F.col("df")).otherwise(0).alias("df"))
