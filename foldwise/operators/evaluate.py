"""Many fits at once: against a known effect, and over specifications."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwise.operators.stage2 import stage2_specs
from foldwise.operators.storage import CHUNK_ROWS
from foldwise.plans.spec import Inference


def evaluate(fits: DataFrame, truth: float | str, by=("design",)) -> DataFrame:
    """Bias, root mean squared error and coverage per group; ``truth`` is a number or a column."""
    true = F.col(truth) if isinstance(truth, str) else F.lit(float(truth))
    error = F.col("coef") - true
    covered = ((F.col("ci_lower") <= true) & (true <= F.col("ci_upper"))).cast("double")
    return fits.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_fits"),
        F.try_divide(100 * F.avg(error), F.avg(true)).alias("bias_pct"),
        F.try_divide(100 * F.abs(F.avg(error)), F.avg(true)).alias("abs_bias_pct"),
        F.sqrt(F.avg(error * error)).alias("rmse"), (100 * F.avg(covered)).alias("coverage_pct"))


def sweep(resid: DataFrame, specs: dict[str, Inference], by=(), chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """One row per named specification (and group); what they have in common is computed once."""
    names = F.create_map(*[F.lit(x) for name, spec in specs.items() for x in (name, spec.kernel)])
    rules = F.create_map(*[F.lit(x) for name, spec in specs.items() for x in (name, spec.rule)])
    return stage2_specs(resid, specs, by, chunk_rows).withColumn("kernel", names[F.col("spec")]).withColumn("rule", rules[F.col("spec")])
