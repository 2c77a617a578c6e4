"""Cross-fitted residuals of outcome (every lead) and policy.

Linear learners come from block sums (``operators.gram``): fold by fold the
training blocks are added up and solved, and a second scan of the design turns
coefficients into residuals.  Any ``pyspark.ml`` regressor works through
``crossfit_ml``, at the price of one training job per fold and equation.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldwise.operators.folds import check_folds, fold_table, neighbour, trains
from foldwise.operators.learners import merged, square, unshifted, weights
from foldwise.operators.storage import CHUNK_ROWS, attach, materialize
from foldwise.plans.spec import Learner

#: Up to this many products per row predictions are generated sums; beyond, they are matrix
#: products of batches for one series, and folds over an array of the features in a panel.
MAX_TERMS = 128


def lead_columns(design: DataFrame) -> list[str]:
    leads = [c for c in design.columns if c.startswith("lead") and c[4:].isdigit()]
    return sorted(leads, key=lambda c: int(c[4:]))


_PLANS: dict = {}


def fold_plan(spark, n_blocks: int, design: str = "rcf") -> list:
    """Per fold: block lists that train it, and the split that tunes it (K rows, no data)."""
    if (n_blocks, design) not in _PLANS:
        _PLANS[n_blocks, design] = _fold_plan(spark, n_blocks, design)
    return _PLANS[n_blocks, design]


def _fold_plan(spark, n_blocks: int, design: str) -> list:
    check_folds(n_blocks, design)
    blocks = F.sequence(F.lit(0), F.lit(n_blocks - 1))
    sides = fold_table(spark, n_blocks, design).withColumn(
        "blocks", F.filter(blocks, lambda b: trains(b, F.col("fold"), F.col("side"))))
    used = sides.where(F.size("blocks") > 0).groupBy("fold").agg(
        F.sort_array(F.collect_list("blocks")).alias("sides"),
        F.array_sort(F.flatten(F.collect_list("blocks"))).alias("union"))
    near = neighbour(F.col("fold"), n_blocks)
    if design == "nlo":  # the closest training block
        near = F.when(F.array_contains("union", F.col("fold") + 2), F.col("fold") + 2).otherwise(F.col("fold") - 2)
    return (used.withColumn("validate", near.cast("int"))
            .withColumn("train", F.filter("union", lambda b: b != F.col("validate")))
            .orderBy("fold").collect())


def fold_tasks(gram: DataFrame, plan, keys=(), equations=()) -> DataFrame:
    """Rows with all block sums of a series, and the ``folds`` (and ``equations``) a task is to solve.

    A panel has one row per key, so its sums travel once; a single series has one
    row per fold and equation, so that its work is spread.
    """
    keys = list(keys)
    blocks = F.sort_array(F.collect_list(F.struct("block_id", "g", "anchor")))
    per_key = gram.groupBy(*keys).agg(blocks.alias("_b"), F.first("n_rows").alias("n_rows"))
    folds, wanted = [F.lit(r["fold"]) for r in plan], [F.lit(e) for e in equations] or [F.lit("all")]
    split = F.array(*[F.struct(F.array(f).alias("folds"), F.array(e).alias("equations")) for f in folds for e in wanted])
    whole = F.array(F.struct(F.array(*folds).alias("folds"), F.array(*wanted).alias("equations")))
    return per_key.select(*keys, "n_rows", F.transform("_b", lambda b: b["block_id"]).alias("block_ids"),
                          F.transform("_b", lambda b: b["g"]).alias("grams"), F.transform("_b", lambda b: b["anchor"]).alias("anchors"),
                          F.explode(whole if keys else split).alias("_task")).select("*", "_task.folds", "_task.equations").drop("_task")


def spread(tasks: DataFrame) -> DataFrame:
    # Few bytes, much arithmetic: an even share per core instead of merged partitions.
    return tasks.repartition(max(tasks.sparkSession.sparkContext.defaultParallelism, 1))


def added(row, wanted, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The products of some blocks of a task about their common mean, and that mean."""
    return merged([(square(g, width), np.asarray(a)) for b, g, a in zip(row.block_ids, row.grams, row.anchors) if b in set(wanted)])


def learner_table(spark, n_blocks: int, outcome=Learner(), policy=Learner()) -> DataFrame:
    """``fold, equation, kind, penalty, l1_share`` from one learner, or one per fold."""
    rows = []
    for equation, given in (("outcome", outcome), ("policy", policy)):
        each = [given] * n_blocks if isinstance(given, Learner) else list(given)
        if len(each) != n_blocks:
            raise ValueError(f"{len(each)} {equation} learners for {n_blocks} folds")
        rows += [(k, equation, m.kind, float(m.penalty), float(m.l1_share)) for k, m in enumerate(each)]
    return spark.createDataFrame(rows, "fold int, equation string, kind string, penalty double, l1_share double")


def nuisance(gram: DataFrame, learners: DataFrame, n_features: int, horizons: int, n_blocks: int,
             design: str = "rcf", keys=()) -> DataFrame:
    """``keys, block_id, n_rows, policy_coef, outcome_coef`` (one array per lead).

    ``learners`` may carry the keys, and a column ``h`` for learners by horizon.
    The two sides of a central fold are averaged, which averages the residuals.
    """
    keys = list(keys)
    plan = fold_plan(gram.sparkSession, n_blocks, design)
    sides = {r["fold"]: [list(s) for s in r["sides"]] for r in plan}
    if "equation" not in learners.columns:
        raise KeyError("the learner table needs an equation column")
    h = F.col("h") if "h" in learners.columns else F.lit(-1)
    on = [k for k in keys if k in learners.columns]
    spec = F.struct("fold", "equation", h.cast("int").alias("h"), "kind", "penalty", "l1_share")
    tasks, shared = fold_tasks(gram, plan, keys), None
    if on:
        tasks = tasks.join(learners.groupBy(*on).agg(F.collect_list(spec).alias("specs")), on, "left")
    else:  # folds, equations and horizons: bounded by the parameters
        shared = [r["s"].asDict() for r in learners.select(spec.alias("s")).collect()]
    width, p = n_features + 2 + horizons + 1, n_features

    def solve(batches):
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                given = shared if shared is not None else (row.specs if row.specs is not None else [])
                own = {(s["fold"], s["equation"], s["h"]): s for s in given}
                for fold in row.folds:
                    samples = [added(row, s, width) for s in sides[fold]]
                    found = []
                    for target in range(p + 1, width):
                        lead = target - p - 2
                        name = ("policy", -1) if lead < 0 else ("outcome", lead)
                        spec = own.get((fold, *name)) or own.get((fold, name[0], -1))
                        if spec is None:
                            raise ValueError(f"no {name[0]} learner is left for fold {fold}, horizon {lead}: every candidate failed or none was given")
                        lines = [unshifted(weights(g, p, target, spec["kind"], spec["penalty"], spec["l1_share"], level), level, p, target)
                                 for g, level in samples]
                        found.append(np.mean(lines, axis=0))
                    out.append([*[getattr(row, k) for k in keys], fold, row.n_rows, found[0], found[1:]])
            yield pd.DataFrame(out, columns=[*keys, "block_id", "n_rows", "policy_coef", "outcome_coef"])

    types = {f.name: f.dataType.simpleString() for f in gram.schema.fields}
    schema = ", ".join([*[f"`{k}` {types[k]}" for k in keys], "block_id int", "n_rows bigint",
                        "policy_coef array<double>", "outcome_coef array<array<double>>"])
    return spread(tasks).mapInPandas(solve, schema)


def with_features(rows: DataFrame, features, equations: int) -> DataFrame:
    """Add the array ``_x`` that ``predicted`` folds over, where there are many products."""
    if len(features) * equations <= MAX_TERMS:
        return rows
    return rows.withColumn("_x", F.array(F.lit(1.0), *[F.col(c) for c in features]))


def predicted(features, coef: Column, equations: int) -> Column:
    if len(features) * equations <= MAX_TERMS:
        out = coef[0]
        for j, name in enumerate(features):
            out = out + coef[j + 1] * F.col(name)
        return out
    return F.aggregate(F.zip_with("_x", coef, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def _products(rows: DataFrame, coefs: DataFrame, features, leads, time_col: str) -> DataFrame:
    """Residuals of one series with many terms: a matrix product per batch and block inside the tasks.

    The coefficients (one matrix per fold, as large as the parameters) travel with the function.
    """
    lines = {r["block_id"]: np.column_stack([r["policy_coef"], *r["outcome_coef"]]) for r in coefs.select("block_id", "policy_coef", "outcome_coef").collect()}
    names, width = ["xi", *[f"chi{h}" for h in range(len(leads))]], len(features)
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    given = [time_col, "pos", "n_rows", "block_id"]

    def run(batches):
        for batch in batches:
            block = batch.column(3).to_numpy()
            x = batch.column(4).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            y = batch.column(5).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(names))
            left = np.empty_like(y)
            for k in np.unique(block):
                mine = block == k
                left[mine] = y[mine] - (x[mine] @ lines[k][1:] + lines[k][0])
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *[pa.array(left[:, j], mask=np.isnan(left[:, j])) for j in range(len(names))]], [*given, *names])

    arrays = rows.where(F.col("block_id").isin(list(lines))).select(*given, F.array(*[F.col(c).cast("double") for c in features]).alias("_x"),
                                                                   F.array(*[F.col(c).cast("double") for c in ("d", *leads)]).alias("_y"))
    return arrays.mapInArrow(run, ", ".join([*[f"`{c}` {types[c]}" for c in given], *[f"{c} double" for c in names]]))


def residuals(design: DataFrame, coefs: DataFrame, features, keys=(), time_col: str = "ts",
              chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``keys, time, pos, n_rows, block_id, xi, chi0..chiH``; rows outside the blocks are left out."""
    keys, leads = list(keys), lead_columns(design)
    if not keys and len(features) * (len(leads) + 1) > MAX_TERMS:
        return _products(design.where(F.col("block_id").isNotNull()), coefs, features, leads, time_col)
    rows = with_features(design.where(F.col("block_id").isNotNull()), features, len(leads) + 1)
    rows = attach(rows, coefs, keys, ["block_id"], chunk_rows)
    return rows.select(
        *keys, time_col, "pos", "n_rows", "block_id",
        (F.col("d") - predicted(features, F.col("policy_coef"), len(leads) + 1)).alias("xi"),
        *[(F.col(c) - predicted(features, F.col("outcome_coef")[h], len(leads) + 1)).alias(f"chi{h}") for h, c in enumerate(leads)])


def crossfit(design: DataFrame, gram: DataFrame, learners: DataFrame, features, n_blocks: int,
             fold_design: str = "rcf", keys=(), time_col: str = "ts", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Residuals of both equations, materialized.  The policy is fitted once for all leads."""
    horizons = len(lead_columns(design)) - 1
    coefs = materialize(nuisance(gram, learners, len(features), horizons, n_blocks, fold_design, keys))
    return materialize(residuals(design, coefs, features, keys, time_col, chunk_rows))


def by_horizon(resid: DataFrame, keys=(), time_col: str = "ts") -> DataFrame:
    """Long form: one row per position and horizon, columns ``h, chi, xi``."""
    chis = sorted([c for c in resid.columns if c.startswith("chi") and c[3:].isdigit()], key=lambda c: int(c[3:]))
    pairs = F.explode(F.array(*[F.struct(F.lit(int(c[3:])).alias("h"), F.col(c).alias("chi")) for c in chis]))
    return resid.select(*keys, time_col, "pos", "n_rows", "block_id", "xi", pairs.alias("_p")).select(
        *keys, time_col, "pos", "n_rows", "block_id", "_p.h", "_p.chi", "xi")


def crossfit_ml(design: DataFrame, features, outcome, policy, n_blocks: int, fold_design: str = "rcf",
                time_col: str = "ts", horizon: int = 0) -> DataFrame:
    """Residuals with ``pyspark.ml`` regressors (one each, or one per fold), single series."""
    from pyspark.ml.feature import VectorAssembler

    spark = design.sparkSession
    rows = materialize(VectorAssembler(inputCols=list(features), outputCol="features").transform(
        design.where(F.col("block_id").isNotNull())).select(
        time_col, "pos", "n_rows", "block_id", "features", "d", F.col(f"lead{horizon}").alias("y")))
    found = None
    for step in fold_plan(spark, n_blocks, fold_design):
        k, main = step["fold"], rows.where(F.col("block_id") == step["fold"])
        pieces = main
        for target, given in (("y", outcome), ("d", policy)):
            learner = given[k] if isinstance(given, (list, tuple)) else given
            learner = learner.copy({learner.labelCol: target, learner.featuresCol: "features",
                                    learner.predictionCol: f"_{target}_0"})
            names = []
            for i, side in enumerate(step["sides"]):
                names.append(f"_{target}_{i}")
                model = learner.copy({learner.predictionCol: names[-1]}).fit(rows.where(F.col("block_id").isin(list(side))))
                pieces = model.transform(pieces)
            total = sum((F.col(n) for n in names[1:]), F.col(names[0]))
            pieces = pieces.withColumn(f"_{target}_hat", total / len(names))
        part = pieces.select(time_col, "pos", "n_rows", "block_id", (F.col("d") - F.col("_d_hat")).alias("xi"),
                             (F.col("y") - F.col("_y_hat")).alias(f"chi{horizon}"))
        found = part if found is None else found.unionByName(part)
    return found
