"""Regression trees and boosted trees for both equations, all folds, leads and series.

A tree only needs counts and sums of the target by node, feature and bin.  Rows are
binned and packed once: a packed row holds the bin numbers (one byte each) and targets of
a run of rows of one series and block.  Every level of the trees is one scan of this
table.  In the first level the sums are per block, and the sample of a fold is the sum over
its blocks, so one histogram serves all folds, sides and candidates; from the second level on
folds have different nodes, and a row counts in the trees that its block trains.

What leaves a task is its partial histograms, whose size does not depend on the rows.  Splits are
chosen by windows over bins.  Trees travel back once per packed row, not per row.

Bins are of equal width between the least and the largest value of the feature in the
series; cut points thus do not look at targets.  Targets are centred on the series' mean, which
costs no digits and cancels in residuals.  Among splits whose gains agree to nine digits
the first feature and lowest bin wins.  A node without a split that leaves ``min_rows`` on
both sides is a leaf.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldwise.operators.crossfit import fold_plan, lead_columns
from foldwise.operators.storage import CHUNK_ROWS, attach, materialize
from foldwise.plans.spec import TreeLearner

#: Rows of a packed row at most.
PACK_ROWS = 4096
#: Numbers that the partial histograms of a task hold before it passes them on.
FLUSH_DOUBLES = 8_000_000
#: Rows of a batch that a task gives back, about.
BATCH_ROWS = 20_000
#: Gains this close, relative to the best, are ties.
TIE = 1e-9


@dataclass(frozen=True)
class Model:
    """One boosted tree: its number, target (0 is the policy, 1 the first lead), training blocks and parameters."""

    number: int
    target: int
    blocks: frozenset
    learner: TreeLearner


@dataclass(frozen=True)
class Binned:
    """Packed rows of a sample table and what is needed to read them."""

    rows: DataFrame
    sizes: DataFrame
    features: tuple[str, ...]
    leads: tuple[str, ...]
    keys: tuple[str, ...]
    time_col: str
    bins: int
    chunk_rows: int


def _code(k: int, x, bins: int):
    low, high = F.col("_low")[k], F.col("_high")[k]
    place = F.floor((x - low) / (high - low) * bins)
    return F.when(high > low, F.greatest(F.least(place, F.lit(bins - 1)), F.lit(0))).otherwise(0).cast("short")


def _pack(n_keys: int, width: int, targets: int, schema: pa.Schema):
    def run(batches):
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            new = np.zeros(n, dtype=bool)
            new[::PACK_ROWS] = True
            for k in range(n_keys + 1):
                seen = batch.column(k).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
                new[1:] |= seen[1:] != seen[:-1]
            first = np.flatnonzero(new)
            edges = np.append(first, n)
            codes = batch.column(n_keys + 4).flatten().to_numpy().astype(np.uint8).reshape(n, width)
            y = batch.column(n_keys + 5).flatten().to_numpy(zero_copy_only=False).reshape(n, targets)
            offsets, at = pa.array(edges.astype(np.int32)), pa.array(first)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(k).take(at) for k in range(n_keys + 2)], batch.column(n_keys + 2).take(at),
                 pa.ListArray.from_arrays(offsets, batch.column(n_keys + 2)), pa.ListArray.from_arrays(offsets, batch.column(n_keys + 3)),
                 pa.array([codes[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:])], type=pa.binary()),
                 pa.array([np.ascontiguousarray(y[a:b]).tobytes() for a, b in zip(edges[:-1], edges[1:])], type=pa.binary())],
                ["pos" if k == n_keys + 2 else name for k, name in enumerate(schema)])

    return run


def binned(design: DataFrame, features, keys=(), time_col: str = "ts", bins: int = 32, chunk_rows: int = CHUNK_ROWS) -> Binned:
    """Pack the rows of a sample table that belong to a block, with ``bins`` (at most 256) bins per feature."""
    if not 2 <= bins <= 256:
        raise ValueError(f"{bins} bins; they are numbered by one byte")
    keys, features, leads = list(keys), list(features), lead_columns(design)
    targets = ["d", *leads]
    inside = design.where(F.col("block_id").isNotNull())
    ranges = materialize(inside.groupBy(*keys).agg(
        F.max("n_rows").alias("n_rows"), F.array(*[F.min(c) for c in features]).alias("_low"), F.array(*[F.max(c) for c in features]).alias("_high"),
        F.array(*[F.avg(c) for c in targets]).alias("_level")))
    rows = attach(inside.select(*keys, "block_id", "n_rows", "pos", time_col, *features, *targets), ranges, keys, chunk_rows=chunk_rows)
    rows = rows.select(*keys, "block_id", "n_rows", "pos", time_col,
                       F.array(*[_code(k, F.col(c), bins) for k, c in enumerate(features)]).alias("_codes"),
                       F.array(*[F.col(c) - F.col("_level")[k] for k, c in enumerate(targets)]).alias("_targets"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    names = [*keys, "block_id", "n_rows", "pos", "positions", "times", "codes", "targets"]
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in [*keys, "block_id", "n_rows", "pos"]], "positions array<bigint>", f"times array<{kinds[time_col]}>",
                        "codes binary", "targets binary"])
    rows = rows.withColumn("pos", F.col("pos").cast("long"))
    packed = materialize(rows.sortWithinPartitions(*keys, "block_id", "pos").mapInArrow(_pack(len(keys), len(features), len(targets), names), schema))
    return Binned(packed, ranges.select(*keys, "n_rows"), tuple(features), tuple(leads), tuple(keys), time_col, bins, chunk_rows)


class _Trees:
    """The grown part of the trees of one series as arrays by model and round; a node's children are ``2 node`` and ``2 node + 1``."""

    def __init__(self, rows, models: dict[int, Model]):
        self.wanted = models
        self.rounds: dict = {}
        for r in rows:
            nodes = 2 << models[r["model"]].learner.depth
            feature, cut, value = self.rounds.setdefault((r["model"], r["round"]), (np.full(nodes, -1), np.zeros(nodes, dtype=np.int64), np.zeros(nodes)))
            feature[r["node"]], cut[r["node"]], value[r["node"]] = r["feature"], r["cut"], r["value"]

    def nodes(self, model: int, round_: int, codes: np.ndarray, depth: int) -> np.ndarray:
        node, row = np.ones(len(codes), dtype=np.int64), np.arange(len(codes))
        if (model, round_) in self.rounds:
            feature, cut, _ = self.rounds[model, round_]
            for _ in range(depth):
                on = feature[node]
                node = np.where(on >= 0, 2 * node + (codes[row, on] > cut[node]), node)
        return node

    def fitted(self, model: int, codes: np.ndarray, rounds: int) -> np.ndarray:
        total, depth = np.zeros(len(codes)), self.wanted[model].learner.depth
        for k in range(rounds):
            if (model, k) in self.rounds:
                total += self.rounds[model, k][2][self.nodes(model, k, codes, depth)]
        return total


def _scan(data: Binned, models: list[Model], trees: DataFrame | None, body, out: str, chosen: DataFrame | None = None) -> DataFrame:
    """``body(key, block, codes, targets, trees, batch, row)`` for every packed row; it may give batches at once or, when called without row, at the end.

    ``trees`` come with every packed row of a panel, and in the task's closure for a single
    series.  ``chosen(keys, model)`` says which models a series has; else it has all.
    """
    keys, by_number = list(data.keys), {m.number: m for m in models}
    rows, shared = data.rows, None
    if keys:
        per_key = data.sizes
        node = F.struct("model", "round", "node", "feature", "cut", "value")
        if trees is not None:
            per_key = per_key.join(trees.groupBy(*keys).agg(F.collect_list(node).alias("_trees")), keys, "left")
        if chosen is not None:
            per_key = per_key.join(chosen.groupBy(*keys).agg(F.collect_set("model").alias("_models")), keys, "left")
        rows = attach(rows, per_key, keys, chunk_rows=data.chunk_rows)
    else:  # as many nodes as the parameters allow
        wanted = by_number if chosen is None else {r["model"]: by_number[r["model"]] for r in chosen.select("model").distinct().collect()}
        shared = _Trees([] if trees is None else [r.asDict() for r in trees.drop(*keys).collect()], wanted)
    names = {c: k for k, c in enumerate(rows.columns)}
    width, n_targets, n_keys = len(data.features), 1 + len(data.leads), len(keys)

    def run(batches):
        state, last = body(), (None, None)
        for batch in batches:
            for k in range(batch.num_rows):
                key = tuple(batch.column(i)[k].as_py() for i in range(n_keys))
                if shared is None and last[0] != key:
                    mine = by_number
                    if "_models" in names:
                        ids = batch.column(names["_models"])[k].as_py() or []
                        mine = {m: by_number[m] for m in ids}
                    given = (batch.column(names["_trees"])[k].as_py() or []) if "_trees" in names else []
                    last = key, _Trees([r for r in given if r["model"] in mine], mine)
                codes = np.frombuffer(batch.column(names["codes"])[k].as_buffer(), dtype=np.uint8).reshape(-1, width)
                y = np.frombuffer(batch.column(names["targets"])[k].as_buffer(), dtype=np.float64).reshape(-1, n_targets)
                yield from state.take(key, batch.column(names["block_id"])[k].as_py(), codes, y, shared or last[1],
                                      lambda c, b=batch, r=k: b.column(names[c])[r])
        yield from state.rest()

    return rows.mapInArrow(lambda batches: _merged(run(batches)), out)


def _merged(batches):
    """The same rows in batches of about ``BATCH_ROWS``; a short series alone gives a few rows."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= BATCH_ROWS:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


class _Sums:
    """Partial sums (of one shape) of a task by a key tuple, passed on as flat rows when they are many; ``flat`` gets many keys at a time."""

    def __init__(self, schema: pa.Schema, flat):
        self.schema, self.flat, self.held, self.size = schema, flat, {}, 0

    def add(self, at: tuple, values: np.ndarray):
        if at in self.held:
            self.held[at] += values
        else:
            self.held[at] = values
            self.size += values.size
        if self.size > FLUSH_DOUBLES:
            yield from self.rest()

    def rest(self):
        if self.held:
            ids, values = list(zip(*self.held)), np.stack(list(self.held.values()))
            for lo in range(0, len(values), step := max(1, BATCH_ROWS * 2 // values[0].size)):
                part = slice(lo, lo + step)
                columns = self.flat([pa.array(x[part], type=f.type) for x, f in zip(ids, self.schema)], values[part])
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) if not isinstance(c, pa.Array) else c for c, f in zip(columns, self.schema)], schema=self.schema)
        self.held, self.size = {}, 0


def _histogram(codes: np.ndarray, nodes: np.ndarray, y: np.ndarray, n_nodes: int, bins: int) -> np.ndarray:
    """Counts and sums of ``y`` by node (negative ones do not count), feature and bin."""
    width = codes.shape[1]
    inside = nodes >= 0
    if not inside.all():
        codes, nodes, y = codes[inside], nodes[inside], y[inside]
    at = ((nodes[:, None] * width + np.arange(width)) * bins + codes).ravel()
    shape, size = (n_nodes, width, bins), n_nodes * width * bins
    return np.stack([np.bincount(at, minlength=size).reshape(shape), np.bincount(at, np.repeat(y, width), size).reshape(shape)]).astype(float)


def _level_sums(data: Binned, models: list[Model], trees, round_: int, level: int, chosen) -> DataFrame:
    """``keys, model, node, feature, bin, n, s`` for the nodes of one level."""
    keys, bins = data.keys, data.bins
    types = {f.name: f.dataType.simpleString() for f in data.rows.schema.fields}
    first = round_ == 0 and level == 0
    own = "block_id int, target int" if first else "model int"
    out = ", ".join([*[f"`{k}` {types[k]}" for k in keys], own, "node int, feature int, bin int, n double, s double"])
    arrow = data.rows.sparkSession.createDataFrame([], out).toArrow().schema

    def flat(ids, values):
        at, node, feature, bin_ = np.nonzero(values[:, 0])
        ids = [x.take(pa.array(at)) for x in ids]
        return [*ids, (node + (1 << level)).astype(np.int32), feature.astype(np.int32), bin_.astype(np.int32), values[at, 0, node, feature, bin_], values[at, 1, node, feature, bin_]]

    class Body:
        def __init__(self):
            self.sums = _Sums(arrow, flat)

        def take(self, key, block, codes, y, trees, _):
            if first:
                zero = np.zeros(len(codes), dtype=np.int64)
                for target in sorted({m.target for m in trees.wanted.values()}):
                    yield from self.sums.add((*key, block, target), _histogram(codes, zero, y[:, target], 1, bins))
                return
            for number, m in trees.wanted.items():
                if block in m.blocks and round_ < m.learner.rounds and level < m.learner.depth:
                    left = y[:, m.target] - trees.fitted(number, codes, round_)
                    nodes = trees.nodes(number, round_, codes, level) - (1 << level)
                    yield from self.sums.add((*key, number), _histogram(codes, nodes, left, 1 << level, bins))

        def rest(self):
            yield from self.sums.rest()

    sums = _scan(data, models, trees, Body, out, chosen)
    if first:  # the sample of a fold is the sum over its blocks
        spark = data.rows.sparkSession
        uses = spark.createDataFrame([(m.number, m.target, b) for m in models for b in sorted(m.blocks)], "model int, target int, block_id int")
        sums = sums.groupBy(*keys, "block_id", "target", "node", "feature", "bin").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
        sums = sums.join(F.broadcast(uses), ["target", "block_id"])  # as many rows as models times blocks
        if chosen is not None:
            sums = sums.join(chosen.select(*keys, "model").distinct(), [*keys, "model"], "left_semi")
    return sums.groupBy(*keys, "model", "node", "feature", "bin").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))


def best_splits(sums: DataFrame, limits: DataFrame, keys=()) -> DataFrame:
    """``keys, model, node, n, s`` of every node and its best split ``feature, cut, n_left, s_left`` (NULL if there is none).

    ``limits(model, min_rows)`` is small.  Values in bins up to ``cut`` go to the left.
    """
    node = [*keys, "model", "node"]
    bins = Window.partitionBy(*node, "feature").orderBy("bin")
    each = Window.partitionBy(*node, "feature")
    runs = sums.join(F.broadcast(limits), "model").withColumns({
        "n_left": F.sum("n").over(bins), "s_left": F.sum("s").over(bins), "_n": F.sum("n").over(each), "_s": F.sum("s").over(each)})
    n_right, s_right = F.col("_n") - F.col("n_left"), F.col("_s") - F.col("s_left")
    parts = F.col("s_left") ** 2 / F.col("n_left") + s_right ** 2 / n_right
    room = (F.col("n_left") >= F.col("min_rows")) & (n_right >= F.col("min_rows")) & (n_right > 0)
    tried = runs.where(room).withColumn("_gain", parts - F.col("_s") ** 2 / F.col("_n")).where(F.col("_gain") > TIE * parts)
    tried = tried.withColumn("_most", F.max("_gain").over(Window.partitionBy(*node)))
    best = tried.where(F.col("_gain") >= F.col("_most") * (1 - TIE)).groupBy(*node).agg(
        F.min(F.struct("feature", F.col("bin").alias("cut"), "n_left", "s_left")).alias("_b"))
    whole = sums.where("feature = 0").groupBy(*node).agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    return whole.join(best, node, "left").select(*node, "n", "s", "_b.feature", "_b.cut", "_b.n_left", "_b.s_left")


def grow(data: Binned, models: list[Model], chosen: DataFrame | None = None) -> DataFrame:
    """The nodes of all trees: ``keys, model, round, node, feature, cut, value``; a leaf has feature -1 and adds ``value``.

    One scan per round and level, whatever the number of models and series.
    """
    keys, spark = list(data.keys), data.rows.sparkSession
    facts = spark.createDataFrame([(m.number, m.learner.min_rows) for m in models], "model int, min_rows int")
    shape = spark.createDataFrame([(m.number, m.learner.depth, float(m.learner.rate)) for m in models], "model int, depth int, rate double")
    trees = None
    for round_ in range(max(m.learner.rounds for m in models)):
        for level in range(max(m.learner.depth for m in models if m.learner.rounds > round_)):
            sums = materialize(_level_sums(data, models, trees, round_, level, chosen))
            found = best_splits(sums, facts, keys).join(F.broadcast(shape), "model").withColumn("round", F.lit(round_))
            leaf = lambda node, n, s: F.struct(node.cast("int").alias("node"), F.lit(-1).alias("feature"), F.lit(0).alias("cut"), (F.col("rate") * s / n).alias("value"))
            split = F.struct(F.col("node"), F.col("feature"), F.col("cut"), F.lit(0.0).alias("value"))
            n, s, left, s_left = (F.col(c) for c in ("n", "s", "n_left", "s_left"))
            last = F.array(split, leaf(2 * F.col("node"), left, s_left), leaf(2 * F.col("node") + 1, n - left, s - s_left))
            rows = F.when(F.col("feature").isNull(), F.array(leaf(F.col("node"), n, s))).when(F.col("depth") == level + 1, last).otherwise(F.array(split))
            new = found.select(*keys, "model", "round", F.explode(rows).alias("_r")).select(*keys, "model", "round", "_r.*")
            trees = materialize(new if trees is None else trees.unionByName(new))
    return trees


def _fold_models(spark, n_blocks: int, fold_design: str, outcome, policy, horizons: int):
    """Models of every fold, side and target, and which of them predict a fold's target."""
    models, use = [], {}
    for step in fold_plan(spark, n_blocks, fold_design):
        k = step["fold"]
        for target in range(horizons + 2):
            given = policy if target == 0 else outcome
            learner = given[k] if isinstance(given, (list, tuple)) else given
            for side in step["sides"]:
                use.setdefault((k, target), []).append(len(models))
                models.append(Model(len(models), target, frozenset(side), learner))
    return models, use


def _residuals(data: Binned, models, trees, use, chosen=None) -> DataFrame:
    types = {f.name: f.dataType for f in data.rows.schema.fields}
    keys, n_targets = data.keys, 1 + len(data.leads)
    names = ["xi", *[f"chi{h}" for h in range(n_targets - 1)]]
    out = ", ".join([*[f"`{k}` {types[k].simpleString()}" for k in keys], f"`{data.time_col}` {types['times'].elementType.simpleString()}",
                     "pos bigint, n_rows bigint, block_id int", *[f"{c} double" for c in names]])
    arrow = data.rows.sparkSession.createDataFrame([], out).toArrow().schema

    class Body:
        def take(self, key, block, codes, y, trees, column):
            n = len(codes)
            same = lambda x, f: pa.array([x], type=f.type).take(pa.array(np.zeros(n, dtype=np.int64)))
            columns = [same(x, f) for x, f in zip(key, arrow)]
            columns += [column("times").values, column("positions").values, same(column("n_rows").as_py(), arrow.field("n_rows")), same(block, arrow.field("block_id"))]
            for target in range(n_targets):
                mine = [m for m in use[block, target] if m in trees.wanted]
                if not mine:
                    raise ValueError(f"no learner is left for fold {block}, target {target}: every candidate failed or none was given")
                fits = [trees.fitted(m, codes, trees.wanted[m].learner.rounds) for m in mine]
                columns.append(pa.array(y[:, target] - np.mean(fits, axis=0)))
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

        def rest(self):
            return iter(())

    return _scan(data, models, trees, Body, out, chosen)


def crossfit_trees(data: Binned, outcome: TreeLearner | list = TreeLearner(), policy: TreeLearner | list = TreeLearner(), n_blocks: int = 6,
                   fold_design: str = "rcf") -> DataFrame:
    """Residuals of both equations like ``crossfit``: every lead, every series; learners are one each, or one per fold.

    The two sides of a central fold are averaged.
    """
    models, use = _fold_models(data.rows.sparkSession, n_blocks, fold_design, outcome, policy, len(data.leads) - 1)
    return materialize(_residuals(data, models, grow(data, models), use))


def tree_profile(data: Binned, outcome_grid, policy_grid, n_blocks: int = 6, fold_design: str = "rcf") -> DataFrame:
    """Validation error of every candidate, as ``tuning.error_profile`` gives it: ``keys, fold, equation, grid_idx, kind, depth, rounds, rate, min_rows, rmse, n_train, n_val, n_rows``.

    All candidates of both equations and all folds grow in the same scans.
    """
    spark, keys = data.rows.sparkSession, list(data.keys)
    models, named = [], []
    validates: dict[int, list] = {}
    for step in fold_plan(spark, n_blocks, fold_design):
        if not step["train"]:
            raise ValueError(f"fold {step['fold']}: no training rows are left beside the validation block")
        for equation, target, grid in (("outcome", 1, outcome_grid), ("policy", 0, policy_grid)):
            for i, learner in enumerate(grid):
                m = Model(len(models), target, frozenset(step["train"]), learner)
                named.append((m.number, step["fold"], equation, i, "tree", learner.depth, learner.rounds, float(learner.rate), learner.min_rows))
                validates.setdefault(step["validate"], []).append(m.number)
                models.append(m)
    types = {f.name: f.dataType.simpleString() for f in data.rows.schema.fields}
    out = ", ".join([*[f"`{k}` {types[k]}" for k in keys], "model int, n_train double, n_val double, sse double"])
    arrow = spark.createDataFrame([], out).toArrow().schema

    class Body:
        def __init__(self):
            self.sums = _Sums(arrow, lambda ids, v: [*ids, v[:, 0], v[:, 1], v[:, 2]])

        def take(self, key, block, codes, y, trees, _):
            for number in validates.get(block, []):
                m = trees.wanted[number]
                miss = y[:, m.target] - trees.fitted(number, codes, m.learner.rounds)
                yield from self.sums.add((*key, number), np.array([0.0, len(miss), miss @ miss]))
            for number, m in trees.wanted.items():
                if block in m.blocks:
                    yield from self.sums.add((*key, number), np.array([float(len(codes)), 0.0, 0.0]))

        def rest(self):
            yield from self.sums.rest()

    sums = _scan(data, models, grow(data, models), Body, out).groupBy(*keys, "model").agg(*[F.sum(c).alias(c) for c in ("n_train", "n_val", "sse")])
    names = spark.createDataFrame(named, "model int, fold int, equation string, grid_idx int, kind string, depth int, rounds int, rate double, min_rows int")
    rows = sums.join(F.broadcast(names), "model")  # one row per candidate and fold
    rows = rows.join(data.sizes, keys) if keys else rows.withColumn("n_rows", F.lit(data.sizes.first()["n_rows"]))
    return rows.select(*keys, "fold", "equation", "grid_idx", "kind", "depth", "rounds", "rate", "min_rows", F.sqrt(F.col("sse") / F.col("n_val")).alias("rmse"),
                       F.col("n_train").cast("long").alias("n_train"), F.col("n_val").cast("long").alias("n_val"), "n_rows")


def crossfit_tuned_trees(data: Binned, tuned: DataFrame, n_blocks: int = 6, fold_design: str = "rcf") -> DataFrame:
    """Residuals with the candidates of ``tuned`` (``select_candidates`` of a ``tree_profile``), which may differ by series, fold and equation."""
    spark, keys = data.rows.sparkSession, list(data.keys)
    given = ["equation", "fold", "depth", "rounds", "rate", "min_rows"]
    models, use, rows = [], {}, []
    sides = {s["fold"]: [frozenset(b) for b in s["sides"]] for s in fold_plan(spark, n_blocks, fold_design)}
    for r in tuned.select(*given).distinct().orderBy(*given).collect():  # at most candidates times folds
        learner = TreeLearner(r["depth"], r["rounds"], r["rate"], r["min_rows"])
        for target in ([0] if r["equation"] == "policy" else range(1, 1 + len(data.leads))):
            for side in sides[r["fold"]]:
                use.setdefault((r["fold"], target), []).append(len(models))
                rows.append((*[r[c] for c in given], len(models)))
                models.append(Model(len(models), target, side, learner))
    names = spark.createDataFrame(rows, "equation string, fold int, depth int, rounds int, rate double, min_rows int, model int")
    chosen = materialize(tuned.select(*keys, *given).join(F.broadcast(names), given).select(*keys, "model"))
    return materialize(_residuals(data, models, grow(data, models, chosen), use, chosen))
