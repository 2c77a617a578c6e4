"""Queries on reading, transforming, ordering and folding series."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from foldwise.functions.transforms import TRANSFORM_CODES
from foldwise.operators.design import build_design, feature_names, sample_status, scaled, speeds, transform_all
from foldwise.operators.folds import fold_membership, measured_sample_use, sample_use_closed
from foldwise.operators.gram import block_gram
from foldwise.operators.learners import square
from foldwise.operators.position import add_position, calendar_gaps, with_blocks
from foldwise.operators.storage import shared_folder
from foldwise.operators.trend import trend_ratio
from foldwise.plans.spec import Design
from foldwise.sources.frames import from_dataframe
from foldwise.sources.metadata_csv import read_metadata_wide, wide_with_metadata
from workload import series, sql
from workload.registry import day, query, rnd

WEEKLY_CODES = {"revenue": 5, "avg_disc": 2, "n_lines": 5, "avg_tax": 1}
WEEKLY_SPEEDS = {"revenue": "slow", "avg_disc": "slow", "n_lines": "fast", "avg_tax": "fast"}


@query("read_metadata_wide", f"""WITH w AS ({sql.sales()}), t AS (
  SELECT ts, unnest(['revenue', 'avg_disc', 'n_lines', 'avg_tax']) AS series, unnest(['slow', 'slow', 'fast', 'fast']) AS speed,
    unnest([5, 2, 5, 1])::INT AS tcode, unnest([revenue, avg_disc, n_lines, avg_tax]) AS value FROM w)
  SELECT {sql.DAY}, series, speed, tcode, CASE WHEN series LIKE 'avg%' THEN round(value, 10) ELSE round(value, 4) END AS value FROM t""")
def read_wide(spark, sf_dir):
    weekly = series.sales(spark, sf_dir)
    path = f"{shared_folder(spark)}/wide-{uuid.uuid4().hex}"
    wide_with_metadata(weekly, WEEKLY_SPEEDS, WEEKLY_CODES).write.csv(path, header=True)
    meta, obs = read_metadata_wide(spark, path)
    tall = obs.unpivot(["ts"], list(WEEKLY_SPEEDS), "series", "value")
    return tall.join(F.broadcast(meta), "series").select(
        day(), "series", "speed", "tcode",
        F.when(F.col("series").like("avg%"), F.round("value", 10)).otherwise(F.round("value", 4)).alias("value"))


_DIRTY = "CASE WHEN n_lines % 7 = 3 THEN NULL ELSE round({c}, 4) END"


@query("read_metadata_dirty", f"""WITH w AS ({sql.sales()}) SELECT {sql.DAY}, {_DIRTY.format(c='revenue')} AS revenue, round(qty, 4) AS "qty_total" FROM w""")
def read_dirty(spark, sf_dir):
    """Cells that are no numbers become NULL; a header may hold dots; every file repeats the two describing rows."""
    weekly = series.sales(spark, sf_dir)
    path = f"{shared_folder(spark)}/wide-{uuid.uuid4().hex}"
    text = wide_with_metadata(weekly.select("ts", "revenue", "qty", "n_lines"), {"revenue": "slow", "qty": "fast"}, {"revenue": 5, "qty": 1})
    bad = weekly.where("n_lines % 7 = 3").select(F.date_format("ts", "yyyy-MM-dd").alias("ts"), F.lit("n/a").alias("_bad"))
    joined = text.join(bad, "ts", "left").select("ts", F.coalesce("_bad", "revenue").alias("revenue"), F.col("qty").alias("qty.total"))
    labels = joined.where("ts in ('speed', 'Transform:')")
    for part in (joined.where("ts < '1995'").unionByName(labels), joined.where("ts >= '1995' or ts is null").unionByName(labels)):
        part.distinct().write.mode("append").csv(path, header=True)
    _, obs = read_metadata_wide(spark, path)
    return obs.select(day(), F.round("revenue", 4).alias("revenue"), F.round("`qty.total`", 4).alias("qty_total"))


@query("event_positions", f"""WITH p AS ({sql.blocked(sql.numbered(sql.EVENTS, 'event_id'), 7)})
  SELECT event_id, value, k, pos, n_rows, block_id FROM p""")
def event_positions(spark, sf_dir):
    events = series.events_long(spark, sf_dir)
    return from_dataframe(events, "event_id", "value", "k", ["click"], n_blocks=7).select(
        "event_id", "value", "k", "pos", "n_rows", "block_id")


@query("user_event_positions", f"SELECT user_id, event_id, pos, n_rows FROM ({sql.numbered(sql.EVENTS, 'event_id', 'user_id')})")
def user_event_positions(spark, sf_dir):
    events = series.events_long(spark, sf_dir)
    return from_dataframe(events, "event_id", "value", "k", [], ["user_id"]).select("user_id", "event_id", "pos", "n_rows")


def _code_sql(x: str, key: str = "") -> str:
    w = f"OVER ({key}ORDER BY pos)"
    ln = f"CASE WHEN {x} > 0 THEN ln({x}) END"
    lag = lambda e, k: f"lag({e}, {k}) {w}"
    growth = lambda k: f"100 * (({x} - {lag(x, k)}) / nullif({lag(x, k)}, 0))"
    codes = {1: x, 2: f"{x} - {lag(x, 1)}", 3: f"{x} - 2 * {lag(x, 1)} + {lag(x, 2)}", 4: ln, 5: f"100 * ({ln} - {lag(ln, 1)})",
             6: f"{ln} - 2 * {lag(ln, 1)} + {lag(ln, 2)}", 7: growth(1), 8: f"{ln} - {lag(ln, 12)}", 81: f"{ln} - {lag(ln, 4)}",
             10: f"{x} - {lag(x, 12)}", 101: f"{x} - {lag(x, 4)}", 11: growth(12), 111: growth(4)}
    return ", ".join(f"round({e}, 5) AS {x}_{c}" for c, e in codes.items())


PLAIN_CODES = [c for c in TRANSFORM_CODES if c != 9]


def _all_codes(df, name, time_col, keys=()):
    placed = add_position(df, time_col, keys)
    copies = placed.select("*", *[F.col(name).alias(f"_{c}") for c in PLAIN_CODES])
    done = transform_all(copies, {f"_{c}": c for c in PLAIN_CODES}, time_col, keys)
    return done, [F.round(f"_{c}_{c}", 5).alias(f"{name}_{c}") for c in PLAIN_CODES]


@query("transform_codes_weekly", f"""WITH p AS ({sql.numbered(sql.sales(), 'ts')})
  SELECT {sql.DAY}, {_code_sql('revenue')} FROM p""")
def transform_codes_weekly(spark, sf_dir):
    done, cols = _all_codes(series.sales(spark, sf_dir).select("ts", "revenue"), "revenue", "ts")
    return done.select(day(), *cols)


@query("transform_codes_events", f"""WITH p AS ({sql.numbered(sql.EVENTS, 'event_id')})
  SELECT event_id, {_code_sql('k')} FROM p""")
def transform_codes_events(spark, sf_dir):
    done, cols = _all_codes(series.events_long(spark, sf_dir).select("event_id", "k"), "k", "event_id")
    return done.select("event_id", *cols)


@query("transform_codes_users", f"""WITH p AS ({sql.numbered(sql.EVENTS, 'event_id', 'user_id')})
  SELECT user_id, event_id, {_code_sql('value', 'PARTITION BY user_id ')} FROM p""")
def transform_codes_users(spark, sf_dir):
    events = series.events_long(spark, sf_dir).select("user_id", "event_id", "value")
    done, cols = _all_codes(events, "value", "event_id", ["user_id"])
    return done.select("user_id", "event_id", *cols)


# Forward elimination and back substitution of the five-diagonal trend system, row by row.
_TREND_SQL = f"""WITH RECURSIVE p AS ({sql.numbered(sql.sales(), 'ts')}),
  m AS (SELECT pos, n_rows AS n, revenue AS x,
    1 + 14400.0::DOUBLE * CASE WHEN pos IN (0, n_rows - 1) THEN 1 WHEN pos IN (1, n_rows - 2) THEN 5 ELSE 6 END AS d0,
    14400.0::DOUBLE * CASE WHEN pos IN (0, n_rows - 2) THEN -2 WHEN pos < n_rows - 1 THEN -4 ELSE 0 END AS u1,
    CASE WHEN pos < n_rows - 2 THEN 14400.0::DOUBLE ELSE 0 END AS u2 FROM p),
  fwd(pos, d, e, f, z, d1, e1, f1, z1) AS (
    SELECT pos, d0, u1 / d0, u2 / d0, x, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE FROM m WHERE pos = 0
    UNION ALL
    SELECT pos, d, (u1 - pe * pf * pd) / d, u2 / d, z, pd, pe, pf, pz FROM (
      SELECT m.pos, m.u1, m.u2, g.d AS pd, g.e AS pe, g.f AS pf, g.z AS pz,
        m.d0 - g.e * g.e * g.d - g.f1 * g.f1 * g.d1 AS d, m.x - g.e * g.z - g.f1 * g.z1 AS z
      FROM fwd g JOIN m ON m.pos = g.pos + 1)),
  bwd(pos, t, t1) AS (
    SELECT fwd.pos, z / d, 0.0::DOUBLE FROM fwd WHERE fwd.pos = (SELECT max(n) - 1 FROM m)
    UNION ALL
    SELECT g.pos, g.z / g.d - g.e * b.t - g.f * b.t1, b.t FROM bwd b JOIN fwd g ON g.pos = b.pos - 1)
  SELECT strftime(p.ts, '%Y-%m-%d %H:%M') AS ts, round(p.revenue / b.t, 6) AS revenue_9 FROM p JOIN bwd b USING (pos)"""


@query("trend_ratio_weekly", _TREND_SQL)
def trend_ratio_weekly(spark, sf_dir):
    placed = add_position(series.sales(spark, sf_dir).select("ts", "revenue"), "ts")
    return transform_all(placed, {"revenue": 9}, "ts").select(day(), rnd("revenue_9"))


@query("trend_ratio_events")
def trend_ratio_events(spark, sf_dir):
    placed = add_position(series.events_long(spark, sf_dir).select("event_id", "k"), "event_id")
    return trend_ratio(placed, "k", "k_9").select("pos", rnd("k_9"))


def _design_sql(source: str, codes: dict, y: str, d: str, fast, lags: int, horizons: int, k: int, where: str = "true",
                remove=(), key: str = "", scale: str | None = None, exact: bool = False) -> str:
    part, lead = (f"PARTITION BY {key} ", f"{key}, ") if key else ("", "")
    w = f"OVER ({part}ORDER BY ts)"

    def code(n, c):
        return {1: n, 2: f"{n} - lag({n}) {w}", 5: f"100 * (ln({n}) - lag(ln({n})) {w})"}[c]

    names = {n: f"{n}_{c}" for n, c in codes.items()}
    kept = [names[n] for n in codes if n not in remove]
    lagged = [f"lag({c}, {i}) {w} AS lag{i}_{c}" for i in range(1, lags + 1) for c in kept]
    leads = [f"{names[y]} AS lead0", *[f"lead({names[y]}, {h}) {w} AS lead{h}" for h in range(1, horizons + 1)]]
    same = [names[n] for n in fast if n not in (y, d) and n not in remove]
    cols = ["cons", *same, *[f"lag{i}_{c}" for i in range(1, lags + 1) for c in kept], *[f"lead{h}" for h in range(horizons + 1)]]
    if scale:
        cols = [scale.format(c=c) + f" AS {c}" if c.startswith("lag") or c in same else c for c in cols]
    values = ["y", "d", *[c.split(" AS ")[-1] for c in cols]]
    out = ", ".join(values if exact else [f"round({c}, 6) AS {c}" for c in values])
    return f"""WITH raw AS ({source}),
      t AS (SELECT {lead}ts, {', '.join(f'{code(n, c)} AS {names[n]}' for n, c in codes.items())} FROM raw),
      c AS (SELECT * FROM t WHERE {' AND '.join(f'{n} IS NOT NULL' for n in names.values())}),
      l AS (SELECT {lead}ts, row_number() {w} - 1 AS p2, count(*) OVER ({part}) AS n2, {names[y]} AS y, {names[d]} AS d, 1.0::DOUBLE AS cons,
        {', '.join([*same, *lagged, *leads])} FROM c),
      sc AS (SELECT {lead}ts, p2, n2, y, d, {', '.join(cols)} FROM l),
      f AS (SELECT *, row_number() {w} - 1 AS pos, count(*) OVER ({part}) AS n FROM sc
        WHERE p2 >= {lags} AND p2 < n2 - {horizons} AND {where}),
      g AS (SELECT * EXCLUDE (n), n - n % {k} AS n_rows FROM f WHERE n - n % {k} >= {2 * k})
      SELECT {lead}{sql.DAY}, pos, n_rows, (pos // (n_rows // {k}))::INT AS block_id, {out} FROM g WHERE pos < n_rows"""


def _design_out(design, features, horizons, keys=()):
    values = ["y", "d", *features, *[f"lead{h}" for h in range(horizons + 1)]]
    return design.select(*keys, day(), "pos", "n_rows", "block_id", *[rnd(c) for c in values])


@query("design_weekly", _design_sql(sql.sales(), WEEKLY_CODES, "revenue", "avg_disc", ["n_lines", "avg_tax"], 2, 3, 6))
def design_weekly(spark, sf_dir):
    spec = Design("ts", "revenue", "avg_disc", WEEKLY_CODES, fast=("n_lines", "avg_tax"), lags=2, horizons=3)
    return _design_out(build_design(series.sales(spark, sf_dir), spec), feature_names(spec), 3)


@query("design_daily_dates", _design_sql(
    sql.sales("day"), WEEKLY_CODES, "revenue", "avg_disc", ["n_lines", "avg_disc"], 1, 1, 5,
    "ts >= TIMESTAMP '1996-02-01' AND ts <= TIMESTAMP '2001-06-30'", remove=("avg_tax",)))
def design_daily_dates(spark, sf_dir):
    """Date range, a removed series, and a slow one that moves to the same period."""
    speed = {"revenue": "slow", "avg_disc": "slow", "n_lines": "fast", "avg_tax": "fast"}
    _, fast = speeds(speed, remove=("avg_tax",))
    spec = Design("ts", "revenue", "avg_disc", WEEKLY_CODES, fast=tuple(fast), lags=1, horizons=1, n_blocks=5,
                  start="1996-02-01", end="2001-06-30", to_fast=("avg_disc",), remove=("avg_tax",))
    return _design_out(build_design(series.sales(spark, sf_dir, "day"), spec), feature_names(spec), 1)


@query("design_same_outcome_policy", _design_sql(sql.sales(), {"revenue": 5, "qty": 5}, "revenue", "revenue", ["qty"], 1, 0, 4))
def design_same(spark, sf_dir):
    spec = Design("ts", "revenue", "revenue", {"revenue": 5, "qty": 5}, fast=("qty",), lags=1, n_blocks=4)
    return _design_out(build_design(series.sales(spark, sf_dir), spec), feature_names(spec), 0)


@query("design_priority_panel", _design_sql(
    sql.orders("o_orderpriority"), {"n": 5, "total": 5}, "total", "n", [], 1, 2, 4, key="o_orderpriority"))
def design_panel(spark, sf_dir):
    spec = Design("ts", "total", "n", {"n": 5, "total": 5}, keys=("o_orderpriority",), lags=1, horizons=2, n_blocks=4)
    design = build_design(series.orders_by(spark, sf_dir, ["o_orderpriority"]), spec)
    return _design_out(design, feature_names(spec), 2, ["o_orderpriority"])


@query("design_scaled_weekly", _design_sql(
    sql.sales(), WEEKLY_CODES, "revenue", "avg_disc", ["n_lines", "avg_tax"], 1, 1, 6,
    scale="({c} - median({c}) OVER ()) / (quantile_cont({c}, 0.75) OVER () - quantile_cont({c}, 0.25) OVER ())"))
def design_scaled(spark, sf_dir):
    spec = Design("ts", "revenue", "avg_disc", WEEKLY_CODES, fast=("n_lines", "avg_tax"), lags=1, horizons=1, scaling="robust")
    return _design_out(build_design(series.sales(spark, sf_dir), spec), feature_names(spec), 1)


@query("sample_status_users", """WITH u AS (SELECT user_id, count(DISTINCT date_trunc('day', ts)) AS n FROM events GROUP BY 1)
  SELECT user_id, n AS n_found, n - n % 6 AS n_kept, CASE WHEN n - n % 6 < 12 THEN 'too_short' ELSE 'ok' END AS status FROM u""")
def sample_status_users(spark, sf_dir):
    placed = add_position(series.user_days(spark, sf_dir), "ts", ["user_id"])
    return sample_status(placed, 6, ["user_id"]).select("user_id", "n_found", "n_kept", "status")


def _scaling_sql(center: str, spread: str, low: float = 0.0, width: float = 1.0) -> str:
    cols = ", ".join(f"round({low} + ({c} - {center.format(c=c)}) * {width} / coalesce(nullif({spread.format(c=c)}, 0), 1), 6) AS {c}"
                     for c in ("value", "k", "click"))
    return f"SELECT user_id, event_id, {cols} FROM ({sql.EVENTS}) WINDOW u AS (PARTITION BY user_id)"


_SCALINGS = {
    "l2": _scaling_sql("0", "sqrt(sum({c} * {c}) OVER u)"),
    "standard": _scaling_sql("avg({c}) OVER u", "stddev_pop({c}) OVER u"),
    "robust": _scaling_sql("median({c}) OVER u", "(quantile_cont({c}, 0.75) OVER u - quantile_cont({c}, 0.25) OVER u)"),
    "minmax": _scaling_sql("min({c}) OVER u", "(max({c}) OVER u - min({c}) OVER u)", -1.0, 2.0),
}


def _scale_query(method):
    @query(f"scale_{method}_users", _SCALINGS[method])
    def run(spark, sf_dir):
        placed = add_position(series.events_long(spark, sf_dir), "event_id", ["user_id"])
        done = scaled(placed, ["value", "k", "click"], method, ["user_id"])
        return done.select("user_id", "event_id", rnd("value"), rnd("k"), rnd("click"))


for _method in _SCALINGS:
    _scale_query(_method)


def _gap_sql(source: str, keys: str = "") -> str:
    lead, part = (f"{keys}, ", f"PARTITION BY {keys} ") if keys else ("", "")
    return f"""WITH s AS ({source}), g AS (SELECT *, lag(ts) OVER ({part}ORDER BY ts) AS before, count(*) OVER ({part}) AS in_key FROM s),
      d AS (SELECT *, floor((epoch_us(ts) - epoch_us(before)) / 86400000000) AS step FROM g WHERE in_key >= 3 AND before IS NOT NULL),
      m AS (SELECT *, median(step) OVER ({part}) AS mid FROM d)
      SELECT {lead}strftime(before, '%Y-%m-%d %H:%M') AS gap_from, strftime(ts, '%Y-%m-%d %H:%M') AS gap_to, step AS step_days,
        mid AS median_days FROM m WHERE mid > 0 AND step > 1.75 * mid"""


@query("calendar_gaps_users", _gap_sql(sql.USER_DAYS, "user_id"))
def gaps_users(spark, sf_dir):
    placed = add_position(series.user_days(spark, sf_dir), "ts", ["user_id"])
    return calendar_gaps(placed, "ts", ["user_id"]).select("user_id", day("gap_from"), day("gap_to"), "step_days", "median_days")


_SUPPLIER_DAYS = "SELECT l_suppkey, date_trunc('day', l_shipdate)::TIMESTAMP AS ts, sum(l_quantity) AS qty FROM lineitem GROUP BY 1, 2"


@query("calendar_gaps_bulk_days", _gap_sql(_SUPPLIER_DAYS, "l_suppkey"))
def gaps_bulk(spark, sf_dir):
    """Long spells without a line, by supplier, over all lines."""
    lines = series.table(spark, sf_dir, "lineitem")
    days = lines.groupBy("l_suppkey", series.bucket("day", "l_shipdate").alias("ts")).agg(F.sum("l_quantity").alias("qty"))
    placed = add_position(days, "ts", ["l_suppkey"])
    return calendar_gaps(placed, "ts", ["l_suppkey"]).select("l_suppkey", day("gap_from"), day("gap_to"), "step_days", "median_days")


@query("fold_blocks_events", f"""WITH p AS ({sql.blocked(sql.numbered(sql.EVENTS, 'event_id'), 7)})
  SELECT block_id, count(*) AS n, min(event_id) AS first_event, max(event_id) AS last_event FROM p GROUP BY 1""")
def fold_blocks(spark, sf_dir):
    placed = add_position(series.events_long(spark, sf_dir), "event_id", n_blocks=7)
    return placed.groupBy("block_id").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_event"),
                                          F.max("event_id").alias("last_event"))


def _membership_sql(source: str, k: int, design: str, out: str, tail: str = "") -> str:
    if design == "nlo":
        role = "CASE WHEN block_id = fold THEN 'main' WHEN abs(block_id - fold) > 1 THEN 'aux' END"
    else:
        role = "CASE WHEN block_id = fold THEN 'main' WHEN block_id > fold THEN 'aux_right' ELSE 'aux_left' END"
    return f"""WITH p AS ({sql.blocked(source, k)}), m AS (SELECT pos, fold, {role} AS role FROM
      (SELECT *, unnest(range({k}))::INT AS fold FROM p WHERE block_id IS NOT NULL)) SELECT {out} FROM m WHERE role IS NOT NULL {tail}"""


def _membership_query(design):
    @query(f"fold_membership_{design}", _membership_sql(sql.numbered(sql.SIX_HOURS, "ts"), 5, design, "pos, fold, role"))
    def rows(spark, sf_dir):
        placed = add_position(series.event_buckets(spark, sf_dir), "ts", n_blocks=5)
        return fold_membership(placed, 5, design).select("pos", "fold", "role")

    @query(f"fold_roles_events_{design}", _membership_sql(
        sql.numbered(sql.EVENTS, "event_id"), 7, design, "fold, role, count(*) AS n, min(pos) AS first_pos, max(pos) AS last_pos",
        "GROUP BY 1, 2"))
    def roles(spark, sf_dir):
        placed = add_position(series.events_long(spark, sf_dir), "event_id", n_blocks=7)
        return fold_membership(placed, 7, design).groupBy("fold", "role").agg(
            F.count(F.lit(1)).alias("n"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))


for _d in ("rcf", "nlo"):
    _membership_query(_d)


def _use_sql(k: int, design: str) -> str:
    closed = f"{k - 1} * {k - 2} / {k * k}.0" if design == "nlo" else (
        f"{3 * k - 2} / {4 * k}.0" if k % 2 == 0 else f"{3 * (k * k - 1)} / {4 * k * k}.0")
    return f"""SELECT '{design}' AS design, {k} AS "K", fold::INT AS fold, sum(n) AS n_train, round(sum(n) / any_value(total), 6) AS share,
      round(({closed})::DOUBLE, 6) AS closed_share FROM
      (WITH folds AS (SELECT unnest(range({k})) AS fold), blocks AS (SELECT unnest(range({k})) AS block),
        tr AS ({sql.trains(design, k)}), p AS ({sql.blocked(sql.numbered(sql.EVENTS, 'event_id'), k)}),
        c AS (SELECT block_id, count(*) AS n FROM p WHERE block_id IS NOT NULL GROUP BY 1)
        SELECT fold, n, (SELECT sum(n) FROM c) AS total FROM tr JOIN c ON c.block_id = tr.block) GROUP BY fold"""


@query("sample_use_measured", " UNION ALL ".join(_use_sql(k, d) for k in (5, 6) for d in ("rcf", "nlo")))
def sample_use_measured(spark, sf_dir):
    placed = add_position(series.events_long(spark, sf_dir), "event_id")
    out = None
    for k in (5, 6):
        for design in ("rcf", "nlo"):
            part = measured_sample_use(with_blocks(placed, k), k, design).select(
                F.lit(design).alias("design"), F.lit(k).alias("K"), "fold", "n_train", rnd("share"),
                F.round(sample_use_closed(F.lit(k), design), 6).alias("closed_share"))
            out = part if out is None else out.unionByName(part)
    return out


@query("block_products_events", f"""WITH p AS ({sql.blocked(sql.numbered(sql.EVENTS, 'event_id'), 6)}),
  z AS (SELECT block_id, count(*) AS n, {', '.join(f"round(covar_pop({a}, {b}) * count(*), 4) AS s_{a}_{b}" for a, b in
        (('value', 'value'), ('value', 'k'), ('value', 'click'), ('k', 'k'), ('k', 'click'), ('click', 'click')))}
        FROM p WHERE block_id IS NOT NULL GROUP BY 1) SELECT * FROM z""")
def block_products(spark, sf_dir):
    names = ["value", "k", "click"]
    placed = add_position(series.events_long(spark, sf_dir).select("event_id", *names), "event_id", n_blocks=6)
    gram = block_gram(placed, names)
    at = {}
    full = square(list(range(10)), 4)
    for i in range(4):
        for j in range(i, 4):
            at[i, j] = F.col("g")[int(full[i, j])]
    cols = [F.round(at[i, j] - at[0, i] * at[0, j] / at[0, 0], 4).alias(f"s_{names[i - 1]}_{names[j - 1]}")
            for i in range(1, 4) for j in range(i, 4)]
    return gram.select("block_id", at[0, 0].cast("long").alias("n"), *cols)


def _wide_spec():
    codes = {"revenue": 5, "avg_disc": 2, "n_lines": 5, "avg_tax": 1, "qty": 5, "n_returned": 2}
    return Design("ts", "revenue", "avg_disc", codes, fast=("n_lines",), lags=4, horizons=0)


_WIDE = _design_sql(sql.sales(), _wide_spec().codes, "revenue", "avg_disc", ["n_lines"], 4, 0, 6, exact=True)


@query("block_products_wide", f"""SELECT block_id, count(*) AS n, round(covar_pop(n_lines_5, lag4_n_returned_2) * count(*), 5) AS s_first_last,
  round(covar_pop(d, y) * count(*), 7) AS s_policy_outcome FROM ({_WIDE}) GROUP BY 1""")
def block_products_wide(spark, sf_dir):
    """The same sums for many columns, formed batch-wise in numpy."""
    spec = _wide_spec()
    design = build_design(series.sales(spark, sf_dir), spec)
    features = feature_names(spec)
    gram = block_gram(design, [*features, "d", "lead0"])
    width = len(features) + 3
    place = square(list(range(width * (width + 1) // 2)), width)
    g = lambda i, j: F.col("g")[int(place[i, j])]
    s = lambda i, j: g(i, j) - g(0, i) * g(0, j) / g(0, 0)
    first, last = features.index("n_lines_5") + 1, len(features)
    return gram.select("block_id", g(0, 0).cast("long").alias("n"), F.round(s(first, last), 5).alias("s_first_last"),
                       F.round(s(width - 2, width - 1), 7).alias("s_policy_outcome"))
