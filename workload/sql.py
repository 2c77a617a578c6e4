"""Pieces of SQL shared by the checks."""

from __future__ import annotations

DAY = "strftime(ts, '%Y-%m-%d %H:%M') AS ts"


def sales(unit: str = "week") -> str:
    return f"""SELECT date_trunc('{unit}', l_shipdate)::TIMESTAMP AS ts, sum(l_quantity) AS qty,
      sum(l_extendedprice * (1 - l_discount)) AS revenue, avg(l_discount) AS avg_disc, avg(l_tax) AS avg_tax,
      count(*)::DOUBLE AS n_lines, sum(CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE 0 END) AS n_returned
      FROM lineitem GROUP BY 1"""


EVENTS = """SELECT event_id, user_id, value::DOUBLE AS value, regexp_extract(props, '([0-9]+)', 1)::DOUBLE AS k,
  CASE WHEN event_type = 'click' THEN 1.0::DOUBLE ELSE 0.0 END AS click FROM events"""

SIX_HOURS = """SELECT time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '2000-01-01') AS ts, count(*)::DOUBLE AS n,
  sum(value) AS value_sum, avg(value) AS value_avg FROM events GROUP BY 1"""

USER_DAYS = "SELECT user_id, date_trunc('day', ts)::TIMESTAMP AS ts, count(*)::DOUBLE AS n, sum(value) AS value_sum FROM events GROUP BY 1, 2"


def orders(*keys: str) -> str:
    head = "".join(f"{k}, " for k in keys)
    return f"""SELECT {head}date_trunc('month', o_orderdate)::TIMESTAMP AS ts, count(*)::DOUBLE AS n, sum(o_totalprice) AS total,
      avg(o_totalprice) AS avg_total FROM orders GROUP BY ALL"""


def numbered(source: str, order: str, keys: str = "") -> str:
    """``pos`` and ``n_rows`` added to a query."""
    part = f"PARTITION BY {keys} " if keys else ""
    return f"SELECT *, row_number() OVER ({part}ORDER BY {order}) - 1 AS pos, count(*) OVER ({part}) AS n_rows FROM ({source})"


def blocked(source: str, k: int) -> str:
    return (f"SELECT *, CASE WHEN pos // (n_rows // {k}) < {k} THEN (pos // (n_rows // {k}))::INT END AS block_id "
            f"FROM ({source}) WHERE n_rows >= {k}")


def trains(design: str, k: int) -> str:
    """The blocks that train a fold, with a side."""
    if design == "nlo":
        return f"SELECT fold, 0 AS side, block FROM folds, blocks WHERE abs(block - fold) > 1"
    half = k // 2
    central = f"fold = {half}" if k % 2 else "false"
    return (f"SELECT fold, 1 AS side, block FROM folds, blocks WHERE block > fold AND (fold < {half} OR {central}) "
            f"UNION ALL SELECT fold, 2, block FROM folds, blocks WHERE block < fold AND NOT (fold < {half})")


def soft(c: str, t: str) -> str:
    return f"(sign({c}) * greatest(abs({c}) - {t}, 0))"


def one_control_line(kind: str, penalty: str, share: str = "0.5") -> str:
    """Slope of ``t`` on one control ``x`` from its aggregates ``n, c, v``."""
    return {"ols": "c / v", "ridge": f"c * n / (v * n + {penalty})", "lasso": f"{soft('c', penalty)} / v",
            "elastic": f"{soft('c', f'{penalty} * {share}')} / (v + {penalty} * (1 - {share}))"}[kind]


def residuals(source: str, k: int, targets: dict[str, str], kind: str = "ols", penalty: str = "0", design: str = "rcf",
              keys: str = "") -> str:
    """CTEs ending in ``resid``: residuals of ``targets`` (name -> expression) on the control ``x``.

    ``source`` gives ``pos, n_rows, block_id, x`` and whatever the targets need.
    """
    key = f"{keys}, " if keys else ""
    same = f" AND s.{keys} = l.{keys}" if keys else ""
    pull = f"s.{keys}, " if keys else ""
    lines = []
    for name, expr in targets.items():
        lines.append(f"SELECT {key}fold, side, '{name}' AS eq, count(*) AS n, avg({expr}) AS my, avg(x) AS mx, "
                     f"covar_pop({expr}, x) AS c, var_pop(x) AS v FROM src JOIN tr ON tr.block = src.block_id GROUP BY ALL")
    outs = ", ".join(f"max(CASE WHEN l.eq = '{name}' THEN ({expr}) - l.a - l.b * s.x END) AS {name}"
                     for name, expr in targets.items())
    return f"""src AS ({source}), folds AS (SELECT unnest(range({k})) AS fold), blocks AS (SELECT unnest(range({k})) AS block),
      tr AS ({trains(design, k)}), agg AS ({' UNION ALL '.join(lines)}),
      sides AS (SELECT *, {one_control_line(kind, penalty)} AS slope FROM agg),
      lines AS (SELECT {key}fold, eq, avg(slope) AS b, avg(my - slope * mx) AS a FROM sides GROUP BY ALL),
      resid AS (SELECT {pull}s.pos, s.n_rows, s.block_id, {outs} FROM src s JOIN lines l ON l.fold = s.block_id{same}
                GROUP BY ALL)"""


def weight(kernel: str, lag: str, width: str) -> str:
    x = f"({lag} / ({width} + 1.0::DOUBLE))"
    if kernel == "bartlett":
        return f"(1.0 - {x})"
    if kernel == "qs":
        a = f"(6 * pi() * {x} / 5)"
        return f"(25 / (12 * pi() * pi()) / ({x} * {x}) * (sin({a}) / {a} - cos({a})))"
    return f"(CASE WHEN {x} <= 0.5 THEN 1 - 6 * {x} * {x} + 6 * {x} * {x} * {x} ELSE 2 * pow(1 - {x}, 3) END)"


DEFAULT_WIDTH = {"bartlett": "floor(pow(n, 0.25))", "qs": "floor(1.3221 * pow(n, 0.2))", "parzen": "floor(pow(n, 0.2))",
                 "ewc": "greatest(floor(0.4 * pow(n, 2.0 / 3.0)), 1)"}


def lrv(rows: str, kernel: str, width: str, dof: str = "0", by: str = "") -> str:
    """CTEs ending in ``lrv(by, n, width, v)`` for the column ``s`` of ``rows(by, pos, s)``.

    ``width`` and ``dof`` may use ``n`` and aggregates of ``rows``.
    """
    key = f"{by}, " if by else ""
    cols = by.split(", ") if by else []
    part = f"PARTITION BY {', '.join('c.' + c for c in cols)} " if by else ""
    on = "".join(f" AND a.{c} = b.{c}" for c in cols)
    onw = " AND ".join(f"c.{c} = w.{c}" for c in cols) or "true"
    base = f"""lr_rows AS ({rows}), lr_n AS (SELECT {key}count(*) AS n, avg(s) AS mu, max({dof}) AS dof FROM lr_rows GROUP BY ALL),
      lr_w AS (SELECT *, least({width}, n - 1)::INT AS width FROM lr_n),
      lr_c AS (SELECT c.* EXCLUDE (s), c.s - w.mu AS s, w.n, w.width, w.dof,
        row_number() OVER ({part}ORDER BY c.pos) AS rn
        FROM lr_rows c JOIN lr_w w ON {onw})"""
    if kernel == "ewc":
        return base + f""",
      lr_l AS (SELECT {key}n, width, j, sum(sqrt(2.0 / n) * cos(pi() * j * (rn - 0.5) / n) * s) AS l
        FROM (SELECT *, unnest(range(1, width + 1)) AS j FROM lr_c) GROUP BY ALL),
      lrv AS (SELECT {key}n, width, sum(l * l) / max(width) AS v FROM lr_l GROUP BY ALL)"""
    sel = "".join(f"a.{c}, " for c in cols)
    return base + f""",
      lr_p AS (SELECT {sel}a.n, a.width, a.dof, a.lag, sum(a.s * b.s) AS p
        FROM (SELECT *, unnest(range(0, width + 1)) AS lag FROM lr_c) a JOIN lr_c b ON b.rn = a.rn - a.lag{on} GROUP BY ALL),
      lrv AS (SELECT {key}n, width, sum(CASE WHEN lag = 0 THEN p ELSE 2 * {weight(kernel, 'lag', 'width')} * p END)
        / (n - max(dof)) AS v FROM lr_p GROUP BY {key}n, width)"""


def line_cols(intercept: bool) -> str:
    if intercept:
        return ("regr_slope(chi, xi) AS b, regr_intercept(chi, xi) AS a, regr_sxx(chi, xi) AS sxx, "
                "regr_syy(chi, xi) - regr_slope(chi, xi) * regr_sxy(chi, xi) AS sse, count(*) - 2 AS df, avg(xi) AS center")
    return ("sum(xi * chi) / sum(xi * xi) AS b, 0.0::DOUBLE AS a, sum(xi * xi) AS sxx, "
            "sum(chi * chi) - sum(xi * chi) / sum(xi * xi) * sum(xi * chi) AS sse, count(*) - 1 AS df, 0.0::DOUBLE AS center")


def stage2_block(rows: str, kernel: str = "bartlett", width: str | None = None, intercept: bool = True, by: str = "") -> str:
    """CTEs ending in ``effect(by, coef, std_error, n, k, width)`` from ``rows(by, pos, block_id, chi, xi)``."""
    key = f"{by}, " if by else ""
    cols = by.split(", ") if by else []
    on_f = "".join(f" AND r.{c} = f.{c}" for c in cols)
    on_t = " AND ".join(f"r.{c} = t.{c}" for c in cols) or "true"
    on_e = " AND ".join(f"t.{c} = l.{c}" for c in cols) or "true"
    sel = "".join(f"r.{c}, " for c in cols)
    selt = "".join(f"t.{c}, " for c in cols)
    scores = f"""SELECT {sel}r.pos, r.xi * (r.chi - f.a - t.theta * r.xi) AS s, t.k FROM s2 r
      JOIN fits f ON r.block_id = f.block_id{on_f} JOIN theta t ON {on_t}"""
    return f"""s2 AS (SELECT * FROM ({rows}) WHERE block_id IS NOT NULL),
      fits AS (SELECT * FROM (SELECT {key}block_id, count(*) AS n, {line_cols(intercept)}, sum(xi * xi) AS sq FROM s2 GROUP BY {key}block_id)
        WHERE sxx > 0),
      theta AS (SELECT {key}avg(b) AS theta, count(*) AS k, sum(n) AS nn, sum(sq) / sum(n) AS jac,
        sqrt(sum(sse / df / sxx)) / count(*) AS se_avg FROM fits {'GROUP BY ' + by if by else ''}),
      {lrv(scores, kernel, width or DEFAULT_WIDTH[kernel], 'k', by)},
      effect AS (SELECT {selt}t.theta AS coef, sqrt(l.v / t.jac / t.jac / t.nn) AS std_error, t.nn AS n, t.k, l.width, t.se_avg
        FROM theta t JOIN lrv l ON {on_e})"""


def t_p(t: str, df: str) -> str:
    """Two-sided p-value of Student's t for whole degrees of freedom, as a finite sum."""
    df = f"({df})"
    cos2 = f"({df} / ({df} + ({t}) * ({t})))"
    sin = f"(({t}) / sqrt({df} + ({t}) * ({t})))"
    even = (f"({sin} * list_sum([exp(lgamma(j + 0.5) - lgamma(0.5) - lgamma(j + 1.0) + j * ln({cos2})) "
            f"for j in range(0, ({df})::BIGINT // 2)]))")
    odd = (f"(2 / pi() * (atan(({t}) / sqrt({df})) + {sin} * coalesce(list_sum([exp(lgamma(j + 1.0) + lgamma(1.5) - lgamma(j + 1.5) "
           f"+ (j + 0.5) * ln({cos2})) for j in range(0, ({df})::BIGINT // 2)]), 0)))")
    return f"(1 - CASE WHEN ({df})::BIGINT % 2 = 0 THEN {even} ELSE {odd} END)"


def chi2_p(x: str, df: str) -> str:
    """Upper tail of chi-square for whole degrees of freedom: finite sums for even ones, the series of the error function for odd ones."""
    h, k = f"greatest(({x}) / 2, 1e-300)", f"({df})::BIGINT"
    even = f"list_sum([exp(j * ln({h}) - {h} - lgamma(j + 1.0)) for j in range(0, {k} // 2)])"
    odd = f"greatest(1 - list_sum([exp((j + 0.5) * ln({h}) - {h} - lgamma(j + 1.5)) for j in range(({k} - 1) // 2, 700)]), 0)"
    return f"(CASE WHEN {h} > 300 THEN 0 WHEN {k} % 2 = 0 THEN {even} ELSE {odd} END)"


def t_quantiles(groups: str, p: str = "0.05") -> str:
    """A recursive CTE ``bis(n, i, lo, hi)``: two-sided t quantiles with ``n - 2`` degrees of freedom for each ``n`` below 100 of ``groups``."""
    inside = t_p("((lo + hi) / 2)", "greatest(n - 2, 1)")
    return f"""bis AS (SELECT DISTINCT n, 0 AS i, 0.0::DOUBLE AS lo, 64.0::DOUBLE AS hi FROM {groups} WHERE n < 100
      UNION ALL SELECT n, i + 1, CASE WHEN p > {p} THEN (lo + hi) / 2 ELSE lo END, CASE WHEN p > {p} THEN hi ELSE (lo + hi) / 2 END
      FROM (SELECT *, {inside} AS p FROM bis WHERE i < 60)),
      crit AS (SELECT n, max(lo) AS crit FROM bis WHERE i = 60 GROUP BY n)"""


Z95 = "1.959963984540054"
STARS = "CASE WHEN {p} < 0.01 THEN '***' WHEN {p} < 0.05 THEN '**' WHEN {p} < 0.1 THEN '*' ELSE '' END"
