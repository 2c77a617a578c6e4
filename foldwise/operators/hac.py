"""Long-run variance of ordered series: kernels, cosine sums, bandwidth rules.

Every estimate is an aggregate over products of a row with its ``H`` predecessors.
Bandwidths may differ by key; short ones use lag columns on overlapping chunks,
long Bartlett ones use differences of running sums, whose cost does not grow with ``H``,
other long kernels take all lags of a chunk from one Fourier transform, and many cosines
come from moments of short cells, whose cost does not grow with the number of cosines.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldwise.operators.position import chunk_window, halo
from foldwise.operators.storage import CHUNK_ROWS, attach, beside, chunk_of, materialize, pinned

# Accepted names of the kernels.
KERNELS = {
    "bartlett": "bartlett", "nw": "bartlett", "newey-west": "bartlett", "newey_west": "bartlett",
    "qs": "qs", "quadratic": "qs", "quadratic-spectral": "qs", "quadratic_spectral": "qs",
    "parzen": "parzen",
    "ewc": "ewc", "lls_ewc": "ewc", "lls-ewc": "ewc",
}

# Accepted names of the bandwidth rules.
BANDWIDTH_RULES = {
    "small": "small", "fixed": "fixed",
    "pow14": "pow14", "p14": "pow14", "pow15": "pow15", "p15": "pow15",
    "newey-west": "newey-west", "newey_west": "newey-west", "nw1994": "newey-west",
    "lls_nw": "lls_nw", "lls-nw": "lls_nw", "llsw_nw": "lls_nw", "llsw-nw": "lls_nw", "lazarus_nw": "lls_nw",
    "lls_ewc": "lls_ewc", "lls-ewc": "lls_ewc", "llsw_ewc": "lls_ewc", "llsw-ewc": "lls_ewc", "ewc": "lls_ewc",
    "andrews": "andrews", "andrews1991": "andrews",
}

#: Lag columns per pass.
LAG_COLUMNS = 64
#: Cosines up to which rows are multiplied with each of them.
FEW_COSINES = 128
#: Cells up to which their transform is one step, and remainders that one task of the second step takes.
ONE_STEP, TOGETHER = 1 << 14, 8
#: Half the angle by which a cosine may turn within a cell, and the powers that then make up its series.
TURN, MOMENTS = 1.0, 18


def kernel_named(name: str | None) -> str:
    key = (name or "bartlett").lower()
    if key not in KERNELS:
        raise ValueError(f"unknown kernel {name!r}; known: {sorted(KERNELS)}")
    return KERNELS[key]


def rule_bandwidth(rule: str, n: Column | None = None, horizon: Column | int = 0, value: int | None = None,
                   rho: Column | None = None) -> Column:
    """Bandwidth (or number of cosines) by rule, at least 1.

    ``rho`` is the first autocorrelation of the scores, for the plug-in rule;
    without it (or where it is NULL) that rule falls back to ``newey-west``.
    """
    key = BANDWIDTH_RULES.get((rule or "small").lower())
    if key is None:
        raise ValueError(f"unknown bandwidth rule {rule!r}; known: {sorted(BANDWIDTH_RULES)}")
    horizon = F.lit(horizon) if isinstance(horizon, int) else horizon
    if key == "small":
        return F.least(horizon + 1, F.lit(24)).cast("int")
    if key == "fixed":
        if value is None:
            raise ValueError("rule 'fixed' needs a value")
        return F.lit(max(1, int(value)))
    if n is None:
        raise ValueError(f"rule {rule!r} needs the number of rows")
    automatic = F.floor(4.0 * F.pow(n / F.lit(100.0), F.lit(2.0 / 9.0)))
    if key == "pow14":
        width = F.floor(F.pow(n, F.lit(0.25)))
    elif key == "pow15":
        width = F.floor(1.3221 * F.pow(n, F.lit(0.2)))
    elif key == "newey-west":
        width = automatic
    elif key == "lls_nw":
        width = F.ceil(1.3 * F.pow(n, F.lit(0.5)))
    elif key == "lls_ewc":
        width = F.floor(0.4 * F.pow(n, F.lit(2.0 / 3.0)))
    elif rho is None:
        width = automatic
    else:
        r = F.least(F.greatest(rho, F.lit(-0.97)), F.lit(0.97))
        alpha = 4.0 * r * r / (F.pow(1.0 - r, F.lit(2.0)) * F.pow(1.0 + r, F.lit(2.0)))
        width = F.when(rho.isNull(), automatic).otherwise(F.floor(1.1447 * F.pow(alpha * n, F.lit(1.0 / 3.0))))
    return F.greatest(width.cast("int"), F.lit(1))


def default_bandwidth(kernel: str, n: Column) -> Column:
    """The bandwidth a kernel uses when none is asked for; may be 0."""
    kernel = kernel_named(kernel)
    if kernel == "ewc":
        return rule_bandwidth("lls_ewc", n)
    power = {"bartlett": F.pow(n, F.lit(0.25)), "qs": 1.3221 * F.pow(n, F.lit(0.2)), "parzen": F.pow(n, F.lit(0.2))}
    return F.floor(power[kernel]).cast("int")


def clipped(kernel: str, width: Column, n: Column) -> Column:
    if kernel_named(kernel) == "ewc":
        return F.least(F.greatest(width, F.lit(1)), F.greatest(n - 1, F.lit(1))).cast("int")
    return F.greatest(F.lit(0), F.least(width, n - 1)).cast("int")


def weight(kernel: str, lag: Column, width: Column) -> Column:
    x = lag / (width + 1.0)
    if kernel == "bartlett":
        return 1.0 - x
    if kernel == "qs":
        a = 6.0 * math.pi * x / 5.0
        return 25.0 / (12.0 * math.pi ** 2) / (x * x) * (F.sin(a) / a - F.cos(a))
    return F.when(x <= 0.5, 1.0 - 6.0 * x * x + 6.0 * x * x * x).when(x <= 1.0, 2.0 * F.pow(1.0 - x, F.lit(3.0))).otherwise(0.0)


def _pairs(cols):
    return [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]


def lag_products(rows: DataFrame, cols, max_lag: int, keys=(), chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``keys, p_i_j``: arrays over lags 0..max_lag of ``sum c_i(t) c_j(t-l) + c_j(t) c_i(t-l)``
    (halved for ``i = j``), of columns that are already centred."""
    keys, cols = list(keys), list(cols)
    parts = None
    for first in range(0, max_lag + 1, LAG_COLUMNS):
        lags = range(first, min(first + LAG_COLUMNS, max_lag + 1))
        wide = halo(rows.select(*keys, "pos", *cols), before=lags[-1], chunk_rows=chunk_rows)
        w = chunk_window(keys)
        wide = wide.select(*keys, "_home", *cols, *[
            F.lag(c, l).over(w).alias(f"_{i}_{l}") for i, c in enumerate(cols) for l in lags if l]).where("_home")

        def back(i, l):
            return F.col(f"_{i}_{l}") if l else F.col(cols[i])

        sums = []
        for i, j in _pairs(cols):
            one = [F.coalesce(F.sum(F.col(cols[i]) * back(j, l) if i == j else F.col(cols[i]) * back(j, l)
                                 + F.col(cols[j]) * back(i, l)), F.lit(0.0)) for l in lags]
            sums.append(F.array(*one).alias(f"p_{i}_{j}"))
        piece = wide.groupBy(*keys).agg(*sums)
        if parts is None:
            parts = piece
        else:
            old = parts.select(*keys, *[F.col(f"p_{i}_{j}").alias(f"_old_{i}_{j}") for i, j in _pairs(cols)])
            both = beside(old, piece, keys)
            parts = both.select(*keys, *[F.concat(f"_old_{i}_{j}", f"p_{i}_{j}").alias(f"p_{i}_{j}") for i, j in _pairs(cols)])
    return parts


def kernel_sum(p: Column, kernel: str, width: Column, both: float = 2.0) -> Column:
    """The weighted sum of the lag products ``p`` of a column: lag 0 once, lags 1 to ``width`` times ``both``."""
    kernel = kernel_named(kernel)
    tail = F.aggregate(F.sequence(F.lit(1), width), F.lit(0.0), lambda s, l: s + both * weight(kernel, l, width) * p[l])
    return p[0] + F.when(width >= 1, tail).otherwise(0.0)


def _kernel_sums(rows, cols, add, kernel, keys, max_width, chunk_rows):
    joined = add(lag_products(rows, cols, max_width, keys, chunk_rows))
    out = []
    for i, j in _pairs(cols):
        p = F.col(f"p_{i}_{j}")
        base = p[0] if i == j else p[0] / 2.0
        tail = F.aggregate(F.sequence(F.lit(1), F.col("bandwidth")), F.lit(0.0),
                           lambda s, l: s + weight(kernel, l, F.col("bandwidth")) * p[l] * (2.0 if i == j else 1.0))
        value = base + F.when(F.col("bandwidth") >= 1, tail).otherwise(0.0)
        out.append(F.try_divide(value, F.col("n_obs") - F.col("dof")).alias(f"lrv_{i}_{j}"))
    return joined.select(*keys, "n_obs", "bandwidth", *out)


def _long_bartlett(rows, cols, groups, add, keys, chunk_rows):
    """Bartlett as the sum of squared rolling sums, from running sums and one self-join."""
    spans = rows.select(*keys, "pos", *cols).withColumn("_c", chunk_of(chunk_rows=chunk_rows))
    totals = spans.groupBy(*keys, "_c").agg(*[F.sum(c).alias(f"_t{i}") for i, c in enumerate(cols)])
    over = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy("_c")
    before = over.rowsBetween(Window.unboundedPreceding, -1)
    starts = materialize(totals.select(*keys, "_c", *[
        F.coalesce(F.sum(f"_t{i}").over(before), F.lit(0.0)).alias(f"_b{i}") for i in range(len(cols))]))
    inside = Window.partitionBy(*keys, "_c").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    run = spans.join(starts, [*keys, "_c"]).select(
        *keys, "pos", *[(F.col(f"_b{i}") + F.sum(c).over(inside)).alias(f"_r{i}") for i, c in enumerate(cols)])
    run = materialize(run)
    size = groups.select(*keys, "n_obs", "bandwidth", *(["n_rows"] if keys else []))
    ahead = attach(run, materialize(size) if keys else size, keys, chunk_rows=chunk_rows)
    r = [F.col(f"_r{i}") for i in range(len(cols))]
    shifted = ahead.select(*keys, (F.col("pos") + F.col("bandwidth") + 1).alias("pos"),
                           *[c.alias(f"_o{i}") for i, c in enumerate(r)])
    body = run.join(shifted, [*keys, "pos"], "left")
    roll = [F.col(f"_r{i}") - F.coalesce(F.col(f"_o{i}"), F.lit(0.0)) for i in range(len(cols))]
    # Centred columns sum to zero, so past the end a rolling sum is minus the running sum.
    tail = ahead.where((F.col("pos") >= F.col("n_obs") - F.col("bandwidth") - 1) & (F.col("pos") < F.col("n_obs") - 1))
    names = [f"_v_{i}_{j}" for i, j in _pairs(cols)]
    both = body.select(*keys, *[(roll[i] * roll[j]).alias(n) for n, (i, j) in zip(names, _pairs(cols))]).unionByName(
        tail.select(*keys, *[(r[i] * r[j]).alias(n) for n, (i, j) in zip(names, _pairs(cols))]))
    sums = both.groupBy(*keys).agg(*[F.sum(n).alias(n) for n in names])
    joined = add(sums)
    scale = (F.col("bandwidth") + 1.0) * (F.col("n_obs") - F.col("dof"))
    return joined.select(*keys, "n_obs", "bandwidth", *[
        F.try_divide(F.col(n), scale).alias(f"lrv_{i}_{j}") for n, (i, j) in zip(names, _pairs(cols))])


def _lag_weights(kernel: str, width: int) -> np.ndarray:
    """Kernel weights of the lags 1..width."""
    x = np.arange(1, width + 1) / (width + 1.0)
    if kernel == "bartlett":
        return 1.0 - x
    if kernel == "qs":
        a = 6.0 * np.pi * x / 5.0
        return 25.0 / (12.0 * np.pi ** 2) / (x * x) * (np.sin(a) / a - np.cos(a))
    return np.where(x <= 0.5, 1.0 - 6.0 * x * x + 6.0 * x ** 3, 2.0 * (1.0 - x) ** 3)


def _long_kernel(rows, cols, groups, add, kernel, keys, max_width, chunk_rows):
    """Any kernel and bandwidth in one pass: lag products of a chunk by Fourier transform.

    A chunk with the rows before it that its lags reach gives all its lag products
    at once, and adds them up with the weights of its key; only sums leave the task.
    """
    fields = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    small = groups.select(*keys, "bandwidth", *(["n_rows"] if keys else []))
    small = materialize(small) if keys else small
    data = attach(rows.select(*keys, "pos", *cols), small, keys, chunk_rows=chunk_rows)
    wide = halo(data.select(*keys, "pos", "bandwidth", *cols), before=max_width, chunk_rows=chunk_rows)
    names = [f"_v_{i}_{j}" for i, j in _pairs(cols)]

    def chunk(pdf):
        pdf = pdf.sort_values("pos", kind="stable")
        width, home = int(pdf["bandwidth"].iloc[0]), pdf["_home"].to_numpy(bool)
        z = [pdf[c].to_numpy(float) for c in cols]
        size = 1 << int(len(pdf) + width).bit_length()
        whole = [np.fft.rfft(v, size) for v in z]
        own = [np.fft.rfft(np.where(home, v, 0.0), size) for v in z]
        w, out = _lag_weights(kernel, width), {k: pdf[k].iloc[:1].to_numpy() for k in keys}
        for name, (i, j) in zip(names, _pairs(cols)):
            # Entry l: products of a row here with the row l places before it.
            back = np.fft.irfft(own[i] * np.conj(whole[j]), size)[:width + 1]
            other = back if i == j else np.fft.irfft(own[j] * np.conj(whole[i]), size)[:width + 1]
            out[name] = [back[0] + float(w @ (back[1:] + other[1:]))]
        return pd.DataFrame(out)

    schema = ", ".join([*[f"`{k}` {fields[k]}" for k in keys], *[f"{n} double" for n in names]])
    parts = wide.groupBy(*keys, "_chunk").applyInPandas(chunk, schema)
    joined = add(parts.groupBy(*keys).agg(*[F.sum(n).alias(n) for n in names]))
    return joined.select(*keys, "n_obs", "bandwidth", *[
        F.try_divide(F.col(n), F.col("n_obs") - F.col("dof")).alias(f"lrv_{i}_{j}") for n, (i, j) in zip(names, _pairs(cols))])


def _few_cosines(rows, cols, small, keys, chunk_rows):
    """``keys, _j, _l0..`` for few cosines: each task sums its rows times the cosines."""
    fields = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    data = attach(rows.select(*keys, "pos", *cols), small, keys, chunk_rows=chunk_rows)
    data = data.select(*keys, "pos", "n_obs", "bandwidth", *cols)
    d = len(cols)

    def partial(batches):
        held, doubles = {}, 0
        for pdf in batches:
            grouped = pdf.groupby(keys, sort=False).indices.items() if keys else [((), np.arange(len(pdf)))]
            for name, places in grouped:
                if not len(places):
                    continue
                part = pdf.iloc[places]
                name = name if isinstance(name, tuple) else (name,)
                n, nu = int(part["n_obs"].iloc[0]), int(part["bandwidth"].iloc[0])
                freq = np.arange(1, nu + 1)
                at, c = (part["pos"].to_numpy() + 0.5) / n, part[cols].to_numpy(float)
                if name not in held:
                    held[name] = np.zeros((nu, d))
                    doubles += nu * d
                step = max(1, 2_000_000 // nu)
                for s in range(0, len(at), step):
                    basis = np.cos(np.pi * np.outer(freq, at[s:s + step]))
                    held[name] += np.sqrt(2.0 / n) * basis @ c[s:s + step]
            if doubles > 16_000_000:
                yield frame(held)
                held, doubles = {}, 0
        yield frame(held)

    def frame(held):
        out = pd.DataFrame(list(held), columns=keys) if keys else pd.DataFrame(index=range(len(held)))
        for i in range(d):
            out[f"l{i}"] = [v[:, i] for v in held.values()]
        return out

    schema = ", ".join([*[f"`{k}` {fields[k]}" for k in keys], *[f"l{i} array<double>" for i in range(d)]])
    parts = data.mapInPandas(partial, schema)
    zipped = F.arrays_zip(*[f"l{i}" for i in range(d)])
    each = parts.select(*keys, F.posexplode(zipped).alias("_j", "_l"))
    return each.groupBy(*keys, "_j").agg(*[F.sum(F.col("_l")[f"l{i}"]).alias(f"_l{i}") for i in range(d)])


def _turns(times: np.ndarray, q: int, n: int) -> np.ndarray:
    """``exp(i pi q times / (2 n))`` for whole numbers, reduced before any rounding."""
    return np.exp(0.5j * np.pi / n * ((times % (4 * n)) * q % (4 * n)))


def _chirp(x: np.ndarray, q: int, n: int, terms: int) -> np.ndarray:
    """``sum_b x_b exp(i pi j q b / n)`` for ``j = 1..terms`` by one convolution (Bluestein, 1970)."""
    b, j = np.arange(len(x)), np.arange(terms + 1)
    size = 1 << int(len(x) + terms).bit_length()
    kernel = np.zeros(size, dtype=complex)
    kernel[:terms + 1] = np.conj(_turns(j * j, q, n))
    kernel[size - len(x) + 1:] = np.conj(_turns(b[1:] * b[1:], q, n))[::-1]
    spread = np.fft.ifft(np.fft.fft(x * _turns(b * b, q, n), size) * np.fft.fft(kernel))[:terms + 1]
    return (spread * _turns(j * j, q, n))[1:]


def _turned(j: np.ndarray, b: int, cells: int) -> np.ndarray:
    """``exp(2 i pi j b / cells)`` for whole numbers, reduced before any rounding."""
    return np.exp(2j * np.pi / cells * (j * b % cells))


def _many_cosines(rows, cols, small, keys, chunk_rows):
    """``keys, _j, _l0..`` for many cosines, at a cost of rows plus terms.

    The circle on which the rows of a series fill one half is cut into ``cells``.  Rows of a cell
    are summed with the powers of the distance from its middle; no cosine turns by more than
    ``2 * TURN`` within a cell, so its series in these powers ends after ``MOMENTS`` of them with
    an error below ``TURN ** MOMENTS / MOMENTS!`` (2e-16) of the sum of absolute values.  The sums
    over cells are a transform in two steps: with ``cells = _high * _low``, first over every
    ``_low``-th cell, then over what these give for the same remainder by ``_high``.  A task of either
    step holds about as many numbers as the root of the rows.
    """
    fields = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    d, n, terms = len(cols), F.col("n_obs"), F.col("bandwidth")
    least = F.ceil(math.pi / TURN * (terms + 1))
    low = F.when(least <= ONE_STEP, 1).otherwise(F.ceil(F.sqrt(least))).cast("long")
    small = small.withColumn("_low", low).withColumn("_high", F.ceil(least / F.col("_low")).cast("long"))
    data = attach(rows.select(*keys, "pos", *cols), materialize(small) if keys else small, keys, chunk_rows=chunk_rows)
    at, span = (2 * F.col("pos") + 1) * F.col("_high") * F.col("_low"), 4 * n
    placed = data.withColumn("_cell", F.round((at - F.pmod(at, span)) / span).cast("long")).withColumn("_x", F.pmod(at, span) / (2.0 * n) - 1.0)
    power, sums = F.lit(1.0), []
    for p in range(MOMENTS):
        sums += [F.sum(F.col(c) * power).alias(f"_m{p}_{i}") for i, c in enumerate(cols)]
        power = power * F.col("_x")
    facts = ["n_obs", "bandwidth", "_high", "_low"]
    cells = placed.groupBy(*keys, "_cell").agg(*[F.max(c).alias(c) for c in facts], *sums)
    cells = cells.withColumn("_rest", F.pmod("_cell", "_low"))
    moments = [f"_m{p}_{i}" for p in range(MOMENTS) for i in range(d)]

    def first(pdf):
        high, low, rest = (int(pdf[c].iloc[0]) for c in ("_high", "_low", "_rest"))
        x = np.zeros((len(moments), high))
        x[:, pdf["_cell"].to_numpy() // low] = pdf[moments].to_numpy(float).T
        j = np.arange(high)
        y = np.fft.ifft(x, axis=1) * high * _turned(j, rest, high * low)
        # Runs of remainders that the second step takes together.
        parts = [np.ascontiguousarray(y[:, k:k + TOGETHER]).tobytes() for k in range(0, high, TOGETHER)]
        out = {c: [pdf[c].iloc[0]] * len(parts) for c in [*keys, *facts, "_rest"]}
        return pd.DataFrame({**out, "_part": np.arange(len(parts)), "_y": parts})

    def second(pdf):
        n, terms, high, low, part = (int(pdf[c].iloc[0]) for c in ("n_obs", "bandwidth", "_high", "_low", "_part"))
        width, total = min(TOGETHER, high - part * TOGETHER), high * low
        y = np.zeros((low, len(moments), width), dtype=complex)
        for rest, given in zip(pdf["_rest"], pdf["_y"]):
            y[rest] = np.frombuffer(given, dtype=complex).reshape(len(moments), width)
        y = np.fft.ifft(y, axis=0) * low
        j = (part * TOGETHER + np.arange(width) + high * np.arange(low)[:, None])
        # The series of exp(i w x) in x, and the turn to the middle of the first cell.
        turn = 1j * np.pi * j / total
        scale, lams = np.exp(turn) * np.sqrt(2.0 / n), np.zeros((d, low, width))
        for p in range(MOMENTS):
            for i in range(d):
                lams[i] += (scale * y[:, p * d + i]).real
            scale = scale * turn / (p + 1)
        inside = (j >= 1) & (j <= terms)
        out = {k: pdf[k].iloc[:1].to_numpy() for k in keys}
        return pd.DataFrame({**out, "j": [j[inside]], **{f"l{i}": [lams[i][inside]] for i in range(d)}})

    own = ", ".join([f"`{k}` {fields[k]}" for k in keys] + [""])
    kinds = {f.name: f.dataType.simpleString() for f in cells.schema.fields}
    halves = cells.groupBy(*keys, "_rest").applyInPandas(
        first, own + ", ".join(f"{c} {kinds[c]}" for c in [*facts, "_rest"]) + ", _part long, _y binary")
    found = halves.groupBy(*keys, "_part").applyInPandas(second, own + ", ".join(["j array<bigint>", *[f"l{i} array<double>" for i in range(d)]]))
    each = found.select(*keys, F.explode(F.arrays_zip("j", *[f"l{i}" for i in range(d)])).alias("_l"))
    return each.select(*keys, F.col("_l.j").alias("_j"), *[F.col("_l")[f"l{i}"].alias(f"_l{i}") for i in range(d)])


def _cosine_sums(rows, cols, groups, add, keys, chunk_rows):
    """Equal-weighted cosines; series with up to ``FEW_COSINES`` of them and those with more go their own ways to the same sums."""
    small = groups.select(*keys, "n_obs", "bandwidth", *(["n_rows"] if keys else []))
    d, lams = len(cols), None
    if keys:
        small = materialize(small)
    for few, sums in ((True, _few_cosines), (False, _many_cosines)):
        mine = small.where((F.col("bandwidth") <= FEW_COSINES) == few)
        if not mine.isEmpty():
            found = sums(rows, cols, mine, keys, chunk_rows)
            lams = found if lams is None else lams.unionByName(found)
    if lams is None:  # no series at all
        lams = _few_cosines(rows, cols, small, keys, chunk_rows)
    sums = lams.groupBy(*keys).agg(*[F.sum(F.col(f"_l{i}") * F.col(f"_l{j}")).alias(f"_v_{i}_{j}") for i, j in _pairs(cols)])
    joined = add(sums)
    return joined.select(*keys, "n_obs", "bandwidth", *[
        (F.col(f"_v_{i}_{j}") / F.col("bandwidth")).alias(f"lrv_{i}_{j}") for i, j in _pairs(cols)])


def centred_lrv(rows: DataFrame, cols, groups: DataFrame, kernel: str, keys=(), chunk_rows: int = CHUNK_ROWS,
                lag_limit: int = LAG_COLUMNS) -> DataFrame:
    """Long-run variance of columns with mean zero, positions 0..n_obs-1 in each key.

    ``groups`` has ``keys, n_rows, n_obs, bandwidth, dof``, one row per key.
    """
    keys, cols = list(keys), list(cols)
    kernel = kernel_named(kernel)
    needed = groups.select(*keys, "n_obs", "bandwidth", "dof")
    if keys:
        largest = (needed.agg(F.max("bandwidth")).first()[0] or 0) if kernel != "ewc" else 0
        add = lambda sums: sums.join(needed, keys)
    else:
        row = needed.first()
        largest = row["bandwidth"]
        groups = groups.sparkSession.createDataFrame([row], needed.schema)
        add = lambda sums: sums.withColumns({c: F.lit(row[c]) for c in needed.columns})
    if kernel == "ewc":
        return _cosine_sums(rows, cols, groups, add, keys, chunk_rows)
    if kernel == "bartlett" and largest > lag_limit:
        return _long_bartlett(rows, cols, groups, add, keys, chunk_rows)
    if largest > lag_limit:
        return _long_kernel(rows, cols, groups, add, kernel, keys, largest, chunk_rows)
    return _kernel_sums(rows, cols, add, kernel, keys, largest, chunk_rows)


def side_by_side_lrv(rows: DataFrame, cols: dict[int, str], groups: DataFrame, lags: dict[int, int], kernel: str, keys=(),
                     chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``keys, h, lrv_0_0`` of centred columns, one per ``h``, in one pass over the rows.

    ``groups`` (stored) has ``keys, h, n_obs, bandwidth, dof``; ``lags`` the largest bandwidth of each ``h``.
    """
    keys, kernel = list(keys), kernel_named(kernel)
    wide = halo(rows.select(*keys, "pos", *cols.values()), before=max(lags.values()), chunk_rows=chunk_rows)
    w = chunk_window(keys)
    back = {h: [F.lag(c, l).over(w).alias(f"_{h}_{l}") for l in range(1, lags[h] + 1)] for h, c in cols.items()}
    wide = wide.select(*keys, "_home", *cols.values(), *[x for some in back.values() for x in some]).where("_home")
    products = [F.array(*[F.coalesce(F.sum(F.col(c) * F.col(f"_{h}_{l}" if l else c)), F.lit(0.0)) for l in range(lags[h] + 1)]).alias(f"_p{h}") for h, c in cols.items()]
    sums = wide.groupBy(*keys).agg(*products)
    each = F.explode(F.array(*[F.struct(F.lit(h).alias("h"), F.col(f"_p{h}").alias("p")) for h in cols]))
    joined = groups.select(*keys, "h", "n_obs", "bandwidth", "dof").join(sums.select(*keys, each.alias("_e")).select(*keys, "_e.*"), [*keys, "h"])
    value = kernel_sum(F.col("p"), kernel, F.col("bandwidth"))
    return joined.select(*keys, "h", F.try_divide(value, F.col("n_obs") - F.col("dof")).alias("lrv_0_0"))


def lrv(df: DataFrame, cols, keys=(), kernel: str = "bartlett", bandwidth: Column | int | None = None,
        dof: Column | int = 0, chunk_rows: int = CHUNK_ROWS, lag_limit: int = LAG_COLUMNS) -> DataFrame:
    """Long-run variance matrix of ``cols`` by key: ``n_obs, bandwidth, lrv_i_j`` for ``i <= j``.

    ``bandwidth`` may be a Column over ``n_obs``; NULL stands for the default of the kernel.
    """
    keys, cols = list(keys), list(cols)
    stats = df.groupBy(*keys).agg(F.max("n_rows").alias("n_rows"), F.count(F.lit(1)).alias("n_obs"),
                                  *[F.avg(c).alias(f"_m{i}") for i, c in enumerate(cols)])
    n = F.col("n_obs")
    width = default_bandwidth(kernel, n) if bandwidth is None else (F.lit(bandwidth) if isinstance(bandwidth, int) else bandwidth)
    stats = stats.withColumn("bandwidth", clipped(kernel, width, n)).withColumn(
        "dof", F.lit(dof) if isinstance(dof, int) else dof)
    stats = pinned(stats, keys)
    means = stats.select(*keys, *(["n_rows"] if keys else []), *[f"_m{i}" for i in range(len(cols))])
    rows = attach(df.select(*keys, "pos", *cols), means, keys, chunk_rows=chunk_rows)
    rows = rows.withColumns({c: F.col(c) - F.col(f"_m{i}") for i, c in enumerate(cols)})
    return centred_lrv(rows, cols, stats, kernel, keys, chunk_rows, lag_limit)


def first_autocorrelation(rows: DataFrame, col: str, keys=(), chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``keys, rho`` of a centred column, over the sum of squares without the last row.

    NULL for fewer than three rows or no variation.
    """
    keys = list(keys)
    wide = halo(rows.select(*keys, "pos", col), before=1, chunk_rows=chunk_rows)
    old = F.lag(col, 1).over(chunk_window(keys))
    pairs = wide.select(*keys, "_home", F.col(col).alias("_x"), old.alias("_o")).where("_home")
    return pairs.groupBy(*keys).agg(
        F.when((F.count(F.lit(1)) >= 3) & (F.avg(F.col("_x") * F.col("_x")) >= 1e-12),
               F.try_divide(F.sum(F.col("_x") * F.col("_o")), F.sum(F.col("_o") * F.col("_o")))).alias("rho"))
