"""Linear learners solved from summed products, one small task per fold.

Lasso and elastic net minimise ``|y - Xw - b|^2 / (2n) + penalty * (share * |w|_1
+ (1 - share) / 2 * |w|^2)``; ridge minimises ``|y - Xw - b|^2 + penalty * |w|^2``.
The intercept is never penalised, and a column without spread gets weight 0.
"""

from __future__ import annotations

import numpy as np

KINDS = ("ols", "ridge", "lasso", "elastic")
MAX_SWEEPS = 5_000
TOLERANCE = 1e-11


def square(g: np.ndarray, width: int) -> np.ndarray:
    full = np.zeros((width, width))
    full[np.triu_indices(width)] = g
    return full + np.triu(full, 1).T


def merged(parts) -> tuple[np.ndarray, np.ndarray]:
    """One matrix about the common mean from ``(matrix, anchor)`` of several blocks.

    What a block adds beyond its own centred products is a square of its distance
    from the common mean, so nothing large is ever subtracted.
    """
    sizes = np.array([g[0, 0] for g, _ in parts])
    levels = np.stack([anchor + g[0, 1:] / g[0, 0] for g, anchor in parts])
    centre = levels[0] + sizes @ (levels - levels[0]) / sizes.sum()
    total = np.zeros_like(parts[0][0])
    for g, anchor in parts:
        step = anchor - centre
        total += g
        total[0, 1:] += g[0, 0] * step
        total[1:, 1:] += np.outer(g[0, 1:], step) + np.outer(step, g[0, 1:]) + g[0, 0] * np.outer(step, step)
    total[1:, 0] = total[0, 1:]
    return total, centre


def centred(gram: np.ndarray, p: int, target: int, level: np.ndarray):
    """Rows, centred products of the features, and of features and target.

    A column is flat if its spread is lost in the rounding of its ``level``.
    """
    n = gram[0, 0]
    means = gram[0] / n
    sxx = gram[1:p + 1, 1:p + 1] - n * np.outer(means[1:p + 1], means[1:p + 1])
    sxy = gram[1:p + 1, target] - n * means[1:p + 1] * means[target]
    flat = np.diag(sxx) <= n * np.maximum(1e-12 * np.abs(level[:p]), 1e-150) ** 2
    sxx[flat, :] = 0.0
    sxx[:, flat] = 0.0
    sxy[flat] = 0.0
    return n, means, sxx, sxy


def feature_sign(sxx, sxy, l1: float, l2: float, w: np.ndarray):
    """The minimum by steps to the least squares of the current signs (Lee et al., 2007).

    Ends after finitely many steps also where columns are nearly collinear, which
    coordinate descent approaches slowly.  None if rounding stops the progress.
    """
    def cost(v):
        return 0.5 * v @ sxx @ v - sxy @ v + l1 * np.abs(v).sum() + 0.5 * l2 * v @ v

    w = w.copy()
    slack = 1e-10 * max(l1, np.max(np.abs(sxy)), 1e-300)
    usable = np.diag(sxx) > 0
    now = cost(w)
    for _ in range(20 * len(w) + 50):
        grad = sxx @ w + l2 * w - sxy
        sign = np.sign(w)
        on = w != 0
        if np.all(np.abs(grad[on] + l1 * sign[on]) <= slack):
            excess = np.where(on | ~usable, -np.inf, np.abs(grad) - l1)
            j = int(np.argmax(excess))
            if excess[j] <= slack:
                return w
            on[j], sign[j] = True, -np.sign(grad[j])
        at = np.flatnonzero(on)
        goal = np.linalg.lstsq(sxx[np.ix_(at, at)] + l2 * np.eye(len(at)), sxy[at] - l1 * sign[at], rcond=1e-14)[0]
        move = goal - w[at]
        crossing = (w[at] != 0) & (np.sign(goal) != np.sign(w[at]))
        best, best_cost = None, now
        for t, zero in [(1.0, None), *[(-w[at[i]] / move[i], i) for i in np.flatnonzero(crossing)]]:
            trial = w.copy()
            trial[at] = w[at] + t * move
            if zero is not None:
                trial[at[zero]] = 0.0
            value = cost(trial)
            if value < best_cost or best is None:
                best, best_cost = trial, value
        if best_cost > now + 1e-12 * abs(now) or np.array_equal(best, w):
            return None
        w, now = best, best_cost
    return None


def descend(sxx, sxy, l1: float, l2: float, w: np.ndarray) -> np.ndarray:
    """Coordinate descent on averaged products from the start ``w``, finished exactly."""
    diag = np.diag(sxx)
    usable = np.flatnonzero(diag > 0)
    scale = max(np.max(np.abs(sxy), initial=0.0), 1e-300)
    if not len(usable) or np.max(np.abs(sxy[usable])) <= l1:
        return np.zeros(len(w))
    pull = sxy - sxx @ w
    for sweep in range(MAX_SWEEPS):
        largest = 0.0
        for j in usable:
            old = w[j]
            rho = pull[j] + diag[j] * old
            new = np.sign(rho) * max(abs(rho) - l1, 0.0) / (diag[j] + l2)
            if new != old:
                pull -= sxx[:, j] * (new - old)
                w[j] = new
                largest = max(largest, abs(new - old) * diag[j])
        if largest <= TOLERANCE * scale:
            break
        if sweep in (4, 100):
            exact = feature_sign(sxx, sxy, l1, l2, w)
            if exact is not None:
                return exact
    grad = sxx @ w + l2 * w - sxy
    off = np.where(w != 0, np.abs(grad + l1 * np.sign(w)), np.maximum(np.abs(grad) - l1, 0.0))[usable]
    if np.max(off) > 1e-7 * scale:
        raise np.linalg.LinAlgError(f"no solution for penalty {l1:g} after {MAX_SWEEPS} sweeps")
    return w


def least_squares(sxx: np.ndarray, sxy: np.ndarray) -> np.ndarray:
    """Weights of ordinary least squares; of many solutions the shortest.

    Rank is judged on columns of equal spread, so that one column of a far larger
    spread does not hide the others.
    """
    spread = np.sqrt(np.diag(sxx))
    on = spread > 0
    if not on.any():
        return np.zeros(len(sxy))
    alike = sxx[np.ix_(on, on)] / np.outer(spread[on], spread[on])
    values, vectors = np.linalg.eigh(alike)
    if values[0] <= 1e-11 * values[-1]:
        return np.linalg.pinv(sxx, rcond=1e-11, hermitian=True) @ sxy
    w = np.zeros(len(sxy))
    w[on] = vectors @ (vectors.T @ (sxy[on] / spread[on]) / values) / spread[on]
    return w


def weights(gram: np.ndarray, p: int, target: int, kind: str, penalty: float, share: float, level: np.ndarray, start=None):
    """``[intercept, w...]`` in the columns of ``gram``, which are shifted by ``level``."""
    if kind not in KINDS:
        raise ValueError(f"unknown learner {kind!r}; known: {KINDS}")
    n, means, sxx, sxy = centred(gram, p, target, level)
    if kind == "ols":
        w = least_squares(sxx, sxy)
    elif kind == "ridge":
        w = np.linalg.solve(sxx + penalty * np.eye(p), sxy) if penalty else least_squares(sxx, sxy)
    else:
        share = 1.0 if kind == "lasso" else share
        w = np.zeros(p) if start is None else start.copy()
        w = descend(sxx / n, sxy / n, penalty * share, penalty * (1 - share), w)
    return np.concatenate([[means[target] - means[1:p + 1] @ w], w])


def squared_error(gram: np.ndarray, level: np.ndarray, p: int, target: int, beta: np.ndarray) -> float:
    """Sum of squared errors of ``beta`` (in the original columns) on the rows behind ``gram``."""
    v = np.zeros(len(gram))
    v[1:p + 1] = -beta[1:]
    v[target] = 1.0
    v[0] = level[target - 1] - beta[0] - beta[1:] @ level[:p]
    return max(float(v @ gram @ v), 0.0)


def unshifted(beta: np.ndarray, anchor: np.ndarray, p: int, target: int) -> np.ndarray:
    """The same line in the original columns."""
    out = beta.copy()
    out[0] += anchor[target - 1] - beta[1:] @ anchor[:p]
    return out
