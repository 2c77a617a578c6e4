"""Plain numpy versions over whole arrays, to compare the block and chunk routes with."""

import math

import numpy as np


def blocks(n, k):
    size = n // k
    return np.array([t // size if t // size < k else -1 for t in range(n)])


def train_rows(block, fold, k, design="rcf"):
    """Index lists that train a fold, one per side."""
    if design == "nlo":
        return [np.flatnonzero((block >= 0) & (np.abs(block - fold) > 1))]
    right, left = np.flatnonzero(block > fold), np.flatnonzero((block >= 0) & (block < fold))
    if k % 2 and fold == k // 2:
        return [s for s in (right, left) if len(s)]
    return [right] if fold < k // 2 else [left]


def ols(x, y):
    mx, my = x.mean(axis=0), y.mean()
    w = np.linalg.lstsq(x - mx, y - my, rcond=None)[0]
    return my - mx @ w, w


def lasso(x, y, penalty, share=1.0, sweeps=20000):
    mx, my = x.mean(axis=0), y.mean()
    xc, r, n = x - mx, y - my, len(y)
    w, norm = np.zeros(x.shape[1]), (xc ** 2).sum(axis=0) / n
    for _ in range(sweeps):
        before = w.copy()
        for j in range(len(w)):
            if norm[j] < 1e-14:
                continue
            rho = xc[:, j] @ r / n + norm[j] * w[j]
            new = math.copysign(max(abs(rho) - penalty * share, 0), rho) / (norm[j] + penalty * (1 - share))
            r = r - xc[:, j] * (new - w[j])
            w[j] = new
        if np.abs(w - before).max() < 1e-13:
            break
    return my - mx @ w, w


def cross_residuals(x, y, k, fit, design="rcf"):
    block = blocks(len(y), k)
    out = np.full(len(y), np.nan)
    for fold in range(k):
        main = np.flatnonzero(block == fold)
        preds = []
        for rows in train_rows(block, fold, k, design):
            b, w = fit(x[rows], y[rows])
            preds.append(b + x[main] @ w)
        out[main] = y[main] - np.mean(preds, axis=0)
    return out


def kernel_weight(kernel, h, width):
    x = h / (width + 1)
    if kernel == "bartlett":
        return 1 - x
    if kernel == "qs":
        a = 6 * math.pi * x / 5
        return 25 / (12 * math.pi ** 2 * x ** 2) * (math.sin(a) / a - math.cos(a))
    return 1 - 6 * x ** 2 + 6 * x ** 3 if x <= 0.5 else 2 * (1 - x) ** 3


def long_run(s, kernel, width, dof=0):
    s = np.asarray(s, float).reshape(len(s), -1)
    c, n = s - s.mean(axis=0), len(s)
    if kernel == "ewc":
        t = (np.arange(n) + 0.5) / n
        lam = [math.sqrt(2 / n) * np.cos(math.pi * j * t) @ c for j in range(1, width + 1)]
        return sum(np.outer(v, v) for v in lam) / width
    total = c.T @ c / (n - dof)
    for h in range(1, width + 1):
        g = c[h:].T @ c[:-h] / (n - dof)
        total = total + kernel_weight(kernel, h, width) * (g + g.T)
    return total


def stage2_block(chi, xi, k, width=None, kernel="bartlett"):
    block = blocks(len(chi), k)
    main = block >= 0
    slope, const = np.zeros(k), np.zeros(k)
    for f in range(k):
        m = block == f
        slope[f] = np.cov(xi[m], chi[m], bias=True)[0, 1] / np.var(xi[m])
        const[f] = chi[m].mean() - slope[f] * xi[m].mean()
    theta = slope.mean()
    b = block[main]
    e = chi[main] - const[b] - theta * xi[main]
    score, n = xi[main] * e, int(main.sum())
    width = math.floor(n ** 0.25) if width is None else width
    lrv = long_run(score, kernel, width, k)[0, 0]
    return theta, math.sqrt(lrv / np.mean(xi[main] ** 2) ** 2 / n), slope
