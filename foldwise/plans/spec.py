"""Options that travel through an analysis."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Design:
    """How the estimation sample is built from raw series."""

    time_col: str
    outcome: str
    policy: str
    codes: dict[str, int]
    fast: tuple[str, ...] = ()
    keys: tuple[str, ...] = ()
    lags: int = 1
    horizons: int = 0
    n_blocks: int = 6
    start: str | None = None
    end: str | None = None
    scaling: str = "none"
    scale_outcome_policy: bool = False
    constant: bool = True
    minmax_range: tuple[float, float] = (-1.0, 1.0)
    to_fast: tuple[str, ...] = ()
    remove: tuple[str, ...] = ()


@dataclass(frozen=True)
class Learner:
    """A linear learner of one equation; ``kind`` is ols, lasso, ridge or elastic."""

    kind: str = "ols"
    penalty: float = 0.0
    l1_share: float = 1.0


@dataclass(frozen=True)
class TreeLearner:
    """A regression tree on binned features; more ``rounds`` boost it, each at ``rate``."""

    depth: int = 2
    rounds: int = 1
    rate: float = 1.0
    min_rows: int = 5


@dataclass(frozen=True)
class Inference:
    """Stage-two estimator and its standard error.

    With the rule ``small`` and no value, the static effect uses the default
    bandwidth of the kernel, and local projections use ``h + 1``.
    """

    method: str = "block"
    intercept: bool = True
    hac: bool = True
    kernel: str = "bartlett"
    rule: str = "small"
    value: int | None = None
    se: str = "stacked_hac"
    level: float = 0.95
    fixed_b: bool = False
    lag: int | None = None
