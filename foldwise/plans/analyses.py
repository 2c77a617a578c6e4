"""Whole analyses on a prepared sample table (see ``operators.design``)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from foldwise.operators.crossfit import crossfit, lead_columns, learner_table
from foldwise.operators.gram import block_gram
from foldwise.operators.projections import local_projections
from foldwise.operators.stage2 import stage2
from foldwise.operators.storage import CHUNK_ROWS, materialize
from foldwise.operators.tuning import error_profile, select_candidates
from foldwise.plans.spec import Inference, Learner


@dataclass(frozen=True)
class Sample:
    """A sample table and the names its analysis needs."""

    rows: DataFrame
    features: tuple[str, ...]
    n_blocks: int
    keys: tuple[str, ...] = ()
    time_col: str = "ts"
    design: str = "rcf"
    chunk_rows: int = CHUNK_ROWS

    @property
    def horizons(self) -> int:
        return len(lead_columns(self.rows)) - 1

    def gram(self) -> DataFrame:
        """Block sums over features, policy and leads, in that order."""
        return block_gram(self.rows, [*self.features, "d", *lead_columns(self.rows)], self.keys, self.chunk_rows)

    def residuals(self, learners: DataFrame | None = None, outcome=Learner(), policy=Learner(),
                  gram: DataFrame | None = None) -> DataFrame:
        gram = self.gram() if gram is None else gram
        if learners is None:
            learners = learner_table(self.rows.sparkSession, self.n_blocks, outcome, policy)
        return crossfit(self.rows, gram, learners, self.features, self.n_blocks, self.design, self.keys,
                        self.time_col, self.chunk_rows)

    def tune(self, outcome_grid, policy_grid, rule: str = "goldilocks_zone", window: int = 3,
             gram: DataFrame | None = None, tune_design: str = "rcf") -> tuple[DataFrame, DataFrame]:
        """``(tuned, profile)``, both materialized.

        As published, candidates are validated on the one-sided split for every
        design; ``tune_design='nlo'`` uses the buffered one.
        """
        gram = self.gram() if gram is None else gram
        profile = materialize(error_profile(gram, outcome_grid, policy_grid, len(self.features), self.horizons,
                                            self.n_blocks, tune_design, self.keys))
        return materialize(select_candidates(profile, rule, window, self.keys)), profile


def static_effect(sample: Sample, spec: Inference = Inference(), outcome=Learner(), policy=Learner(),
                  learners: DataFrame | None = None) -> DataFrame:
    """The effect on the outcome of the same period."""
    resid = sample.residuals(learners, outcome, policy).withColumnRenamed("chi0", "chi")
    return stage2(resid, spec, sample.keys, sample.chunk_rows)


def tuned_effect(sample: Sample, outcome_grid, policy_grid, spec: Inference = Inference(),
                 rule: str = "goldilocks_zone", window: int = 3) -> DataFrame:
    """Tune both learners in each fold, refit on the whole training sample, estimate."""
    gram = sample.gram()
    tuned, _ = sample.tune(outcome_grid, policy_grid, rule, window, gram)
    resid = sample.residuals(tuned, gram=gram).withColumnRenamed("chi0", "chi")
    return stage2(resid, spec, sample.keys, sample.chunk_rows)


def impulse_response(sample: Sample, spec: Inference = Inference(), code: int | str | None = None, outcome=Learner(),
                     policy=Learner(), learners: DataFrame | None = None) -> DataFrame:
    """The effect on every lead; learners by horizon come as a learner table with a column ``h``."""
    return local_projections(sample.residuals(learners, outcome, policy), spec, code, sample.keys, sample.time_col,
                             sample.chunk_rows)
