"""Registered queries beside their SQL on the smallest tables.

``FOLDWISE_ALL=1`` runs every query; the default is one of each family.
"""

import os

import pytest

import __spark_entry__ as entry
from compare import connect, differences

SF = "/root/testdata/sf0.001"
FEW = ["static_effect_weekly", "design_weekly", "transform_codes_weekly", "trend_ratio_weekly", "scale_robust_users", "calendar_gaps_users",
       "central_fold_residuals_events", "stability_select_s3", "error_profile_events", "lrv_ewc_users", "stage2_users", "irf_cumulative_events",
       "boundary_leakage_events", "compare_estimates_events", "ols_residuals_level_shift", "stage2_constant_fold_long",
       "stage2_missing_residuals", "stage2_chunks_qs", "lrv_chunks_ewc", "lrv_ewc_many_terms", "tree_panel_users", "tuned_library_weekly", "many_controls_events", "diagnose_events", "lrv_parzen_long", "read_metadata_dirty", "calendar_gaps_bulk_days"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(entry.queries()) if os.environ.get("FOLDWISE_ALL") else FEW)
def test_query(spark, name):
    n, why = differences(spark, connect(SF), name, entry.queries()[name], SF, entry.oracle_sql().get(name))
    assert n > 0 and not why, why


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_entry(spark):
    assert entry.entry(spark).count() == 1


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
