"""Queries against their SQL on the smallest tables; BARLAB_FULL=1 runs every one."""

import os

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"
SAMPLE = [
    "flagship_label_mix", "w04_rolling_corr", "w07_forward_pctrank_hourly", "w09_triple_barrier", "s01_list_input_features",
    "c01_asof_cap", "c02_project_to_finer_grid", "d01_load_dataset", "p12_split_chronological", "w17_generate_folds",
    "c09_fold_range_join", "g01_binary_metrics", "g04_eval_multiclass", "g07_calibration_bins", "g10_per_fold_saved_vs_own",
    "g13_cost_regime_metrics", "g17_sharpe_moments", "g31_label_leakage_pearson", "g35_data_fingerprint", "g47_meta_features",
    "k02_top_k_trials", "p20_flatten_oof", "s16_flatten_run_metrics", "v17_route_and_verdict",
]
NAMES = list(entry.oracle_sql()) if os.environ.get("BARLAB_FULL") else SAMPLE

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, name):
    ok, note = compare(spark, connect(SF), entry.queries()[name], entry.oracle_sql()[name], SF)
    assert ok, note
