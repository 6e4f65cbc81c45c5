"""Registered queries beside their SQL on the smallest tables, whole and with keys cut into blocks."""

import pytest

import check
import __spark_entry__ as entry
from gatherline.plans import catalog

SF = "/root/testdata/sf0.001"
ORACLES = catalog.ORACLES
# Python workers are allowed in these only
PYTHON_OK = {"viterbi_smooth", "hidden_states", "hidden_states_audit", "state_stability", "logo_ridge_scores", "logo_ridge_predictions", "permutation_test", "ablation_grid", "knn_impute", "mann_whitney", "paired_contrasts",
             "signal_peaks", "signal_peaks_mad", "scr_rate", "bootstrap_mean", "group_bootstrap_r2", "crosswalk_blocks", "crosswalk_outcomes", "matched_agreement", "window_apply"}
EAGER = {"principal_components", "kmeans_sweep", "gaussian_mixture", "hidden_states", "hidden_states_audit", "state_number", "state_stability", "logo_logistic"}


@pytest.fixture(scope="module")
def con():
    return check.connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, con, name):
    assert check.compare(entry.queries()[name](spark, SF), con, ORACLES[name]) is None


SPLIT = [
    "task_signal_summary", "flag_runs", "fixations", "gap_fill", "jump_rejection", "jump_rejection_points", "signal_peaks", "signal_peaks_mad", "nearest_sample", "covered_by_others",
    "share_and_rank", "robust_z", "gini", "spearman_table", "fdr_q_values", "describe", "viterbi_smooth", "speaker_lexicon", "clock_quality",
]


@pytest.mark.parametrize("name", SPLIT)
def test_same_as_sql_when_keys_are_split(spark, con, name, monkeypatch):
    from gatherline.operators import chains, hmm, ordered, windows

    monkeypatch.setattr(ordered, "ROWS_PER_BLOCK", 25)
    monkeypatch.setattr(windows, "FRAME_BLOCK", 25)
    monkeypatch.setattr(windows, "PEAK_BLOCK", 25)
    monkeypatch.setattr(chains, "BLOCK_ROWS", 25)
    monkeypatch.setattr(hmm, "BLOCK_ROWS", 25)
    monkeypatch.setattr(ordered, "RANK_ERROR", 0.02)
    assert check.compare(entry.queries()[name](spark, SF), con, ORACLES[name]) is None


def test_plans(spark):
    for name, fn in catalog.QUERIES.items():
        if name in EAGER or name.startswith("stream_"):
            continue
        plan = fn(spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan, name
        assert "BroadcastNestedLoopJoin" not in plan, name
        if name not in PYTHON_OK:
            assert not any(k in plan for k in ("ArrowEvalPython", "BatchEvalPython", "InPandas")), name
