"""Registered queries beside their SQL on the smallest tables (CASEMETER_ALL=1 runs every one)."""

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

import __spark_entry__ as entry  # noqa: E402
from compare import compare, duck  # noqa: E402

SF = "/root/testdata/sf0.001"
NEEDS_MORE_HOURS = ("sp13_", "sp14_", "sp15_", "ts4_", "ts5_", "ts6_")
CHOSEN = (
    "flagship_text_length", "dd1_conflict_removal", "dd2_priority_dedup", "j1_exact_offsets", "j5_snapshot_match", "sp2_stratified_cap",
    "sp6_development_split", "fe1_word_tfidf", "fe3_chi_square", "me4_macro_f1", "me12_calibration_error", "me18_pair_breakdown",
    "de1_threshold_selection", "st5_cluster_bootstrap", "st9_empty_interval", "rp3_score_panel", "rp5_average_rank", "in4_split_verification",
    "sc2_response_validation", "sc6_first_over_budget", "ep4_episode_latency", "ml7_knn_vote", "ml13_hard_vote", "ss4_episode_sessions_batch",
    "ss3_first_answers_stream", "io5_read_json_lines", "flagship_text_classifier", "fe4_svd_certificate", "fe6_feature_union", "fe14_representation_routing",
    "ml8_multinomial_naive_bayes", "ml9_boosted_trees", "ml10_early_stopping", "ml6_randomised_forest",
)
NAMES = list(entry.queries()) if os.environ.get("CASEMETER_ALL") else CHOSEN


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", [n for n in NAMES if not n.startswith(NEEDS_MORE_HOURS)])
def test_query(spark, con, name):
    ok, message, *_ = compare(spark, con, SF, name)
    assert ok, message


def test_too_few_hours_is_an_error(spark):
    with pytest.raises(ValueError, match="too small"):
        entry.queries()["sp13_forward_windows"](spark, SF)


def test_every_check_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 190


def test_entry(spark):
    assert entry.entry(spark).count() == 2
