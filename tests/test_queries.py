"""Registered queries next to their SQL twins on the smallest tables; the split plans run on the same data."""

import os

import pytest

from tests.compare import compare, connect
from wearline.plans import ORACLES, QUERIES
from wearline.session import TASK_BYTES_KEY

FOLDER = "/root/testdata/sf0.001"
CHECKED = [
    "a12_fingerprint", "a13_describe", "b4_number_gaps", "b9_inspection_issues", "b12_duplicate_content", "c2_build_manifest", "d_time_features", "e1_welch_psd",
    "f8_scope_scores", "g8_robust_parameters", "h5_onset_rule", "i9_rank_candidates", "j7_model_comparison", "l10_wilcoxon", "m10_detections", "m17_trend_features", "n4_rate_censoring",
    "p2_kaplan_meier_by_condition", "q4_ipcw_concordance", "r2_online_alarms",
]
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", CHECKED)
def test_matches_sql(spark, con, name):
    assert compare(spark, con, QUERIES[name], ORACLES[name], FOLDER)[0] == ""


@pytest.mark.parametrize("name", ["a13_describe", "b4_number_gaps", "i2_weighted_median", "l13_holm", "m9_persistent_alarm", "q3_concordance"])
def test_split_plans_match_sql(spark, con, name):
    before = spark.conf.get(TASK_BYTES_KEY)
    spark.conf.set(TASK_BYTES_KEY, "0")
    try:
        assert compare(spark, con, QUERIES[name], ORACLES[name], FOLDER)[0] == ""
    finally:
        spark.conf.set(TASK_BYTES_KEY, before)


def test_every_twin_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
