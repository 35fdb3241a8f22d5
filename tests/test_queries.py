"""Registered queries against their SQL twins on the smallest data.

The default run takes one query of each family; ``ALL_QUERIES=1`` takes every one.
"""

import os

import pytest

import __spark_entry__ as entry
from tests.verify import compare, connect

SF_DIR = "/root/testdata/sf0.001"
SOME = [
    "A7_latest_valid_lab", "J6_window_study", "A3_icu_vitals_oldest_in_window", "A5_source_priority",
    "A6_condition_flags", "J2_manifest", "J3_rejections", "T1_section_extraction", "T2_text_cleaning",
    "L1_label_normalization", "L4_label_reconciliation", "L10_finding_votes", "C4_canonical_contains",
    "C7_canonical_labs", "C12_sentinel_labs", "W3_patient_split", "W8_epoch_mix", "W10_row_weights",
    "Q3_lab_issues", "V2_parse_object", "V5_rouge", "V7_bleu", "V8_micro_scores", "S7_eval_manifest",
    "S4_map_document", "W12_weighted_draws", "W13_batches", "L7_icd_classes", "C20_full_pass_records",
]
NAMES = list(entry.queries()) if os.environ.get("ALL_QUERIES") else SOME


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, duck, name):
    problem, rows = compare(spark, duck, name, entry.queries()[name], entry.oracle_sql().get(name), SF_DIR)
    assert problem is None
    assert rows > 0


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
