"""Registered queries against their SQL. Set ORACLE_ALL=1 for every query, ORACLE_SF for another size."""

import os

import pytest

import __spark_entry__ as entry
from check import compare, connect

SF = os.environ.get("ORACLE_SF", "0.001")
SF_DIR = f"/root/testdata/sf{SF}"
# One or two of each family; the whole set runs with ORACLE_ALL=1 or tests/check.py.
SAMPLE = [
    "user_day_features", "merged_partial_features", "domain_manifest", "evaluability", "uniform_sample", "sampling_audit",
    "multiset_difference", "interval_label_join", "principal_attribution", "chronological_event_split",
    "user_disjoint_split", "validation_tail", "feature_parity", "edge_stream", "user_day_metrics", "event_metrics",
    "transfer_grid", "seed_bootstrap_intervals", "paired_model_delta", "gap_evaluable_targets", "missing_cells",
    "wilcoxon_over_cells", "context_windows", "token_sequences", "sequence_surprise", "memory_profiles",
    "cert_releases_from_files", "auth_from_files", "telemetry_events", "exercise_events", "result_log_rows",
    "linear_domain_gap", "attribution_agreement", "streamed_user_days", "streamed_deviation",
]
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
NAMES = sorted(ORACLES) if os.environ.get("ORACLE_ALL") else SAMPLE


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, name):
    ok, info = compare(spark, con, SF_DIR, name, QUERIES[name], ORACLES[name])
    assert ok, info


def test_entry_runs(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
