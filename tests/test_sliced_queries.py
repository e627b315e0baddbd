"""Queries that order inside groups, with groups cut into very small slices."""

import pytest
from compare import compare, duck

import __spark_entry__ as entry
from treeledger.operators.ordered import ordered

NAMES = (
    "exact_renames", "ingest_outcomes", "version_steps", "merge_renumber", "heal_sequence_collisions", "resolve_selectors", "timeline", "burst_dedup",
    "runs_of_change", "stable_signatures", "liveness_gaps", "activity_session", "budget_pack", "budget_fold", "tiered_budget", "manifest_roundtrip",
    "top_level_entries", "token_delta",
)


@pytest.mark.parametrize("name", NAMES)
def test_small_slices(spark, small_dir, monkeypatch, name):
    monkeypatch.setitem(ordered.__kwdefaults__, "target_rows", 3)
    ok, message = compare(spark, duck(small_dir), small_dir, name, entry.queries()[name], entry.oracle_sql()[name])
    assert ok, message
