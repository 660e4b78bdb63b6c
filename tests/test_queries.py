"""Registered queries against their SQL twins on the smallest test tables."""

import os

import pytest

from harness import compare, connect
from labelloom.plans import registry

registry.load()
PATH = "/root/testdata/sf0.001"
# Some per family; `python tests/harness.py <folder>` runs all of them.
NAMES = ["greedy_match_truth", "fidelity", "reliability", "peer_consensus", "geometry_audit", "cluster_boxes", "fuse_labels",
         "fuse_labels_without", "assemble_items", "assemble_items_fallback", "union_area", "nms", "validate_annotations",
         "validate_selected", "gate_submissions", "export_schema_check", "compose_rewards", "cap_weights", "process_weights", "hamilton",
         "ema_stream", "budget_breaker", "near_duplicates", "epoch_plan", "cluster_points", "class_prf", "round_metrics", "scrub_feedback",
         "response_window_streams", "identity_reset_stream", "expired_objects", "reward_row_gate", "assemble_selected", "selected_objects",
         "calibration", "stale_files", "golden_leaks", "merge_labels", "next_untried", "polygon_measures"]


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(PATH):
        pytest.skip("test tables not there")
    return connect(PATH)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    ok, note = compare(spark, con, name, registry.QUERIES[name], registry.ORACLES[name], PATH)
    assert ok, note


def test_registry_is_consistent():
    assert set(registry.ORACLES) <= set(registry.QUERIES)
