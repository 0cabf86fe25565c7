"""Plan checks: what must reach the scan, and what must never appear."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def plan(spark, name: str) -> str:
    return entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["query_images", "query_patients", "cascade_delete", "series_type_classify", "tag_filter_combined",
                                  "anon_key_match", "deid_attributes", "forwarding_finalize", "outgoing_create"])
def test_no_pairing_of_all_rows(spark, name):
    text = plan(spark, name)
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF"):
        assert bad not in text


def test_rank_filter_limits_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan(spark, "next_outgoing")


def test_pages_are_top_k(spark):
    text = plan(spark, "flat_series_ordered")
    assert "TakeOrderedAndProject" in text
    assert "rangepartitioning" not in text


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(spark, "series_for_study")
    assert "EqualTo(o_custkey,11)" in text
    text = plan(spark, "forwarding_match")
    assert "props" not in text


def test_standalone_elements_are_not_shuffled(spark):
    """The bulk of the rows of a forced run: no exchange keyed by image beyond the per-image part."""
    text = plan(spark, "deid_remove")
    assert "hashpartitioning(image_id" not in text


@pytest.mark.parametrize(
    ("name", "scans", "exchanges"),
    [("tag_blacklist", 1, 3), ("tag_whitelist", 1, 3), ("tag_filter_combined", 1, 3), ("extract_levels", 2, 4), ("image_information", 1, 4),
     ("flat_series", 0, 3), ("incoming_progress", 0, 15), ("next_outgoing", 0, 6), ("anon_key_match", 1, 12), ("anon_key_match_reverse", 1, 12)],
)
def test_tables_are_read_and_shuffled_no_more_than_needed(spark, name, scans, exchanges):
    text = plan(spark, name)
    assert text.count("lineitem.parquet") <= scans
    assert text.count("Exchange hashpartitioning") <= exchanges


@pytest.mark.parametrize("name", ["tag_blacklist", "tag_whitelist", "tag_filter_combined"])
def test_elements_are_not_shuffled_to_find_their_source(spark, name):
    assert "hashpartitioning(image_id" not in plan(spark, name)
