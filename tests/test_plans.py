"""Plan checks: no nested-loop or cartesian joins anywhere; filters reach the scans."""

import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
JOIN_HEAVY = ["J3_missing_version", "J6_version_diffs", "A7_version_summary", "J1_ids_with_feature_value",
              "J2_features_of_entity", "S8_insert_if_absent", "S12_cascade_delete", "S9_upsert", "W1_latest_result",
              "J9_near_duplicates", "J4_similar_candidates", "J10_duplicate_members", "S6_append_with_ids",
              "W3_gap_per_user", "A5_frontend_count_by_ids"]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", JOIN_HEAVY)
def test_no_nested_loop_or_cartesian(spark, name):
    plan = plan_of(E.queries()[name](spark, SF))
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan


@pytest.mark.parametrize("name,needle", [
    ("F5_results_for_version", "(o_orderpriority = 1-URGENT)"),
    ("F3_metadata_filter", "(lang = en)"),
    ("J3_missing_version", "(o_orderpriority = 1-URGENT)"),
])
def test_filters_pushed_to_scan(spark, name, needle):
    plan = plan_of(E.queries()[name](spark, SF))
    scans = [ln for ln in plan.splitlines() if "FileScan parquet" in ln]
    assert any("PushedFilters" in ln and "EqualTo" in ln for ln in scans) or any(needle in ln for ln in scans)


def test_projection_pruned(spark):
    plan = plan_of(E.queries()["J3_missing_version"](spark, SF))
    scans = [ln for ln in plan.splitlines() if "orders.parquet" in ln]
    assert scans and all("o_totalprice" not in ln for ln in scans)
