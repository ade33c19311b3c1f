"""A registered query of every family against its SQL; all of them: python -m workload.check."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as driver
from workload import QUERIES
from workload.check import difference, oracle

FOLDER = "/root/testdata/sf0.001"

FAMILIES = (
    "step_rename",
    "step_concat_columns",
    "step_split_column",
    "step_unpivot",
    "step_pivot_count",
    "step_pivot_sum",
    "step_if_then_else",
    "filter_not_in_remove",
    "filter_contains_clear",
    "filter_lte_keep",
    "step_fill_empty_text",
    "step_find_replace",
    "step_text_capitalize",
    "step_change_type_decimal",
    "step_parse_date_format",
    "step_extract_date_parts",
    "step_distinct_documents",
    "step_dedup_all",
    "window_dense_rank",
    "window_moving_avg",
    "window_few_groups_running_sum",
    "window_global_lag",
    "join_full",
    "join_star",
    "join_select_all",
    "group_filtered",
    "group_global",
    "stack_all",
    "stack_distinct",
    "sql_recipe",
    "chained_recipes",
    "preview_partial",
    "seed_csv",
    "inc_append",
    "inc_lookback",
    "inc_delete_insert_partitioned",
    "inc_merge_latest_per_key",
    "inc_group",
    "inc_join",
    "inc_microbatch_month",
    "inc_schema_sync_append",
    "stream_delete_insert",
    "test_suite",
    "freshness_late",
    "profile_quality_written_values",
    "profile_full_documents",
    "profile_delta_emptied",
    "join_diagnosis_chain",
    "join_findings",
)

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the test tables are absent")


@pytest.fixture(scope="module")
def connection():
    return oracle(FOLDER)


@pytest.mark.parametrize("name", FAMILIES)
def test_query_equals_its_sql(spark, connection, name):
    query = QUERIES[name]
    assert difference(query.run(spark, FOLDER), connection, query.sql) is None


def test_entry_points(spark):
    assert driver.entry(spark).count() > 0
    assert set(driver.oracle_sql()) <= set(driver.queries()) and len(driver.queries()) > 150
