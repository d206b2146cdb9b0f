"""Registered queries: contract, a DuckDB comparison of a cross-section, plan shape, skew."""

import os
import sys

import pytest
from conftest import SF

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tools")]

import __spark_entry__ as contract  # noqa: E402
import check_oracle  # noqa: E402

from pressgauge.operators import scope  # noqa: E402
from pressgauge.workload import gold_queries, registry, tables  # noqa: E402

ROWS_ONLY = {"s11_s12_x24_article_text"}
CROSS_SECTION = [
    "a2_a3_w5_w6_subject_trend", "a7_w7_source_contribution", "a6_subject_window",
    "j3_w4_record_latest", "q10_j10_u3_l8_compare_versions", "s8_x19_feed_articles",
    "s9_search_articles", "b1_bronze_items", "x12_x15_reply_judgement", "f2_f3_model_analyses",
    "k2_t1_replaced_cycles", "k9_pruned_orphans", "t7_s14_call_files", "q6_a21_spikes",
    "q1_l2_w9_j15_dashboard_top", "e2_weighted_tone",
]


@pytest.fixture(scope="module")
def duck():
    return check_oracle.duck(SF)


def test_every_query_has_its_twin():
    assert set(registry.queries()) - set(registry.oracle_sql()) == ROWS_ONLY
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", CROSS_SECTION)
def test_spark_equals_duckdb(spark, duck, name):
    assert check_oracle.compare(spark, duck, name, SF) == ""


def plan_of(df):
    query = df._jdf.queryExecution()
    explain = df.sparkSession._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString
    return explain(query, "formatted")


def test_folds_stay_out_of_python_and_prune_columns(spark):
    plan = plan_of(gold_queries.QUERIES["a2_a3_w5_w6_subject_trend"](spark, SF))
    assert "Python" not in plan and "Pandas" not in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    # Newest-observation windows are cut to one row per group before their shuffle.
    assert plan.count("WindowGroupLimit") >= 4
    assert "sha2(" not in plan


def test_time_bound_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "items")
    tables.observations(spark, SF).write.parquet(path)
    rows = scope.in_scope(spark.read.parquet(path), "KR", since="2024-01-20T00:00:00Z")
    plan = plan_of(rows)
    assert "GreaterThanOrEqual(collected_at,2024-01-17)" in plan
    assert "EqualTo(axis,KR)" in plan
