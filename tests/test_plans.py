"""Physical-plan guards: no cartesian / nested-loop joins anywhere, per-group
limits for top-k, column pruning at the Parquet scan."""

import pytest

import __spark_entry__ as E

from .conftest import SF_SMALL

QUERIES = E.queries()


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cartesian_or_nested_loop(spark, name):
    p = plan(QUERIES[name](spark, SF_SMALL))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


@pytest.mark.parametrize("name", ["v10_score_fields_weighted", "j10_knn_join_sparse", "w1_rank_results"])
def test_topk_uses_group_limit(spark, name):
    assert "WindowGroupLimit" in plan(QUERIES[name](spark, SF_SMALL))


def test_scan_reads_only_needed_columns(spark):
    df = QUERIES["p1_sparse_search"](spark, SF_SMALL)
    scans = [line for line in df._jdf.queryExecution().executedPlan().toString().split("\n")
             if "FileScan parquet" in line and "documents" in line]
    assert scans
    for s in scans:
        assert "n_chars" not in s and "lang" not in s and "source" not in s


def test_filter_pushed_to_scan(spark):
    p = plan(QUERIES["f7_keep_clean"](spark, SF_SMALL))
    assert "PushedFilters: [IsNotNull(doc_id)" in p or "PushedFilters: [IsNotNull(" in p
