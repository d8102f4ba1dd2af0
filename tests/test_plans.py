"""Plan-shape checks: the properties the operators are designed around."""

import re

import pytest

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _entry():
    import __spark_entry__ as e
    return e


@pytest.mark.parametrize("name", sorted(_entry().queries()))
def test_no_cartesian_or_nested_loop_join(spark, name):
    df = _entry().queries()[name](spark, SF)
    plan = _plan(df)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_emergence_scan_is_pruned_and_single(spark):
    df = _entry().queries()["emerging_summary"](spark, SF)
    df.collect()
    final = _plan(df).split("== Initial Plan ==")[0]
    scans = [ln for ln in final.splitlines() if "FileScan parquet" in ln and "lineitem" in ln]
    assert len(scans) == 1
    assert "GreaterThanOrEqual(l_shipdate" in scans[0] and "LessThan(l_shipdate" in scans[0]
    assert "l_quantity" not in scans[0]  # column pruning: only the referenced columns


def test_emergence_ranks_no_product_rows_in_one_task(spark):
    df = _entry().queries()["emerging_summary"](spark, SF)
    df.collect()
    final = _plan(df).split("== Initial Plan ==")[0]
    single = re.findall(r"Exchange SinglePartition.*\n(.*)", final)
    assert len(single) == 2 and all("HashAggregate(keys=[_range#" in below for below in single)


def test_dedupe_is_partially_aggregated(spark):
    plan = _plan(_entry().queries()["dedupe_keep_first"](spark, SF))
    assert "partial_min" in plan and "Window" not in plan


def test_text_queries_never_read_text_for_counts(spark):
    plan = _plan(_entry().queries()["hierarchy_summary"](spark, SF))
    assert "documents" not in plan
    plan = _plan(_entry().queries()["window_volumes"](spark, SF))
    assert "p_type" not in plan.split("ReadSchema")[1] if "ReadSchema" in plan else True
