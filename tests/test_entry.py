import os

import pytest

import __spark_entry__ as contract

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
def test_entry_is_the_history_list(spark):
    out = contract.entry(spark)
    assert out.columns == ["id", "public_id", "status", "avg_confidence", "created_at", "preview", "documentation_title"]
    rows = out.collect()
    assert len(rows) == 50 and [r.created_at for r in rows] == sorted((r.created_at for r in rows), reverse=True)


def test_oracles_belong_to_queries():
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
def test_scans_read_only_what_they_need(spark):
    plan = contract.queries()["visible_semi"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "l_quantity" not in plan and "LeftSemi" in plan and "PushedFilters" in plan
