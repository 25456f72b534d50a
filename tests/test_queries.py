"""Every registered query against its SQL, on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from catalog.queries import QUERIES
from check import compare

SMALL = entry.SMALL
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="test tables are not there")


def test_every_query_has_sql():
    assert set(QUERIES) <= set(entry.oracle_sql())


def test_all_queries_match(spark):
    assert compare(spark, SMALL, list(QUERIES)) == 0


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_plans_have_no_python_workers(spark):
    for name in ("cell_classes_orders", "fix_normalize_dates", "fix_case_title", "rule_advice", "reply_advice"):
        plan = entry.queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "BatchEval" not in plan, name
