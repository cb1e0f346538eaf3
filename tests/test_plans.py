"""Plans: no nested loops or products, and filters and columns reach the scan."""

import os

import pytest

from trackmill.plans import catalog

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")


@pytest.mark.parametrize("name", sorted(n for n in catalog.QUERIES if not n.startswith("stream_")))
def test_no_products(spark, name):
    plan = catalog.QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_pushdown(spark, capsys):
    catalog.QUERIES["region_filter"](spark, SMALL).explain("formatted")
    plan = capsys.readouterr().out
    assert "GreaterThanOrEqual(l_extendedprice,20000.0)" in plan and "In(l_returnflag" in plan
    assert "ReadSchema: struct<l_suppkey:bigint,l_quantity:double,l_extendedprice:double,l_returnflag:string>" in plan
