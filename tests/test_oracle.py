"""Every query of the reference's operators against its SQL twin, on the smallest tables."""

import os

import pytest
from helpers import assert_same

from trackmill.plans import catalog

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query(spark, name):
    assert_same(catalog.QUERIES[name](spark, SMALL), SMALL, catalog.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_other_queries_run(spark, name):
    assert catalog.QUERIES[name](spark, SMALL).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
