"""Every query of the core against its SQL, on the smallest tables."""

import os

import pytest

from gridloom.plans import catalog
from tests import oracle

PLANS = {n: p for r in catalog.registries() for n, p in r.plans.items()}
SQL = {n: s for r in catalog.registries() for n, s in r.sql.items()}
pytestmark = pytest.mark.skipif(not os.path.isdir(oracle.SMALLEST), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    return oracle.connected()


@pytest.mark.parametrize("name", sorted(PLANS))
def test_query(spark, con, name):
    found = oracle.rows_of(PLANS[name](spark, oracle.SMALLEST))
    if name in SQL:
        assert found == oracle.rows_of_sql(con, SQL[name])
    else:
        assert found[1]


def test_entry_runs_without_the_llm_subpackage(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns
    assert set(PLANS) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
