"""Every llm query on the smallest tables, against its SQL where it has one."""

import os

import pytest

from gridloom.llm.queries import queries
from tests import oracle

pytestmark = pytest.mark.skipif(not os.path.isdir(oracle.SMALLEST), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(queries.plans))
def test_query(spark, name):
    found = oracle.rows_of(queries.plans[name](spark, oracle.SMALLEST))
    if name in queries.sql:
        assert found == oracle.rows_of_sql(oracle.connected(), queries.sql[name])
    else:
        assert found[1]
