"""What the plans must and must not hold."""

import contextlib
import io
import os

import pytest

from gridloom.llm.queries import queries
from tests import oracle

pytestmark = pytest.mark.skipif(not os.path.isdir(oracle.SMALLEST), reason="no test tables here")


def explained(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.mark.parametrize("name", sorted(queries.plans))
def test_no_cross_join(spark, name):
    plan = explained(queries.plans[name](spark, oracle.SMALLEST))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_candidates_read_what_they_need(spark):
    plan = explained(queries.plans["p1_found"](spark, oracle.SMALLEST))
    assert "ReadSchema: struct<query_index:bigint,candidate_sheet_ids:array<string>,candidate_scores:array<double>,status:string>" in plan
    assert plan.count("WindowGroupLimit") >= 2


def test_texts_are_read_once_with_their_id_only(spark):
    plan = explained(queries.plans["p7_ids"](spark, oracle.SMALLEST))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan and "Exchange" not in plan
