"""What the plans must and must not hold."""

import contextlib
import io
import os

import pytest

from gridloom.plans import catalog
from tests import oracle

PLANS = {n: p for r in catalog.registries() for n, p in r.plans.items()}
pytestmark = pytest.mark.skipif(not os.path.isdir(oracle.SMALLEST), reason="no test tables here")


def explained(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.mark.parametrize("name", sorted(set(PLANS) - {"stream_job_updates"}))
def test_no_cross_join(spark, name):
    plan = explained(PLANS[name](spark, oracle.SMALLEST))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_scans_read_what_they_need(spark):
    plan = explained(PLANS["token_usage"](spark, oracle.SMALLEST))
    assert "ReadSchema: struct<status:string,prompt_tokens:bigint,output_tokens:bigint,latency_seconds:double>" in plan
    plan = explained(PLANS["latency_summary"](spark, oracle.SMALLEST))
    assert "PushedFilters: [IsNotNull(latency_seconds)]" in plan and "candidate_sheet_ids" not in plan


def test_ranks_are_limited_before_the_shuffle(spark):
    plan = explained(PLANS["topk_dot"](spark, oracle.SMALLEST))
    assert plan.count("WindowGroupLimit") >= 2
