"""Proposals of one paper aren't brought to one task to meet it, and its report's tokens are summed where they are."""

import pytest

from marginalia.plans import review_queries


@pytest.mark.parametrize("name", ["stage_cost", "cost_total", "stage_cost_reviewed"])
def test_the_paper_goes_to_its_proposals(spark, name):
    plan = review_queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("rightHint=(strategy=broadcast)") >= 2
    assert "array_join" not in plan
