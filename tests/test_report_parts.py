"""Python writes a report's JSON a proposal at a time, before lists are gathered."""

from pyspark.sql import functions as F

from marginalia.functions.tokens import CharacterCounter
from marginalia.operators import cost, selection
from marginalia.plans.review import Reviewer

ROWS = [("p", i, i, ("contribution", "interpretation", None)[i % 3], (None, 'a "é\n🙂', "b")[i % 3], *(float(1 + (i * k) % 5) for k in (1, 2, 3, 4)), i / 7) for i in range(1, 30)]


def _case(spark):
    rows = spark.createDataFrame(ROWS, "paper_id string, pos long, id long, dimension string, text string, importance double, specificity double, actionability double, uniqueness double, composite double")
    chosen = selection.select_and_classify(rows, 3)
    chosen.critiques = spark.createDataFrame([("p", 1, 5, "x é"), ("p", 0, 6, None)], "paper_id string, pos long, original_id long, critique_text string")
    return spark.createDataFrame([("p",), ("none",)], "paper_id string"), chosen


def test_no_python_over_gathered_lists(spark):
    papers, chosen = _case(spark)
    plan = Reviewer(spark).meta_requests(papers, chosen, 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" in plan and plan.index("collect_list") < plan.index("ArrowEvalPython")


def test_tokens_of_parts_are_those_of_the_prompt(spark):
    papers, chosen = _case(spark)
    review = Reviewer(spark)
    replies = papers.withColumn("meta_review", F.lit("A report."))
    built = cost.meta_tokens(review.meta_requests(papers, chosen, 3), replies, CharacterCounter())
    got = review.meta_tokens(papers, chosen, 3, replies)
    assert "collect_list" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(got.collect()) == sorted(built.collect())
