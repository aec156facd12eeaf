"""What a review leaves on disk: its results, without personas, raw replies, scratch, checkpoints or shuffle files."""

import os
import time

from pyspark.sql import functions as F

from marginalia.functions.tokens import CharacterCounter
from marginalia.operators import cost
from marginalia.plans import paper_queries
from marginalia.plans import review_queries as R
from marginalia.plans.review import Reviewer
from marginalia.sources.store import StageStore

PAPERS = [(f"p{i}", f"Paper {i}. " + "It says much. " * i) for i in range(12)]


def shuffles(spark) -> set[str]:
    local = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirsString()
    return {f for top in local for _, _, names in os.walk(top) for f in names if f.startswith("shuffle_")}


def checkpoints(spark) -> set[str]:
    return {d for _, dirs, _ in os.walk(spark.conf.get("spark.checkpoint.dir")) for d in dirs if d.startswith("rdd-")}


def test_a_review_leaves_its_results_alone(spark):
    before, kept = shuffles(spark), checkpoints(spark)
    store = StageStore(spark)
    done = Reviewer(spark, store=store).review(spark.createDataFrame(PAPERS, "paper_id string, paper_text string"))
    names = {d.rpartition("-")[0] or d for d in os.listdir(store.root)}
    assert names == {"papers", "proposals", "scored", "ranked", "critiques", "revised", "re_scored", "reports", "costs"}
    assert not any("persona" in spark.read.parquet(f"{store.root}/{d}").columns for d in os.listdir(store.root))
    assert checkpoints(spark) <= kept
    for _ in range(50):  # they go beside the driver's work
        if shuffles(spark) <= before:
            break
        time.sleep(0.2)
    assert shuffles(spark) <= before
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
    assert {r["persona"] for r in done.selection.ranked.collect()} >= {paper_queries.V.EDITOR}


class Whole(CharacterCounter):
    """Counts whole prompts."""

    additive = False


def test_papers_counted_apart_give_the_tokens_of_whole_prompts(spark):
    papers = spark.createDataFrame([("a", "A paper.\n\n"), ("b", "  "), ("c", None), ("d", ""), ("alone", "x"), ("twice", "one"), ("twice", "other")], "paper_id string, paper_text string")
    rows = spark.range(24).select(F.element_at(F.array(*map(F.lit, ["a", "b", "c", "d", "twice", "none"])), (F.col("id") % 6 + 1).cast("int")).alias("paper_id"), F.col("id").alias("pos"), "id", F.when(F.col("id") % 5 > 0, "contribution").alias("dimension"), F.when(F.col("id") % 7 > 0, F.lit("text \n")).alias("text"), F.col("id").alias("n_chars"))
    first = R.scoring.scored(R._raw(rows, *R.ROUND_1)).withColumn("high_quality", F.col("id") % 3 > 0).withColumn("critique_text", F.when(F.col("id") % 4 > 0, F.when(F.col("id") % 4 > 1, "sharpen").otherwise("")))
    for merged in (None, first.where("id % 2 = 0").drop("critique_text")):
        apart, whole = (sorted(map(tuple, cost.stage_tokens(first, merged, papers, c).collect()), key=str) for c in (CharacterCounter(), Whole()))
        assert apart == whole and len(apart) == 5


def test_texts_of_papers_are_not_shuffled_to_be_counted(spark):
    """A paper's rows meet its size."""
    papers = spark.createDataFrame(PAPERS, "paper_id string, paper_text string")
    rows = R.scoring.scored(R._raw(papers.select("paper_id", F.lit(1).alias("pos"), F.lit(1).alias("id"), F.lit("contribution").alias("dimension"), F.lit("t").alias("text"), F.lit(9).alias("n_chars")), *R.ROUND_1))
    first = rows.withColumn("high_quality", F.lit(True)).withColumn("critique_text", F.lit("c"))
    plan = cost.stage_tokens(first, None, papers, CharacterCounter())._jdf.queryExecution().optimizedPlan()
    while "Join" not in plan.nodeName():
        plan = plan.children().apply(0)
    assert all("paper_text" not in plan.children().apply(k).output().toString() for k in range(2))


def test_rows_of_equal_paper_and_pos_do_not_multiply(spark):
    rows = R.scoring.scored(R._raw(spark.range(6).selectExpr("'p' AS paper_id", "id % 3 AS pos", "id % 3 AS id", "'contribution' AS dimension", "id AS n_chars"), *R.ROUND_1))
    assert Reviewer(spark)._ranked(rows).count() == 6
