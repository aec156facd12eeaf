"""A backend that answers for nothing needs neither threads nor a ledger, and papers are dealt to all tasks."""

import asyncio

import pandas as pd

from marginalia.plans.review import Reviewer
from marginalia.sources.backends import StubBackend, calls
from marginalia.sources.store import StageStore


def test_a_repeatable_backend_answers_in_place(monkeypatch):
    monkeypatch.setattr(asyncio, "run", None)
    batch = pd.DataFrame({"id": [1, 2], "model": "m", "system": "s", "user": ["a", "b"], "prompt_hash": ["x", "y"]})
    got = pd.concat(calls(StubBackend(), "critique")([batch]))
    assert list(got["raw_response"]) == [StubBackend().complete("critique", "m", "s", u, True) for u in "ab"]


def test_the_stub_keeps_no_ledger(spark):
    class Store:
        def ledger(self, stage):
            raise AssertionError("a ledger for the stub")

        def once(self, stage, requests, keys, run):
            return run(requests.selectExpr("*", "'' AS prompt_hash"))

    asked = spark.sql("SELECT 'p' AS paper_id, 'm' AS model, array(named_struct('content', 's'), named_struct('content', 'u')) AS messages")
    assert Reviewer(spark, store=Store())._ask("critique", "critique", asked, ["paper_id"]).count() == 1


def test_papers_are_dealt_to_all_tasks(spark, tmp_path):
    rows = spark.createDataFrame([(f"p{i}", f"Paper {i}.") for i in range(40)], "paper_id string, paper_text string").coalesce(1)
    Reviewer(spark, store=StageStore(spark, str(tmp_path))).review(rows, agents=8, top_k=0)
    (folder,) = tmp_path.glob("papers-*")
    assert len(list(folder.glob("part-*"))) == 4
