"""Whole runs against the review of each paper in plain Python; the ledger; what a model says beyond what it is asked."""

import json
import random
from zlib import crc32

import pytest
from plain_review import CRITERIA, DIMENSIONS, PlainReview
from pyspark.sql import functions as F

from marginalia.operators import ranking, selection
from marginalia.plans.review import Reviewer
from marginalia.sources.backends import StubBackend, calls
from marginalia.sources.store import Ledger, StageStore


class Talkative(StubBackend):
    """Says more than it is asked, in an order of its own, with names that the workflow uses too; also undeclared dimensions."""

    def complete(self, stage, model, system, user, json_object):
        reply = super().complete(stage, model, system, user, json_object)
        h = crc32(f"{stage}{user}".encode())
        if stage in ("generation", "revision"):
            own = json.loads(reply)
            dimension = "elsewhere" if h % 5 == 0 else own["dimension"]
            return json.dumps({"severity": ["grave", h % 3], "text": own["text"] + ' "ü" \\ \n🙂', **({"composite": "mine"} if h % 4 == 0 else {}), "dimension": dimension, "id": -7}, ensure_ascii=bool(h % 2))
        if stage == "critique":
            own = json.loads(reply)
            return json.dumps({"mood": None, "critique_text": own["critique_text"] and own["critique_text"] + " — é\t'{paper}'", "original_id": 0})
        return reply


def papers_of(spark, n):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").limit(n)
    return [(f"paper-{r['doc_id']}", r["text"]) for r in docs.collect() if r["text"].strip()]


@pytest.mark.parametrize("backend, n, top_k", [(StubBackend(), 50, 5), (Talkative(), 8, 2), (Talkative(), 3, 0)])
def test_whole_review_equals_plain_python(spark, backend, n, top_k):
    rows = papers_of(spark, n)
    done = Reviewer(spark, backend).review(spark.createDataFrame(rows, "paper_id string, paper_text string"), top_k=top_k)
    reports = {r["paper_id"]: r["meta_review"] for r in done.meta_review.collect()}
    called = {r["paper_id"]: r["calls"] for r in done.calls.collect()}
    totals = {r["paper_id"]: r for r in done.cost_total.collect()}
    stages, ranked, members = {}, {}, {}
    for r in done.stage_costs.orderBy("paper_id", "stage_pos").collect():
        stages.setdefault(r["paper_id"], {})[r["stage"]] = (r["model"], r["prompt_tokens"], r["completion_tokens"], r["cost_usd"])
    for r in done.selection.ranked.orderBy("paper_id", "rk").collect():
        ranked.setdefault(r["paper_id"], []).append(r)
    for r in done.selection.dimension_members.orderBy("paper_id", "dimension_pos", "place").collect():
        members.setdefault(r["paper_id"], {}).setdefault(r["dimension"], []).append(r["id"])
    assert len(reports) == len(rows)
    for name, text in rows:
        plain = PlainReview(backend, text, top_k=top_k).run()
        own, chosen = ranked[name], plain.selection
        assert [(r["id"], r["text"], r["composite"], *(r[k] for k in CRITERIA)) for r in own] == [(p["id"], p["text"], p["composite"], *(p[k] for k in CRITERIA)) for p in chosen["sorted"]]
        assert [r["id"] for r in own if r["low_value"]] == chosen["low_ids"]
        high = [r for r in own if r["high_quality"]]
        assert [r["id"] for r in high] == [p["id"] for p in chosen["high"]]
        assert [r["rk_hq"] for r in high] == list(range(1, len(high) + 1))
        assert [r["id"] for r in sorted(high, key=lambda r: r["rk_uniq"])] == [p["id"] for p in chosen["unique"]]
        assert {d: members.get(name, {}).get(d, []) for d in DIMENSIONS} == {d: [p["id"] for p in x] for d, x in chosen["by_dimension"].items()}
        assert reports[name] == plain.report  # the stub's report is a hash of the whole prompt
        assert stages[name] == plain.stages
        assert (totals[name]["total_prompt_tokens"], totals[name]["total_completion_tokens"], totals[name]["total_cost_usd"]) == plain.total
        assert called[name] == plain.calls


def test_all_that_a_model_says_reaches_critic_and_result(spark, tmp_path):
    class Heard(Talkative):
        def complete(self, stage, model, system, user, json_object):
            if stage == "critique":
                (tmp_path / f"{crc32(user.encode())}").write_text(user)
            return super().complete(stage, model, system, user, json_object)

    done = Reviewer(spark, Heard()).review(spark.createDataFrame([("p", "A paper.")], "paper_id string, paper_text string"))
    asked = [f.read_text() for f in tmp_path.iterdir()]
    assert asked and all('{"severity":["grave",' in x for x in asked)
    for r in done.selection.high_quality.collect():
        assert json.loads(r["extra"]["severity"])[0] == "grave"
        record = json.loads(r["record"])
        assert record["id"] == r["id"] and record["persona"] == r["persona"] and record["severity"][0] == "grave"


class Dying(StubBackend):
    """Leaves a file for each call, and dies at one of them the first time."""

    def __init__(self, folder, at):
        self.folder, self.at = str(folder), at

    def complete(self, stage, model, system, user, json_object):
        import os
        import uuid

        n = len(os.listdir(self.folder))
        open(f"{self.folder}/{crc32(user.encode())}-{uuid.uuid4().hex}", "w").close()
        if n == self.at:
            raise RuntimeError("killed")
        return super().complete(stage, model, system, user, json_object)


def test_a_task_that_dies_amid_its_calls_repeats_none_that_was_answered(spark, tmp_path):
    import asyncio  # noqa: F401
    import pandas as pd

    (tmp_path / "calls").mkdir()
    ledger = Ledger(str(tmp_path / "ledger"))
    batch = pd.DataFrame({"id": range(20), "model": "m", "system": "s", "user": [f"u{i}" for i in range(20)], "prompt_hash": [f"{i:064x}" for i in range(20)]})
    run = calls(Dying(tmp_path / "calls", 12), "critique", at_once=1, ledger=ledger)
    with pytest.raises(RuntimeError, match="killed"):
        list(run([batch]))
    again = pd.concat(run([batch]))
    assert list(again["raw_response"]) == [StubBackend().complete("critique", "m", "s", f"u{i}", True) for i in range(20)]
    asked = [f.name.split("-")[0] for f in (tmp_path / "calls").iterdir()]
    assert len(asked) == 21 and len(set(asked)) == 20  # only the call that had no answer was repeated
    ledger.drop()
    assert ledger.get(f"{3:064x}") is None


def test_ledgers_go_when_their_stage_is_written(spark, tmp_path):
    store = StageStore(spark, str(tmp_path / "stages"))
    Reviewer(spark, store=store).review(spark.createDataFrame([("p", "A paper.")], "paper_id string, paper_text string"))
    assert not [f for f in (tmp_path / "stages").iterdir() if f.name.endswith("-ledger")]


def test_places_within_one_huge_key(spark):
    rng = random.Random(3)
    rows = [(None if i % 10 == 9 else "one" if i % 10 else f"k{i % 30}", rng.randrange(20), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, v int, i int").repartition(7)
    got = ranking.running(df, ["k"], [F.desc("v"), F.asc("i")], place=F.lit(1), odd=F.col("i") % 2 == 1)
    assert got.columns == ["k", "v", "i", "place", "odd"]
    want = {}
    for k in {r[0] for r in rows}:
        seen = 0
        for place, r in enumerate(sorted((r for r in rows if r[0] == k), key=lambda r: (-r[1], r[2])), 1):
            seen += r[2] % 2
            want[r[2]] = (place, seen)
    assert {r["i"]: (r["place"], r["odd"]) for r in got.collect()} == want
    assert ranking.numbered(df.limit(0), ["k"], [F.asc("i")], "n").count() == 0


def test_no_window_over_a_whole_paper(spark):
    """Every window of a ranking is parted by range as well, and each range is a fraction of the paper."""
    scored = spark.range(4000).select(F.lit("p").alias("paper_id"), F.col("id").alias("pos"), "id", F.lit("contribution").alias("dimension"), *((F.col("id") % n + 1.0).alias(c) for n, c in zip((5, 3, 4, 2), CRITERIA)))
    scored = scored.withColumn("composite", F.col("importance") + F.col("uniqueness"))
    ranked = selection.ranked(scored)
    plan = ranked._jdf.queryExecution().toString()
    windows = [x for x in plan.split("\n") if "row_number" in x or "Window [" in x]
    assert windows and all("_range" in x for x in windows)
    assert sorted(r["rk"] for r in ranked.select("rk").collect()) == list(range(1, 4001))
