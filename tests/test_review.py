"""The review workflow against plain Python written for these tests."""

import io
import itertools
import json

import pytest
from pyspark.sql import functions as F

from marginalia.functions import coercion
from marginalia.functions.text import money, spaced, strip
from marginalia.operators import cost, critique, prompts, scoring, selection
from marginalia.operators.workers import worker_assignments
from marginalia.plans import fixed_values as V
from marginalia.plans.review import Reviewer, feedback
from marginalia.sources import papers
from marginalia.sources.backends import StubBackend
from marginalia.sources.store import StageStore

SCORED = "paper_id string, pos long, id long, dimension string, text string, importance double, specificity double, actionability double, uniqueness double, composite double"


def rows_of(*scores, dimension="contribution"):
    out = []
    for i, (a, b, c, d) in enumerate(tuple(map(float, s)) for s in scores):
        out.append(("p", i, 100 - i, dimension, f"t{i}", a, b, c, d, 0.35 * a + 0.25 * b + 0.20 * c + 0.20 * d))
    return out


def test_composite_is_bit_exact(spark):
    halves = [1 + k / 2 for k in range(9)]
    tuples = list(itertools.product(halves, repeat=4))
    got = spark.createDataFrame(tuples, ", ".join(f"{c} double" for c in V.CRITERIA)).withColumn("x", scoring.composite()).collect()
    assert len(got) == 6561
    assert all(r["x"] == 0.35 * r[0] + 0.25 * r[1] + 0.20 * r[2] + 0.20 * r[3] for r in got)


def test_two_passes(spark):
    raw = spark.createDataFrame([("p", 1, 1, 5, 4, 3, 2), ("p", 1, 2, 2, 4, 4, 99)], "paper_id string, id int, pass int, importance int, specificity int, actionability int, uniqueness int")
    got = scoring.scored(scoring.side_by_side(raw, ["paper_id", "id"])).first()
    assert [got[c] for c in V.CRITERIA] == [3.5, 4.0, 3.5, 50.5]
    assert list(got["judge_disagreement"]) == [3, 0, 1, 97]


def test_workers(spark):
    got = worker_assignments(spark, 16).orderBy("id").collect()
    assert [r["id"] for r in got] == list(range(1, 17))
    assert [r["persona_name"][0] for r in got] == list("tttrrmme") * 2
    for bad in (0, -8, 7):
        with pytest.raises(ValueError, match="multiple of 8"):
            worker_assignments(spark, bad)


def test_selection_is_stable_and_keeps_unknown_dimensions(spark):
    data = rows_of((3, 3, 3, 3), (1, 1, 1, 1), (3, 3, 3, 3), (5, 1, 1, 4), dimension="elsewhere")
    got = selection.select_and_classify(spark.createDataFrame(data, SCORED), 2)
    assert [r["id"] for r in got.sorted_by_composite.orderBy("rk").collect()] == [100, 98, 97, 99]
    assert [r["id"] for r in got.top_proposals.orderBy("rk").collect()] == [100, 98]
    assert [r["id"] for r in got.high_quality.orderBy("rk").collect()] == [100, 98, 97]
    assert [r["id"] for r in got.high_quality.orderBy("rk_uniq").collect()] == [97, 100, 98]
    assert [r["id"] for r in got.low_value_ids.orderBy("rk").collect()] == [97, 99]
    lists = got.by_dimension.orderBy("dimension_pos").collect()
    assert [(r["dimension"], r["members"]) for r in lists] == [(d, []) for d in V.DIMENSIONS]
    with pytest.raises(ValueError):
        selection.select_and_classify(spark.createDataFrame(data, SCORED), -1)
    assert selection.select_and_classify(spark.createDataFrame(data, SCORED), 0).top_proposals.count() == 0


def test_empty_selection(spark):
    got = selection.select_and_classify(spark.createDataFrame([], SCORED), 5)
    assert got.ranked.count() == 0 and got.by_dimension.count() == 0


def test_last_critique_wins_and_null_ids_meet(spark):
    heard = spark.createDataFrame([("p", 0, 100, "old"), ("p", 1, 100, "new"), ("p", 2, None, "none")], "paper_id string, pos long, original_id long, critique_text string")
    data = spark.createDataFrame([*rows_of((3, 3, 3, 3), (4, 4, 4, 4)), ("p", 9, None, "contribution", "t", 3.0, 3.0, 3.0, 3.0, 3.0)], SCORED)
    high = selection.ranked(data)
    got = {r["id"]: r["critique_text"] for r in critique.with_critique(high, heard).collect()}
    assert got == {100: "new", None: "none"}
    first = critique.revise_candidates(high, heard, 1).collect()
    assert [(r["id"], r["revise_pos"]) for r in first] == [(100, 1)]


def test_merge_puts_revised_first(spark):
    high = selection.ranked(spark.createDataFrame(rows_of((5, 5, 5, 5), (4, 4, 4, 4), (3, 3, 3, 3)), SCORED)).where("high_quality")
    revised = spark.createDataFrame([("p", 1, 99, "contribution", "new", 1.0, 1.0, 1.0, 1.0, 1.0)], SCORED)
    got = critique.merged_rounds(revised, high).orderBy("pos").collect()
    assert [(r["id"], r["pos"]) for r in got] == [(99, 1), (100, 2), (98, 3)]


def test_strip_as_python_does(spark):
    cases = [" \t a b   ", "\x1c\x1fx\x1d", "", "\n", "a\n"]
    got = spark.createDataFrame([(c,) for c in cases], "x string").select(strip(F.col("x")).alias("y")).collect()
    assert [r["y"] for r in got] == [c.strip() for c in cases]


def test_prompts_are_filled_and_stripped(spark):
    df = spark.createDataFrame([("A {paper} 100% $1 \\1 é ", 7, None)], "paper string, id int, dimension string")
    user = df.select(prompts.generation_user(F.col("paper"), F.col("id")).alias("u")).first()["u"]
    assert user == V.GENERATION_PROMPT.replace("{id}", "7").replace("{paper}", "A {paper} 100% $1 \\1 é ")
    for number, order, context in V.PASSES:
        text = df.select(prompts.scoring_user_ordered(F.col("paper"), F.lit("T  "), F.col("dimension"), order, context).alias("u")).first()["u"]
        assert "(dimension = None)" in text and text == text.strip()
        assert [text.index(V.RUBRIC[k]) for k in order] == sorted(text.index(V.RUBRIC[k]) for k in order)
        assert (text.index("Paper text:") < text.index("Feedback proposal")) == (number == 1)
    system = df.select(prompts.generation_system(F.lit("")).alias("a"), prompts.generation_system(F.lit("P")).alias("b")).first()
    assert system["a"] == V.GENERATION_SYSTEM and system["b"] == V.GENERATION_SYSTEM + "\n\nP"


def test_json_forms():
    assert spaced('{"a":1.5,"b":["é",null]}') == json.dumps({"a": 1.5, "b": ["é", None]})


def test_money(spark):
    got = spark.createDataFrame([(0.12345,), (1234.5,), (None,)], "x double").select(money(F.col("x")).alias("y")).collect()
    assert [r["y"] for r in got] == ["$0.1235", "$1234.5000", "n/a"]


@pytest.mark.parametrize(("value", "expected"), [(4, 4), (4.7, 4), ("4", 4), (" 4 ", 4), (True, 1), (99, 99)])
def test_whole(value, expected):
    assert coercion.whole(value) == expected


@pytest.mark.parametrize(("reply", "fault"), [("not json", ValueError), ('{"importance": "4.7"}', ValueError), ('{"importance": null}', TypeError), ("{}", KeyError)])
def test_faulty_replies_fail(reply, fault):
    with pytest.raises(fault):
        coercion.scores(reply)


def test_last_of_equal_names_counts():
    assert coercion.parse_object('{"v":1,"v":2}') == {"v": 2}


def test_prices():
    assert cost.lookup_price("gpt-5") == (1.25 / 1e6, 10.0 / 1e6, 0.125 / 1e6)
    with pytest.raises(ValueError, match="not allowed"):
        cost.lookup_price("gpt-5 ")


class Counting(StubBackend):
    """Leaves a file for each call."""

    def __init__(self, folder):
        self.folder = str(folder)

    def complete(self, stage, model, system, user, json_object):
        import uuid

        open(f"{self.folder}/{stage}-{uuid.uuid4().hex}", "w").close()
        return super().complete(stage, model, system, user, json_object)


def test_review_makes_each_call_once(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    two = spark.createDataFrame([("a", "First paper."), ("b", "Second paper."), ("blank", " \n ")], "paper_id string, paper_text string")
    store = StageStore(spark, str(tmp_path / "stages"))
    done = Reviewer(spark, Counting(tmp_path / "calls"), store=store).review(two)
    expected = sum(r["calls"] for r in done.calls.collect())
    assert len(list((tmp_path / "calls").iterdir())) == expected
    assert {r["paper_id"] for r in done.meta_review.collect()} == {"a", "b"}
    totals = {r["paper_id"]: r for r in done.cost_total.collect()}
    for r in done.stage_costs.collect():
        assert r["total_tokens"] == r["prompt_tokens"] + r["completion_tokens"]
    assert all(t["total_cost_usd"] > 0 for t in totals.values())
    report = cost.format_cost(done.stage_costs).where("paper_id = 'a'").first()["report"].split("\n")
    assert [x.split(":")[0] for x in report][:3] == ["- generation", "- scoring", "- critiques"] and report[-1].startswith("- total")
    Reviewer(spark, Counting(tmp_path / "calls"), store=store).review(two)  # a second run asks nothing again
    assert len(list((tmp_path / "calls").iterdir())) == expected
    alone = spark.createDataFrame([("a", "First paper.")], "paper_id string, paper_text string")
    single = Reviewer(spark).review(alone)  # one paper alone: as among others
    pick = lambda d: sorted((r["id"], r["composite"]) for r in d.selection.high_quality.where("paper_id = 'a'").collect())
    assert pick(single) == pick(done)


def test_pipeline_stub_reviews_every_document(spark, tmp_path):
    from marginalia.plans.review_queries import pipeline_stub

    texts = {k: f"Paper number {k}." for k in range(1, 7)} | {9: "  "}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["paper_id"]: r for r in pipeline_stub(spark, str(tmp_path)).collect()}
    assert sorted(got) == [f"paper-{k}" for k in range(1, 7)]  # a blank paper is left out
    for k in (2, 6):  # each as if it were alone
        done = Reviewer(spark).review(spark.createDataFrame([(f"paper-{k}", texts[k])], "paper_id string, paper_text string"))
        own = done.meta_review.join(done.cost_total, "paper_id").join(done.calls, "paper_id").first()
        assert own == got[f"paper-{k}"]


def test_feedback(spark):
    assert feedback(spark, "A paper.").startswith("Meta-review")


class Broken(StubBackend):
    def complete(self, stage, model, system, user, json_object):
        return "not json"


def test_a_fault_fails_the_run(spark):
    with pytest.raises(Exception, match="JSONDecodeError|Expecting value"):
        Reviewer(spark, Broken()).review(papers.paper_from_text(spark, "A paper."))


def test_papers_from_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("x\r\ny\rz é".encode())
    (tmp_path / "b.txt").write_bytes(b"")
    got = {r["paper_id"]: r["paper_text"] for r in papers.papers_from_files(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": "x\ny\nz é", "b.txt": ""}
    (tmp_path / "c.txt").write_bytes(b"\xff\xfe")
    with pytest.raises(Exception, match="not UTF-8"):
        papers.papers_from_files(spark, str(tmp_path / "c.txt")).collect()
    assert papers.papers_from_files(spark, str(tmp_path / "c.txt"), strict=False).first()["paper_text"] == "��"


class Terminal(io.StringIO):
    def isatty(self):
        return True


def test_sources_in_order(tmp_path):
    (tmp_path / "paper.txt").write_text("from paper.txt")
    (tmp_path / "own.txt").write_text("own")
    assert papers.resolve(str(tmp_path / "own.txt"), io.StringIO("piped"), str(tmp_path)) == "own"
    assert papers.resolve(None, io.StringIO("piped"), str(tmp_path)) == "piped"
    assert papers.resolve(None, Terminal("typed"), str(tmp_path)) == "from paper.txt"
    (tmp_path / "paper.txt").unlink()
    assert papers.resolve(None, Terminal("a\nb\n ::END:: \nc\n"), str(tmp_path)) == "a\nb"


def test_command_line(spark, capsys):
    from marginalia.plans.cli import main

    assert main([], io.StringIO("  \n")) == 1
    assert main(["--agents", "7"], io.StringIO("A paper.")) == 1
    assert "Configuration Error" in capsys.readouterr().err
    with pytest.raises(SystemExit) as e:
        main(["--file", "x", "--paste"], io.StringIO(""))
    assert e.value.code == 2


def test_a_malformed_reply_ends_the_command_line(spark, capsys, monkeypatch, tmp_path):
    from marginalia.plans import cli

    (tmp_path / "paper.txt").write_text("A paper.")
    monkeypatch.setattr(cli, "StubBackend", Broken)
    assert cli.main(["--file", str(tmp_path / "paper.txt"), "--agents", "8"]) == 1
    assert "Configuration Error" in capsys.readouterr().err
    assert cli.value_fault("Traceback\nRuntimeError: no\n") is None
    assert cli.value_fault("Traceback\njson.decoder.JSONDecodeError: Expecting value: line 1\n") == "Expecting value: line 1"
