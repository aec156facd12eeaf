"""The review workflow's queries over the driver's tables, each with SQL that gives the same rows.

Documents stand for proposals of one paper (id and pos are doc_id); scores are whole-number formulas of id and n_chars,
and so no model's: they exercise the relational steps. Assistant turns stand for critiques.
"""

from __future__ import annotations

import re
from hashlib import md5

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions.tokens import CharacterCounter
from marginalia.operators import cost, critique, prompts, scoring, selection
from marginalia.operators.workers import worker_assignments as assignments
from marginalia.plans import fixed_values as V

#: Fixed values of the synthetic scores: offset, and for each criterion the factor of both passes.
ROUND_1 = (1, {"importance": (101, 211), "specificity": (307, 401), "actionability": (503, 607), "uniqueness": (701, 809)})
ROUND_2 = (7, {"importance": (103, 223), "specificity": (311, 409), "actionability": (509, 613), "uniqueness": (709, 811)})
#: Dimensions by n_chars modulo 5; the last is none of the declared ones.
DIMENSION_OF = (*V.DIMENSIONS, "off_list")
TOP_K, REVISED, AGENTS = 5, 50, 16
PAPER = "paper"


def _score(o: int, k: int) -> Column:
    return (F.lit(1) + ((F.col("id") + o) * k + F.col("n_chars") * (k + 12)) % 997 % 5).cast("int")


def _raw(rows: DataFrame, offset: int, factors: dict) -> DataFrame:
    cells = {f"{c}{p + 1}": _score(offset, k) for c, ks in factors.items() for p, k in enumerate(ks)}
    return rows.withColumns(cells)


def proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kinds = F.element_at(F.array(*map(F.lit, DIMENSION_OF)), (F.col("n_chars") % 5 + 1).cast("int"))
    return docs.select(F.lit(PAPER).alias("paper_id"), F.col("doc_id").alias("pos"), F.col("doc_id").alias("id"), kinds.alias("dimension"), "text", "n_chars")


def raw_1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _raw(proposals(spark, sf_dir).drop("text"), *ROUND_1)


def scored_1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.scored(raw_1(spark, sf_dir))


def ranked_1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.ranked(scored_1(spark, sf_dir))


def critiques(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("role = 'assistant'")
    return turns.select(F.lit(PAPER).alias("paper_id"), F.col("turn").alias("pos"), F.col("conv_id").alias("original_id"), F.col("text").alias("critique_text"))


def _high(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_1(spark, sf_dir).where("high_quality")


def worker_assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assignments(spark, AGENTS).select("id", "persona_name", F.length("persona").cast("long").alias("persona_chars"), F.md5("persona").alias("persona_md5"))


def two_pass_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored_1(spark, sf_dir).select("id", *V.CRITERIA)


def judge_disagreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored_1(spark, sf_dir).select("id", *(F.col(f"judge_disagreement.{k}").cast("long").alias(k) for k in V.CRITERIA))


def composite_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored_1(spark, sf_dir).select("id", "composite")


def rank_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_1(spark, sf_dir).select("id", "composite", "rk")


def high_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _high(spark, sf_dir).select("id", "dimension", "composite", "importance", "rk", "rk_hq")


def low_value_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_1(spark, sf_dir).where("low_value").select("id", "rk", "high_quality")


def rank_uniqueness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _high(spark, sf_dir).select("id", "uniqueness", "rk_uniq")


def top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.Selection(scored_1(spark, sf_dir), TOP_K).top_proposals.select("id", "composite", "rk")


def by_dimension_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each declared dimension how many of the ten best it has; dimensions without one stay."""
    best = ranked_1(spark, sf_dir).where("rk <= 10 and high_quality")
    return selection.dimension_sizes(best).select("dimension", "n")


def by_dimension_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.dimension_members(_high(spark, sf_dir)).select("dimension", "place", "id")


def critique_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return critique.last_wins(critiques(spark, sf_dir)).select("original_id", "critique_text")


def critique_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every high-quality proposal, with its critique or none."""
    return critique.with_critique(_high(spark, sf_dir), critiques(spark, sf_dir), "left").select("id", "rk", "critique_text")


def revise_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return critique.revise_candidates(_high(spark, sf_dir), critiques(spark, sf_dir), TOP_K).select("id", "rk", "revise_pos", "critique_text")


def _revised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of round 1, scored anew."""
    rows = _high(spark, sf_dir).where(F.col("rk_hq") <= REVISED).select("paper_id", F.col("rk_hq").alias("pos"), "id", "dimension", "n_chars")
    return scoring.scored(_raw(rows, *ROUND_2))


def unrevised_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return critique.unrevised(_high(spark, sf_dir), _revised(spark, sf_dir)).select("id", "rk")


def merged_round2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return critique.merged_rounds(_revised(spark, sf_dir), _high(spark, sf_dir)).select("id", "pos", "composite")


def select_round2(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = critique.merged_rounds(_revised(spark, sf_dir), _high(spark, sf_dir))
    return selection.ranked(merged).where("high_quality").select("id", "dimension", "composite", "rk", "rk_hq", "rk_uniq")


def _short_paper(spark: SparkSession) -> DataFrame:
    """The one paper, sent to all tasks: joined by shuffling, it would bring all proposals to one."""
    return F.broadcast(spark.createDataFrame([(PAPER, "A short paper.")], "paper_id string, paper_text string"))


def _stage_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters stand for tokens; the paper is a fixed text."""
    papers = _short_paper(spark)
    rows = proposals(spark, sf_dir).withColumn("persona", F.lit(V.EDITOR))
    counter = CharacterCounter()
    high = _high(spark, sf_dir).join(rows.select("id", "text"), "id")
    stages = [
        cost.Stage("generation", "gpt-5", cost.generation_tokens(rows, papers, counter)),
        cost.Stage("scoring", "gpt-5", cost.scoring_tokens(scored_1(spark, sf_dir).join(rows.select("id", "text"), "id"), papers, counter)),
        cost.Stage("re_scoring", "gpt-5", cost.rescoring_tokens(high, papers, counter)),
    ]
    return cost.stage_costs(papers, stages)


def stage_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stage_costs(spark, sf_dir).select("stage", "model", "prompt_tokens", "completion_tokens", "total_tokens", "cost_usd")


def cost_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cost.cost_total(_stage_costs(spark, sf_dir)).drop("paper_id")


def prompt_generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = proposals(spark, sf_dir)
    user = prompts.generation_user(F.col("text"), F.col("id"))
    system = prompts.generation_system(F.lit(V.EDITOR))
    return rows.select("id", F.length(user).cast("long").alias("user_chars"), F.md5(user.cast("binary")).alias("user_md5"), F.md5(system.cast("binary")).alias("system_md5"))


def prompt_scoring_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, out = proposals(spark, sf_dir), None
    for number, rubric, context in V.PASSES:
        user = prompts.scoring_user_ordered(F.lit("A short paper."), F.col("text"), F.col("dimension"), rubric, context)
        own = rows.select("id", F.lit(number).cast("long").alias("pass"), F.md5(user.cast("binary")).alias("user_md5"))
        out = own if out is None else out.union(own)
    return out


def by_dimension_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each declared dimension how many of all high-quality proposals it has; dimensions without one stay."""
    return selection.dimension_sizes(_high(spark, sf_dir)).select("dimension", "n")


def papers_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proposals dealt to papers by their source: each paper has its own ranks."""
    source = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("id"), F.coalesce("source", F.lit("")).alias("paper_id"))
    rows = selection.ranked(scored_1(spark, sf_dir).drop("paper_id").join(source, "id"))
    return rows.where("high_quality").select("paper_id", "id", "rk", "rk_hq", "rk_uniq")


def _high_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """High-quality proposals with their texts and means."""
    return _high(spark, sf_dir).select("paper_id", "id", "rk", "dimension", *V.CRITERIA).join(proposals(spark, sf_dir).select("id", "text"), "id")


def prompt_critic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The critic's prompt for each high-quality proposal; its own document is the paper."""
    rows = _high_texts(spark, sf_dir)
    asked = prompts.critic(F.col("text"), F.col("id"), prompts.proposal_json(rows.columns))
    return rows.select("id", *(F.md5(asked[k]["content"].cast("binary")).alias(f"{name}_md5") for k, name in enumerate(("system", "user"))))


def prompt_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The revision prompt for each high-quality proposal with a critique."""
    rows = critique.with_critique(_high_texts(spark, sf_dir), critiques(spark, sf_dir))
    asked = prompts.revision(F.col("text"), F.col("id"), F.col("dimension"), F.col("text"), F.col("critique_text"))
    return rows.select("id", *(F.md5(asked[k]["content"].cast("binary")).alias(f"{name}_md5") for k, name in enumerate(("system", "user"))))


def _selected(spark: SparkSession, sf_dir: str) -> selection.Selection:
    """What the report's prompt is made of; digests stand for texts, so that the prompt of a whole table stays small."""
    rows = scored_1(spark, sf_dir).join(proposals(spark, sf_dir).select("id", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text")), "id")
    chosen = selection.select_and_classify(rows, TOP_K)
    chosen.critiques = critiques(spark, sf_dir).withColumn("critique_text", F.md5(F.coalesce("critique_text", F.lit("")).cast("binary")))
    return chosen


def prompt_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report's prompt, with its five lists."""
    from marginalia.plans.review import Reviewer

    user = F.col("user")
    asked = Reviewer(spark).meta_requests(spark.createDataFrame([(PAPER,)], "paper_id string"), _selected(spark, sf_dir), TOP_K)
    return asked.select(F.length(user).cast("long").alias("user_chars"), F.md5(user.cast("binary")).alias("user_md5"))


def stage_cost_reviewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What critiques, revision and the report cost; characters stand for tokens."""
    from marginalia.plans.review import Reviewer

    papers = _short_paper(spark)
    counter, high, heard = CharacterCounter(), _high_texts(spark, sf_dir), critiques(spark, sf_dir)
    replies = papers.select("paper_id", F.lit("A report.").alias("meta_review"))
    stages = [
        cost.Stage("critiques", "gpt-5", cost.critique_tokens(high, heard, papers, counter)),
        cost.Stage("revision", "gpt-5", cost.revision_tokens(high, heard, papers, counter)),
        cost.Stage("meta_review", "gpt-5", Reviewer(spark, counter=counter).meta_tokens(papers, _selected(spark, sf_dir), TOP_K, replies)),
    ]
    return cost.stage_costs(papers, stages).select("stage", "model", "prompt_tokens", "completion_tokens", "total_tokens", "cost_usd")


def pipeline_stub(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole review of every document as a paper, on the stub."""
    from marginalia.plans.review import Reviewer

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    papers = docs.select(F.concat(F.lit("paper-"), F.col("doc_id").cast("string")).alias("paper_id"), F.col("text").alias("paper_text"))
    done = Reviewer(spark).review(papers)
    return done.meta_review.join(done.cost_total, "paper_id").join(done.calls, "paper_id")


def _sql_text(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _sql_raw(source: str, offset: int, factors: dict) -> str:
    cells = ", ".join(f"1 + (((id + {offset}) * {k} + n_chars * {k + 12}) % 997) % 5 AS {c}{p + 1}" for c, ks in factors.items() for p, k in enumerate(ks))
    return f"SELECT *, {cells} FROM {source}"


def _sql_scored(source: str) -> str:
    means = ", ".join(f"({c}1 + {c}2) / CAST(2 AS DOUBLE) AS {c}" for c in V.CRITERIA)
    weights = " + ".join(f"CAST({w} AS DOUBLE) * {c}" for c, w in V.WEIGHTS)
    return f"SELECT *, {weights} AS composite FROM (SELECT *, {means} FROM {source})"


_DIMENSIONS = "CASE n_chars % 5 " + " ".join(f"WHEN {i} THEN '{d}'" for i, d in enumerate(DIMENSION_OF)) + " END"
_FLAGS = f"composite >= {V.COMPOSITE_THRESHOLD} OR importance >= {V.IMPORTANCE_THRESHOLD}"
_CORE = f"""WITH p AS (SELECT doc_id AS pos, doc_id AS id, {_DIMENSIONS} AS dimension, text, n_chars FROM documents),
r1 AS ({_sql_raw('p', *ROUND_1)}),
s1 AS ({_sql_scored('r1')}),
k1 AS (SELECT *, row_number() OVER (ORDER BY composite DESC, pos) AS rk FROM s1),
h1 AS (SELECT *, row_number() OVER (ORDER BY rk) AS rk_hq, row_number() OVER (ORDER BY uniqueness DESC, rk) AS rk_uniq FROM k1 WHERE {_FLAGS}),
c AS (SELECT conv_id AS original_id, arg_max(coalesce(text, ''), turn) AS critique_text FROM conversations WHERE role = 'assistant' GROUP BY conv_id),
p2 AS (SELECT rk_hq AS pos, id, dimension, n_chars FROM h1 WHERE rk_hq <= {REVISED}),
r2 AS ({_sql_raw('p2', *ROUND_2)}),
s2 AS ({_sql_scored('r2')}),
u AS (SELECT * FROM h1 WHERE id NOT IN (SELECT id FROM s2)),
m AS (SELECT row_number() OVER (ORDER BY part, spot) AS pos, id, dimension, importance, uniqueness, composite FROM (
  SELECT 0 AS part, pos AS spot, id, dimension, importance, uniqueness, composite FROM s2 UNION ALL SELECT 1, rk, id, dimension, importance, uniqueness, composite FROM u)),
k2 AS (SELECT *, row_number() OVER (ORDER BY composite DESC, pos) AS rk FROM m),
d AS (SELECT unnest([{', '.join(map(_sql_text, V.DIMENSIONS))}]) AS dimension)
"""


def _sql_deck() -> str:
    rows = ", ".join(f"({i}, '{name}', {_sql_text(text)})" for i, (name, text) in enumerate(V.DECK))
    return f"SELECT b * {len(V.DECK)} + slot + 1 AS id, persona_name, length(persona) AS persona_chars, md5(persona) AS persona_md5 FROM range({AGENTS // len(V.DECK)}) t(b), (VALUES {rows}) deck(slot, persona_name, persona)"


def _sql_template(template: str, **values: str) -> str:
    """The template as an SQL expression, stripped of white space at both ends."""


    parts = [values[x[1:-1]] if x[1:-1] in values and x.startswith("{") else _sql_text(x) for x in re.split(r"(\{\w+\})", template) if x]
    return f"regexp_replace({' || '.join(parts)}, '^[\\s]+|[\\s]+$', '', 'g')"


def _sql_ordered(rubric, context) -> str:
    paper, proposal = "'Paper text:' || chr(10) || '```text' || chr(10) || 'A short paper.' || chr(10) || '```'", "'Feedback proposal (dimension = ' || dimension || '):' || chr(10) || chr(10) || text"
    blocks = (paper, proposal) if context == "paper_then_proposal" else (proposal, paper)
    lines = _sql_text("\n".join(V.RUBRIC[k] for k in rubric))
    return _sql_template(V.ORDERED_PROMPT, rubric=lines, context=" || chr(10) || chr(10) || ".join(blocks))


def _sql_json(**fields: str) -> str:
    return "json_object(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")::VARCHAR"


def _sql_costs() -> str:
    """Each stage's characters, priced."""
    system = len(V.GENERATION_SYSTEM + V.PERSONA_JOINT + V.EDITOR)
    numbers = "'{' || " + " || ',' || ".join(f"'\"{c}\":' || CAST({c} AS VARCHAR)" for c in V.CRITERIA) + " || '}'"
    long_prompt = _sql_template(V.SCORING_PROMPT, paper="'A short paper.'", dimension="dimension", text="text")
    first, second = (_sql_ordered(r, c) for _, r, c in V.PASSES)
    price_in, price_out, _ = cost.lookup_price("gpt-5")
    return f"""{_CORE}, stages AS (
  SELECT 0 AS stage_pos, 'generation' AS stage, sum({system} + length({_sql_template(V.GENERATION_PROMPT, paper="'A short paper.'", id='id')})) AS p, sum(length({_sql_json(id='id', dimension='dimension', text='text')})) AS c FROM p
  UNION ALL SELECT 1, 'scoring', sum({len(V.SCORING_SYSTEM)} + length({long_prompt})), sum(length({numbers})) FROM s1
  UNION ALL SELECT 4, 're_scoring', sum(2 * {len(V.SCORING_SYSTEM)} + length({first}) + length({second})), sum(2 * length({numbers})) FROM h1
), priced AS (SELECT stage_pos, stage, 'gpt-5' AS model, CAST(p AS BIGINT) AS prompt_tokens, CAST(c AS BIGINT) AS completion_tokens, CAST(p + c AS BIGINT) AS total_tokens,
  CAST(p AS DOUBLE) * CAST({price_in!r} AS DOUBLE) + CAST(c AS DOUBLE) * CAST({price_out!r} AS DOUBLE) AS cost_usd FROM stages)
"""


def _sql_proposal() -> str:
    return _sql_json(id="id", dimension="dimension", text="text", **{c: c for c in V.CRITERIA})


def _sql_list(source: str, order: str, *fields: str) -> str:
    """Spaced JSON of the rows of a source."""
    cells = [f"""'"{f}": ' || """ + (f"""'"' || {f} || '"'""" if f in ("dimension", "text", "critique_text") else f"CAST({f} AS VARCHAR)") for f in fields]
    return f"(SELECT '[' || coalesce(string_agg('{{' || " + " || ', ' || ".join(cells) + f" || '}}', ', ' ORDER BY {order}), '') || ']' FROM {source})"


_META = f"""{_CORE}, g AS (SELECT * REPLACE (md5(coalesce(text, '')) AS text) FROM k1), gh AS (SELECT * REPLACE (md5(coalesce(text, '')) AS text) FROM h1),
cs AS (SELECT conv_id AS original_id, turn, md5(coalesce(text, '')) AS critique_text FROM conversations WHERE role = 'assistant'),
q AS (SELECT {_sql_template(
    V.META_PROMPT,
    by_dimension="'{' || " + " || ', ' || ".join(f"""'"{d}": ' || """ + _sql_list(f"gh WHERE dimension = '{d}'", "rk", "id", "text", *V.CRITERIA, "composite") for d in V.DIMENSIONS) + " || '}'",
    strongest=_sql_list(f"g WHERE rk <= {TOP_K}", "rk", "id", "dimension", "text", "composite"),
    unique=_sql_list(f"gh WHERE rk_uniq <= {TOP_K}", "rk_uniq", "id", "dimension", "text", "uniqueness", "composite"),
    critiques=_sql_list("cs", "turn, original_id, critique_text", "original_id", "critique_text"),
    high_quality=_sql_list("gh", "rk", "id", "dimension", "text", *V.CRITERIA, "composite"),
)} AS u)
"""


def _sql_reviewed() -> str:
    price_in, price_out, _ = cost.lookup_price("gpt-5")
    critic = _sql_template(V.CRITIC_PROMPT, paper="'A short paper.'", id="id", proposal=_sql_proposal())
    small = _sql_json(id="id", dimension="dimension", text="text")
    revised = _sql_template(V.REVISION_PROMPT, paper="'A short paper.'", id="id", dimension="dimension", proposal=small, critique="critique_text")
    return f"""{_META}, stages AS (
  SELECT 'critiques' AS stage, sum({len(V.CRITIC_SYSTEM)} + length({critic})) AS p, sum(CASE WHEN critique_text IS NULL THEN 0 ELSE length({_sql_json(original_id='id', critique_text='critique_text')}) END) AS c FROM h1 LEFT JOIN c ON id = original_id
  UNION ALL SELECT 'revision', sum({len(V.REVISION_SYSTEM)} + length({revised})), sum(length({small})) FROM h1 JOIN c ON id = original_id WHERE critique_text <> ''
  UNION ALL SELECT 'meta_review', {len(V.META_SYSTEM)} + length(u), {len('A report.')} FROM q
) SELECT stage, 'gpt-5' AS model, CAST(p AS BIGINT) AS prompt_tokens, CAST(c AS BIGINT) AS completion_tokens, CAST(p + c AS BIGINT) AS total_tokens,
  CAST(p AS DOUBLE) * CAST({price_in!r} AS DOUBLE) + CAST(c AS DOUBLE) * CAST({price_out!r} AS DOUBLE) AS cost_usd FROM stages"""


QUERIES = {
    f.__name__: f
    for f in (
        worker_assignments, two_pass_mean, judge_disagreement, composite_score, rank_composite, high_quality, low_value_ids, rank_uniqueness, top_k,
        by_dimension_counts, by_dimension_members, critique_last_wins, critique_lookup, revise_candidates, unrevised_anti, merged_round2, select_round2,
        stage_cost, cost_total, prompt_generation, prompt_scoring_ordered, by_dimension_sizes, papers_ranked, prompt_critic, prompt_revision,
        prompt_meta, stage_cost_reviewed, pipeline_stub,
    )
}

SQL = {
    "worker_assignments": _sql_deck(),
    "two_pass_mean": _CORE + f"SELECT id, {', '.join(V.CRITERIA)} FROM s1",
    "judge_disagreement": _CORE + "SELECT id, " + ", ".join(f"CAST(abs({c}1 - {c}2) AS BIGINT) AS {c}" for c in V.CRITERIA) + " FROM r1",
    "composite_score": _CORE + "SELECT id, composite FROM s1",
    "rank_composite": _CORE + "SELECT id, composite, rk FROM k1",
    "high_quality": _CORE + "SELECT id, dimension, composite, importance, rk, rk_hq FROM h1",
    "low_value_ids": _CORE + f"SELECT id, rk, ({_FLAGS}) AS high_quality FROM k1 WHERE importance <= {V.LOW_THRESHOLD} OR actionability <= {V.LOW_THRESHOLD}",
    "rank_uniqueness": _CORE + "SELECT id, uniqueness, rk_uniq FROM h1",
    "top_k": _CORE + f"SELECT id, composite, rk FROM k1 WHERE rk <= {TOP_K}",
    "by_dimension_counts": _CORE + "SELECT d.dimension, count(h1.id) AS n FROM d LEFT JOIN h1 ON h1.dimension = d.dimension AND h1.rk <= 10 GROUP BY d.dimension",
    "by_dimension_members": _CORE + "SELECT d.dimension, row_number() OVER (PARTITION BY d.dimension ORDER BY rk) - 1 AS place, id FROM d JOIN h1 USING (dimension)",
    "critique_last_wins": _CORE + "SELECT original_id, critique_text FROM c",
    "critique_lookup": _CORE + "SELECT id, rk, critique_text FROM h1 LEFT JOIN c ON id = original_id",
    "revise_candidates": _CORE + f"SELECT * FROM (SELECT id, rk, row_number() OVER (ORDER BY rk) AS revise_pos, critique_text FROM h1 JOIN c ON id = original_id) WHERE revise_pos <= {TOP_K}",
    "unrevised_anti": _CORE + "SELECT id, rk FROM u",
    "merged_round2": _CORE + "SELECT id, pos, composite FROM m",
    "select_round2": _CORE + f"SELECT id, dimension, composite, rk, row_number() OVER (ORDER BY rk) AS rk_hq, row_number() OVER (ORDER BY uniqueness DESC, rk) AS rk_uniq FROM k2 WHERE {_FLAGS}",
    "stage_cost": _sql_costs() + "SELECT stage, model, prompt_tokens, completion_tokens, total_tokens, cost_usd FROM priced",
    "cost_total": _sql_costs() + "SELECT CAST(sum(prompt_tokens) AS BIGINT) AS total_prompt_tokens, CAST(sum(completion_tokens) AS BIGINT) AS total_completion_tokens, CAST(sum(total_tokens) AS BIGINT) AS total_tokens, list_reduce(list_prepend(CAST(0 AS DOUBLE), list(cost_usd ORDER BY stage_pos)), lambda a, x: a + x) AS total_cost_usd FROM priced",
    "prompt_generation": f"SELECT id, length(u) AS user_chars, md5(u) AS user_md5, '{md5((V.GENERATION_SYSTEM + V.PERSONA_JOINT + V.EDITOR).encode()).hexdigest()}' AS system_md5 FROM (SELECT doc_id AS id, {_sql_template(V.GENERATION_PROMPT, paper='text', id='doc_id')} AS u FROM documents)",
    "prompt_scoring_ordered": _CORE + " UNION ALL ".join(f"SELECT id, CAST({n} AS BIGINT) AS pass, md5({_sql_ordered(r, c)}) AS user_md5 FROM p" for n, r, c in V.PASSES),
    "by_dimension_sizes": _CORE + "SELECT d.dimension, count(h1.id) AS n FROM d LEFT JOIN h1 ON h1.dimension = d.dimension GROUP BY d.dimension",
    "papers_ranked": _CORE + f"""SELECT paper_id, id, rk, row_number() OVER (PARTITION BY paper_id ORDER BY rk) AS rk_hq, row_number() OVER (PARTITION BY paper_id ORDER BY uniqueness DESC, rk) AS rk_uniq
FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY composite DESC, pos) AS rk FROM s1 JOIN (SELECT doc_id AS id, coalesce(source, '') AS paper_id FROM documents) USING (id)) WHERE {_FLAGS}""",
    "prompt_critic": _CORE + f"SELECT id, '{md5(V.CRITIC_SYSTEM.encode()).hexdigest()}' AS system_md5, md5({_sql_template(V.CRITIC_PROMPT, paper='text', id='id', proposal=_sql_proposal())}) AS user_md5 FROM h1",
    "prompt_revision": _CORE + f"SELECT id, '{md5(V.REVISION_SYSTEM.encode()).hexdigest()}' AS system_md5, md5({_sql_template(V.REVISION_PROMPT, paper='text', id='id', dimension='dimension', proposal=_sql_json(id='id', dimension='dimension', text='text'), critique='critique_text')}) AS user_md5 FROM h1 JOIN c ON id = original_id",
    "prompt_meta": _META + "SELECT length(u) AS user_chars, md5(u) AS user_md5 FROM q",
    "stage_cost_reviewed": _sql_reviewed(),
}
