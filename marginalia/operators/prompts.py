"""Prompts as expressions: each gives a system and a user text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marginalia.functions.text import compact_json, extended, render
from marginalia.plans import fixed_values as V


def messages(system: Column, user: Column) -> Column:
    """array<struct<role,content>>, system then user."""
    return F.array(F.struct(F.lit("system").alias("role"), system.alias("content")), F.struct(F.lit("user").alias("role"), user.alias("content")))


def generation_system(persona: Column) -> Column:
    base = F.lit(V.GENERATION_SYSTEM)
    return F.when(F.length(persona) > 0, F.concat(base, F.lit(V.PERSONA_JOINT), persona)).otherwise(base)


def generation_user(paper: Column, worker_id: Column) -> Column:
    return render(V.GENERATION_PROMPT, paper=paper, id=worker_id)


def generation(persona: Column, paper: Column, worker_id: Column) -> Column:
    return messages(generation_system(persona), generation_user(paper, worker_id))


def scoring_user(paper: Column, text: Column, dimension: Column) -> Column:
    """The long rubric, which only the cost estimate uses."""
    return render(V.SCORING_PROMPT, paper=paper, text=text, dimension=dimension)


def scoring(paper: Column, text: Column, dimension: Column) -> Column:
    return messages(F.lit(V.SCORING_SYSTEM), scoring_user(paper, text, dimension))


def scoring_user_ordered(paper: Column, text: Column, dimension: Column, rubric: tuple[str, ...], context: str) -> Column:
    """Rubric lines in the order asked for; the paper first if context says so, else the proposal."""
    about = [_filled(V.PAPER_BLOCK, paper=paper), _filled(V.PROPOSAL_BLOCK, dimension=dimension, text=text)]
    if context != "paper_then_proposal":
        about.reverse()
    lines = "\n".join(V.RUBRIC[k] for k in rubric)
    return render(V.ORDERED_PROMPT, rubric=F.lit(lines), context=F.concat(about[0], F.lit("\n\n"), about[1]))


def _filled(template: str, **values: Column) -> Column:
    """render() without the final strip, for blocks that stand inside a prompt."""
    parts, rest = [], template
    while rest:
        at = rest.find("{")
        if at < 0:
            parts.append(F.lit(rest))
            break
        end = rest.index("}", at)
        parts += [F.lit(rest[:at])] if at else []
        parts.append(F.coalesce(values[rest[at + 1 : end]].cast("string"), F.lit("None")))
        rest = rest[end + 1 :]
    return F.concat(*parts)


def scoring_pass(paper: Column, text: Column, dimension: Column, number: int) -> Column:
    _, rubric, context = V.PASSES[number - 1]
    return messages(F.lit(V.SCORING_SYSTEM), scoring_user_ordered(paper, text, dimension, rubric, context))


#: The order in which a proposal's fields stand in the critic's prompt where the model's own reply (record) isn't at hand: as generated, then as added.
PROPOSAL_FIELDS = ("id", "dimension", "text", "persona", "original_text", "importance", "specificity", "actionability", "uniqueness", "judge_disagreement", "composite")
#: Of these the ones that scoring adds.
SCORE_FIELDS = PROPOSAL_FIELDS[5:]


def proposal_json(columns: list[str]) -> Column:
    """The whole proposal: its record, with all that the model said in the model's order, and the scores; else the known fields."""
    if "record" in columns:
        return extended(F.col("record"), compact_json(*(F.col(c) for c in SCORE_FIELDS if c in columns)))
    return compact_json(*(F.col(c) for c in PROPOSAL_FIELDS if c in columns))


def critic(paper: Column, proposal_id: Column, proposal: Column) -> Column:
    return messages(F.lit(V.CRITIC_SYSTEM), render(V.CRITIC_PROMPT, paper=paper, id=proposal_id, proposal=proposal))


def revision(paper: Column, proposal_id: Column, dimension: Column, text: Column, critique: Column) -> Column:
    small = compact_json(proposal_id.alias("id"), dimension.alias("dimension"), F.coalesce(text, F.lit("")).alias("text"))
    return messages(F.lit(V.REVISION_SYSTEM), render(V.REVISION_PROMPT, paper=paper, id=proposal_id, dimension=dimension, proposal=small, critique=critique))


def spaced_object(values: Column, names: list[str], of: list[str]) -> Column:
    """A spaced JSON object of some of a row's fields; values: those of all fields (of), from spaced_values."""
    cells = [x for n in names for x in (F.lit(f', "{n}": '), F.get(values, F.lit(of.index(n))))]
    return F.concat(F.lit(f'{{"{names[0]}": '), *cells[1:], F.lit("}"))


def spaced_list(objects: Column) -> Column:
    """An array of spaced JSON as one spaced JSON list."""
    return F.concat(F.lit("["), F.array_join(objects, ", "), F.lit("]"))


def spaced_dimensions(lists: dict[str, Column]) -> Column:
    """The spaced JSON object of each dimension's list."""
    cells = [x for d, own in lists.items() for x in (F.lit(f', "{d}": '), own)]
    return F.concat(F.lit(f'{{"{next(iter(lists))}": '), *cells[1:], F.lit("}"))


def meta_user(by_dimension: Column, strongest: Column, unique: Column, critiques: Column, high_quality: Column) -> Column:
    """All five are JSON in the spaced, ASCII form."""
    return render(V.META_PROMPT, by_dimension=by_dimension, strongest=strongest, unique=unique, critiques=critiques, high_quality=high_quality)
