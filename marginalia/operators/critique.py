"""Critiques joined back to proposals, and the two rounds merged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.operators.ranking import Settle, numbered
from marginalia.sources.store import settled

#: What a ranking adds.
RANKS = ("rk", "rk_hq", "rk_uniq", "high_quality", "low_value", "known_dimension")


def last_wins(critiques: DataFrame) -> DataFrame:
    """Of critiques of one proposal the last in their order (pos)."""
    return critiques.groupBy("paper_id", "original_id").agg(F.max_by(F.coalesce("critique_text", F.lit("")), "pos").alias("critique_text"))


def _own(proposals: DataFrame, critiques: DataFrame):
    """Null ids match null ids."""
    return proposals["paper_id"].eqNullSafe(critiques["paper_id"]) & proposals["id"].eqNullSafe(critiques["original_id"])


def with_critique(proposals: DataFrame, critiques: DataFrame, how: str = "inner") -> DataFrame:
    """proposals with the critique_text that counts; how: inner, or left to keep those without one."""
    last = last_wins(critiques)
    return proposals.join(last, _own(proposals, last), how).select(proposals["*"], last["critique_text"])


def revise_candidates(high_quality: DataFrame, critiques: DataFrame, revise_k: int, settle: Settle = settled) -> DataFrame:
    """The first revise_k of each paper's critiqued proposals, in composite order; ranked after the join, before any call."""
    found = with_critique(high_quality, critiques)
    return numbered(found, ["paper_id"], [F.asc("rk")], "revise_pos", settle).where(F.col("revise_pos") <= revise_k)


def unrevised(high_quality: DataFrame, revised: DataFrame) -> DataFrame:
    return high_quality.join(revised.select("paper_id", "id").distinct(), ["paper_id", "id"], "left_anti")


def merged_rounds(scored_revised: DataFrame, high_quality: DataFrame, settle: Settle = settled) -> DataFrame:
    """Revised proposals in their order, then the unrevised in composite order; pos numbers each paper's list anew."""
    first = scored_revised.withColumn("_part", F.lit(0)).withColumn("_at", F.col("pos"))
    rest = unrevised(high_quality, scored_revised).withColumn("_part", F.lit(1)).withColumn("_at", F.col("rk"))
    both = first.drop(*RANKS).unionByName(rest.drop(*RANKS), allowMissingColumns=True)
    return numbered(both, ["paper_id"], [F.asc("_part"), F.asc("_at")], "pos", settle).drop("_part", "_at")
