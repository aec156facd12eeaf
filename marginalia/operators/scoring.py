"""Scores of two passes: mean, disagreement, composite. All in binary floating point, added in the stated order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.plans.fixed_values import CRITERIA, WEIGHTS


def composite(of: dict[str, Column] | None = None) -> Column:
    """The weighted sum, left to right; never regrouped, rounded or decimal, for ranks hang on its last bits."""
    terms = [F.lit(w) * (of[k] if of else F.col(k)) for k, w in WEIGHTS]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total


def mean_of_passes(first: str = "{}1", second: str = "{}2") -> list[Column]:
    return [((F.col(first.format(k)) + F.col(second.format(k))) / F.lit(2.0)).alias(k) for k in CRITERIA]


def disagreement(first: str = "{}1", second: str = "{}2") -> Column:
    return F.struct(*(F.abs(F.col(first.format(k)) - F.col(second.format(k))).alias(k) for k in CRITERIA)).alias("judge_disagreement")


def side_by_side(raw: DataFrame, keys: list[str]) -> DataFrame:
    """Raw scores with one row for each pass -> one row, criteria numbered by pass."""
    cells = [F.max(F.when(F.col("pass") == p, F.col(k))).alias(f"{k}{p}") for k in CRITERIA for p in (1, 2)]
    return raw.groupBy(*keys).agg(*cells)


def scored(proposals: DataFrame) -> DataFrame:
    """proposals with both passes' scores side by side -> means, disagreement and composite; other columns stay."""
    raw = [f"{k}{p}" for k in CRITERIA for p in (1, 2)]
    kept = [c for c in proposals.columns if c not in raw]
    return proposals.select(*kept, *mean_of_passes(), disagreement()).withColumn("composite", composite())
