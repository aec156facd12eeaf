"""Ranking, thresholds and grouping of scored proposals, for many papers at once.

Sorting is stable: what ties keeps the order of `pos`, the proposals' place in their list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.operators.ranking import Settle, numbered, running
from marginalia.plans.fixed_values import COMPOSITE_THRESHOLD, DIMENSIONS, IMPORTANCE_THRESHOLD, LOW_THRESHOLD
from marginalia.sources.store import settled


def check_top_k(k: int) -> int:
    """A slice to a negative end has no meaning here; 0 gives empty heads."""
    if k < 0:
        raise ValueError(f"top_k must not be negative. Got {k}.")
    return k


def is_high_quality() -> Column:
    return (F.col("composite") >= COMPOSITE_THRESHOLD) | (F.col("importance") >= IMPORTANCE_THRESHOLD)


def is_low_value() -> Column:
    return (F.col("importance") <= LOW_THRESHOLD) | (F.col("actionability") <= LOW_THRESHOLD)


def is_known_dimension() -> Column:
    return F.coalesce(F.col("dimension").isin(*DIMENSIONS), F.lit(False))


def ranked(scored: DataFrame, settle: Settle = settled) -> DataFrame:
    """scored with rk (by composite), high_quality, low_value, known_dimension, and of the high-quality ones rk_hq and rk_uniq (by uniqueness, ties by composite)."""
    flags = scored.withColumn("high_quality", F.coalesce(is_high_quality(), F.lit(False))).withColumn("low_value", is_low_value()).withColumn("known_dimension", is_known_dimension())
    out = running(flags, ["paper_id"], [F.desc("composite"), F.asc("pos")], settle, rk=F.lit(1), rk_hq=F.col("high_quality"))
    high = numbered(out.where("high_quality"), ["paper_id"], [F.desc("uniqueness"), F.asc("rk")], "rk_uniq", settle)
    none = F.lit(None).cast("long")
    return high.unionByName(out.where(~F.col("high_quality")).withColumn("rk_hq", none).withColumn("rk_uniq", none))


class Selection:
    """The named result sets, as views over one ranked DataFrame."""

    def __init__(self, scored: DataFrame, top_k: int):
        self.top_k = check_top_k(top_k)
        self.ranked = ranked(scored)
        self.critiques: DataFrame | None = None
        self.original_high_quality: DataFrame | None = None

    @classmethod
    def of(cls, ranked_rows: DataFrame, top_k: int) -> Selection:
        """From rows that are ranked already."""
        own = cls.__new__(cls)
        own.top_k, own.ranked, own.critiques, own.original_high_quality = check_top_k(top_k), ranked_rows, None, None
        return own

    @property
    def sorted_by_composite(self) -> DataFrame:
        return self.ranked

    @property
    def top_proposals(self) -> DataFrame:
        return self.ranked.where(F.col("rk") <= self.top_k)

    @property
    def low_value_ids(self) -> DataFrame:
        return self.ranked.where("low_value").select("paper_id", "rk", "id")

    @property
    def high_quality(self) -> DataFrame:
        return self.ranked.where("high_quality")

    @property
    def sorted_by_uniqueness(self) -> DataFrame:
        return self.high_quality

    @property
    def dimension_members(self) -> DataFrame:
        return dimension_members(self.high_quality)

    @property
    def by_dimension(self) -> DataFrame:
        return by_dimension(self.high_quality)


def dimensions(spark) -> DataFrame:
    return spark.createDataFrame(list(enumerate(DIMENSIONS)), "dimension_pos int, dimension string")


def _domain(high_quality: DataFrame) -> DataFrame:
    """Every dimension of every paper."""
    return high_quality.select("paper_id").distinct().crossJoin(F.broadcast(dimensions(high_quality.sparkSession)))


def dimension_members(high_quality: DataFrame) -> DataFrame:
    """paper_id, dimension_pos, dimension, place (from 0, in composite order), id: a row for each member of a declared dimension."""
    rows = high_quality.select("paper_id", "dimension", "rk", "id").join(F.broadcast(dimensions(high_quality.sparkSession)), "dimension")
    out = numbered(rows, ["paper_id", "dimension"], [F.asc("rk")], "place")
    return out.select("paper_id", "dimension_pos", "dimension", (F.col("place") - 1).alias("place"), "id")


def dimension_sizes(high_quality: DataFrame) -> DataFrame:
    """paper_id, dimension_pos, dimension, n: every dimension of every paper, empty ones too."""
    counts = high_quality.groupBy("paper_id", "dimension").agg(F.count(F.lit(1)).alias("n"))
    own = ["paper_id", "dimension"]
    return _domain(high_quality).join(counts, own, "left").select("paper_id", "dimension_pos", "dimension", F.coalesce("n", F.lit(0)).alias("n"))


def by_dimension(high_quality: DataFrame) -> DataFrame:
    """paper_id, dimension_pos, dimension, members (ids in composite order): what a report quotes, a dimension of a paper in one row.

    Where a dimension may be too long for a row, dimension_members has the same in rows.
    """
    lists = high_quality.groupBy("paper_id", "dimension").agg(F.transform(F.array_sort(F.collect_list(F.struct("rk", "id"))), lambda x: x["id"]).alias("members"))
    none = F.array().cast("array<bigint>")
    return _domain(high_quality).join(lists, ["paper_id", "dimension"], "left").select("paper_id", "dimension_pos", "dimension", F.coalesce(F.col("members").cast("array<bigint>"), none).alias("members"))


def select_and_classify(scored: DataFrame, top_k: int) -> Selection:
    return Selection(scored, top_k)
