"""Places of rows within their keys, without a task that holds all rows of a key.

Rows are dealt to ranges of (keys, order) and what range each is in is settled once, for ranges are sampled. A row's place is
its place among its key's rows of that range, and the key's rows in the ranges before; of these sums there is a row for each
key and range it has rows in. So one huge key spreads over tasks as many keys do.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marginalia.sources.store import settled

RANGE = "_range"
#: How rows are settled: by a checkpoint, or by a store that drops them when they are used up.
Settle = Callable[[DataFrame], DataFrame]


def running(rows: DataFrame, keys: list[str], order: list[Column], settle: Settle = settled, **flags: Column) -> DataFrame:
    """rows with, under each name, how many rows of equal keys have the flag up to and with this one; nulls are equal keys.

    The order must tell the rows of a key apart.
    """
    spread = settle(rows.repartitionByRange(*keys, *order).withColumn(RANGE, F.spark_partition_id()))
    kept = [c for c in rows.columns if c not in flags]
    flags = {n: f.cast("long") for n, f in flags.items()}
    inside = Window.partitionBy(*keys, RANGE)
    local = spread.select(*kept, RANGE, *(F.sum(f).over(inside.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)).alias(n) for n, f in flags.items()))
    sums = spread.groupBy(*keys, RANGE).agg(*(F.sum(f).alias(n) for n, f in flags.items()))
    earlier = Window.partitionBy(*keys).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(*(F.col(k).alias(f"_b_{k}") for k in (*keys, RANGE)), *(F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"_b_{n}") for n in flags))
    met = local.join(before, reduce(and_, (local[k].eqNullSafe(before[f"_b_{k}"]) for k in (*keys, RANGE))))
    return met.select(*kept, *((F.col(n) + F.col(f"_b_{n}")).alias(n) for n in flags))


def numbered(rows: DataFrame, keys: list[str], order: list[Column], name: str, settle: Settle = settled) -> DataFrame:
    """rows with their place, from 1, among those of equal keys."""
    return running(rows, keys, order, settle, **{name: F.lit(1)})
