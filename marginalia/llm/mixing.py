"""Operator 4: mixing sources to target weights by Sainte-Laguë apportionment.

Every document of a source is dealt to a shard by a seeded hash, and a shard's documents, in seeded order, form a line
of words that is cut into blocks of `block_words`. The words to take are apportioned in blocks: first to the sources, by
the highest quotients target / (2 k + 1), then each source's blocks to its shards in the same way. A shard whose quota is
q takes its n blocks q // n times whole and q % n of them once more, chosen evenly from a seeded start. A document takes
the words of its blocks, repeats counted, and so never more than `cap` times its size.

To the driver come one row for each source and one for each shard; a shard has at least `shard_words` words and there
are at most 65,536 and one for each source, whatever the input. Windows run within a shard, so a hot source spreads.

Cases: null or empty text: size 0, nothing taken; null source: a source of its own, last; repeated rows: each counts;
equal doc_ids in a shard: in order of size; an empty table: no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from marginalia.llm.common import WORD, every, free, saved, table

WEIGHTS = (3, 1, 2)
RATIO = 1.5
CAP = 2.0
BLOCK_WORDS = 16
SHARD_WORDS = 1 << 18
MOST_SHARDS = 1 << 16
SEED = 20_231
#: A plan of so many rows at most (under 1 MB) is broadcast; a larger one is joined by shuffling.
SMALL_PLAN = 5_000


def words_in(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, ratio: float = RATIO, cap: float = CAP) -> list[float]:
    """Shares of ratio times all sizes by weight; what exceeds cap times a size goes to the others by weight."""
    share = [0.0] * len(sizes)
    left, free = ratio * sum(sizes), [i for i, n in enumerate(sizes) if n]
    while free:
        per = left / sum(weights[i % len(weights)] for i in free)
        full = [i for i in free if per * weights[i % len(weights)] > cap * sizes[i]]
        if not full:
            for i in free:
                share[i] = per * weights[i % len(weights)]
            break
        for i in full:
            share[i] = cap * sizes[i]
            left -= share[i]
        free = [i for i in free if i not in set(full)]
    return share


def sainte_lague(votes: list[float], seats: int, most: list[int]) -> list[int]:
    """Seats by the highest quotients votes / (2 k + 1), at most `most` each; ties go to the earlier one."""
    seats = min(seats, sum(most))
    if seats <= 0:
        return [0] * len(votes)
    per = sum(votes) / seats or 1.0
    got = [min(m, int(v / per + 0.5)) for v, m in zip(votes, most)]
    n = sum(got)
    more = [(-v / (2 * k + 1), i) for i, (v, k, m) in enumerate(zip(votes, got, most)) if k < m]
    heapq.heapify(more)
    while n < seats:
        _, i = heapq.heappop(more)
        got[i] += 1
        n += 1
        if got[i] < most[i]:
            heapq.heappush(more, (-votes[i] / (2 * got[i] + 1), i))
    less = [(votes[i] / (2 * k - 1), -i) for i, k in enumerate(got) if k]
    heapq.heapify(less)
    while n > seats:
        _, i = heapq.heappop(less)
        got[-i] -= 1
        n -= 1
        if got[-i]:
            heapq.heappush(less, (votes[-i] / (2 * got[-i] - 1), i))
    return got


def _joined(rows: DataFrame, plan: DataFrame, n: int, keys: list[str]) -> DataFrame:
    on = [rows[k].eqNullSafe(plan[f"p_{k}"]) for k in keys]
    out = rows.join(F.broadcast(plan) if n <= SMALL_PLAN else plan, on)
    return out.drop(*(f"p_{k}" for k in keys))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, ratio: float = RATIO, cap: float = CAP, block_words: int = BLOCK_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, quota (its shard's blocks), taken, copies (taken over size, rounded up or down by a seeded draw)."""
    spark = docs.sparkSession
    sized = saved(docs.select("doc_id", "source", words_in("text").alias("size")))  # texts are read once
    sources = sorted(((r["source"], r["n"]) for r in sized.groupBy("source").agg(F.sum("size").alias("n")).collect()), key=lambda x: (x[0] is None, x[0] or ""))
    sizes = [n for _, n in sources]
    target = targets(sizes, weights, ratio, cap)
    shard_words = max(SHARD_WORDS, sum(sizes) // MOST_SHARDS + 1)
    shards = [max(1, -(-n // shard_words)) for n in sizes]
    plan = spark.createDataFrame([(s, n, t, k) for (s, n), t, k in zip(sources, target, shards)], "p_source string, source_size long, target double, shards long")
    order = F.xxhash64(F.lit(seed), "doc_id")
    dealt = _joined(sized, plan, len(sources), ["source"]).withColumn("place", order).withColumn("shard", F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id"), "shards"))

    found: dict = {s: [] for s, _ in sources}
    for r in dealt.groupBy("source", "shard").agg(F.sum("size").alias("n")).orderBy("shard").collect():
        found[r["source"]].append((r["shard"], r["n"]))
    blocks = {s: [-(-n // block_words) for _, n in own] for s, own in found.items()}
    most = [sum(math.floor(cap * n) for n in blocks[s]) for s, _ in sources]
    quotas = sainte_lague(target, round(sum(target) / block_words), most)
    rows = []
    for (s, _), q in zip(sources, quotas):
        own = sainte_lague([float(n) for _, n in found[s]], q, [math.floor(cap * n) for n in blocks[s]])
        rows += [(s, shard, q, n) for (shard, _), q, n in zip(found[s], own, blocks[s])]
    plan = spark.createDataFrame(rows, T.StructType([T.StructField("p_source", T.StringType())] + [T.StructField(n, T.LongType()) for n in ("p_shard", "quota", "blocks")]))
    lines = _joined(dealt, plan, len(rows), ["source", "shard"])

    end = F.sum("size").over(Window.partitionBy("source", "shard").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0))
    lines = lines.withColumn("ends", end).withColumn("begins", F.col("ends") - F.col("size"))
    n = F.greatest("blocks", F.lit(1))
    lines = lines.withColumn("again", F.col("quota") % n).withColumn("whole", F.floor(F.col("quota") / n))
    lines = lines.withColumn("start", F.pmod(F.xxhash64(F.lit(seed + 2), "source", "shard"), n))

    def chosen(j: Column) -> Column:
        """How many of the blocks before j, counted from the seeded start, are chosen once more."""
        return F.floor((j + F.col("start")) * F.col("again") / n)

    def before(x: Column) -> Column:
        """Words before x that the blocks chosen once more hold."""
        b, rest = F.floor(x / block_words), x % block_words
        return block_words * (chosen(b) - chosen(F.lit(0))) + rest * (chosen(b + 1) - chosen(b))

    taken = F.col("whole") * F.col("size") + before(F.col("ends")) - before(F.col("begins"))
    draw = F.pmod(F.xxhash64(F.lit(seed + 3), "doc_id", "size"), F.lit(1 << 20)) / (1 << 20)
    copies = F.when(F.col("size") > 0, F.floor(taken / F.col("size") + draw)).otherwise(0)
    return lines.select("doc_id", "source", "size", "source_size", "target", "quota", taken.cast("long").alias("taken"), copies.cast("int").alias("copies"))


def mixed_documents(docs: DataFrame, seed: int = SEED, **how) -> DataFrame:
    """docs, each whole and in as many copies as the mix takes of it; the columns stay.

    Copies are rounded by a seeded draw, so that the words of all copies come near those taken also where documents are
    long. Rows of equal doc_id, source and size have equally many copies.
    """
    d, s, n, k, own = free(docs, "mixed_id", "mixed_source", "mixed_size", "copies", "own_size")
    mix = mix_sources(docs.select("doc_id", "source", "text"), seed=seed, **how).where("copies > 0")
    copies = mix.groupBy(F.col("doc_id").alias(d), F.col("source").alias(s), F.col("size").alias(n)).agg(F.max("copies").alias(k))
    sized = docs.withColumn(own, words_in("text"))
    out = sized.join(copies, F.col("doc_id").eqNullSafe(F.col(d)) & F.col("source").eqNullSafe(F.col(s)) & (F.col(own) == F.col(n)))
    return out.withColumn(own, F.explode(F.sequence(F.lit(1), F.col(k)))).select(*every(docs))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")
