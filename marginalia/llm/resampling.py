"""Operator 12: target-distribution importance resampling of documents by hashed n-grams.

Texts become arrays of words and n-grams in SQL; exploded n-grams fall into buckets by crc32; buckets are counted in the
source table and in the target texts; a bucket's gain is the logarithm of the ratio of its smoothed shares. A document's
weight is the mean gain of its n-grams, its score the weight with Gumbel noise drawn from a hash of its id, and the highest
scores are a sample without replacement. Ranks come from one sort dealt by ranges: a row's place in its partition and the
numbers of rows in the partitions before.

Counts are added up before they are shuffled: a task sends a row for each bucket and for each of its documents at most, so
neither a hot word nor a long text meets in one task. The gain table has a row for each bucket; it is broadcast up to
`SMALL` of them and joined by shuffling beyond. To the driver come four totals and one number for each partition of the sort.

Cases: null or empty text, or one without words: no features, weight 0, never drawn; null doc_id: as an empty id, after
others in ties; repeated rows: each counts and each can be drawn; no target texts: T is 0, gains follow the formula; too few
documents for a draw: no ranks; an empty table: no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm.common import saved, table

#: A word is a run of ASCII letters, digits and other characters than ASCII, once A-Z are lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GRAMS = (1, 1)
BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 10
SEED = 2024
#: Rows of a gain table that is broadcast (16 bytes each).
SMALL = 1 << 20


def words_of(text: str) -> Column:
    return F.coalesce(F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def ngrams(words: str, grams: tuple[int, int] = GRAMS) -> Column:
    """All runs of grams[0] to grams[1] consecutive words, joined by one space."""
    w = F.col(words)

    def of(n: int) -> Column:
        if n == 1:
            return w
        starts = F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(w, i, n), " "))

    return F.concat(*(of(n) for n in range(grams[0], grams[1] + 1)))


def bucket_of(feature: str, buckets: int = BUCKETS) -> Column:
    return F.crc32(F.col(feature).cast("binary")) % buckets


def _features(texts: DataFrame, grams: tuple[int, int]) -> DataFrame:
    return texts.select(words_of("text").alias("words")).select(F.explode(ngrams("words", grams)).alias("feature"))


def bucket_counts(texts: DataFrame, grams: tuple[int, int] = GRAMS, buckets: int = BUCKETS) -> DataFrame:
    """bucket, n: a row for each bucket that the texts have."""
    return _features(texts, grams).groupBy(bucket_of("feature", buckets).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def gain_table(docs: DataFrame, target: DataFrame, grams: tuple[int, int] = GRAMS, buckets: int = BUCKETS) -> DataFrame:
    """gain_bucket, gain: a row for each of the buckets."""
    s = bucket_counts(docs, grams, buckets).select("bucket", F.col("n").alias("s"))
    t = bucket_counts(target, grams, buckets).select("bucket", F.col("n").alias("t"))
    both = s.join(t, "bucket", "full").select("bucket", F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("t", F.lit(0)).alias("t"))
    counts = saved(docs.sparkSession.range(buckets).select(F.col("id").alias("bucket")).join(both, "bucket", "left").na.fill(0))
    all_s, all_t = counts.agg(F.sum("s"), F.sum("t")).first()
    # whole numbers are turned to doubles before they are multiplied, so that no product overflows
    of_target = (F.col("t") + 1).cast("double") * float(all_s + buckets)
    of_source = (F.col("s") + 1).cast("double") * float(all_t + buckets)
    return counts.select(F.col("bucket").alias("gain_bucket"), F.floor(1000 * F.log(of_target / of_source)).alias("gain"))


def weigh(docs: DataFrame, gains: DataFrame, grams: tuple[int, int] = GRAMS, buckets: int = BUCKETS) -> DataFrame:
    """row (tells rows apart), doc_id, n_words, n_features, weight."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", words_of("text").alias("words"))
    rows = rows.select("row", "doc_id", F.size("words").alias("n_words"), F.explode_outer(ngrams("words", grams)).alias("feature"))
    rows = rows.withColumn("bucket", bucket_of("feature", buckets)).drop("feature")
    small = F.broadcast(gains) if buckets <= SMALL else gains
    met = rows.join(small, F.col("bucket") == F.col("gain_bucket"), "left")
    summed = met.groupBy("row", "doc_id", "n_words").agg(F.count("bucket").alias("n_features"), F.coalesce(F.sum("gain"), F.lit(0)).alias("total"))
    # floor division of whole numbers
    mean = F.when(F.col("n_features") == 0, F.lit(0)).otherwise(F.expr("(total - pmod(total, n_features)) div n_features"))
    return summed.select("row", "doc_id", F.col("n_words").cast("long").alias("n_words"), "n_features", mean.cast("long").alias("weight"))


def scored(weights: DataFrame, seed: int = SEED) -> DataFrame:
    """weights with score: the weight and Gumbel noise from a hash of the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    return weights.withColumn("score", (F.col("weight") + noise).cast("long"))


def ranked(rows: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """rows with their rank from 1 in the order, by one sort dealt by ranges; the order should tell all rows apart.

    What is sorted is written once, for ranges are sampled and must not be sampled anew; a row's place in its partition is
    the lower 33 bits of its number, the partition the upper ones.
    """
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(name, F.monotonically_increasing_id())
    dealt = saved(dealt)
    part, place = F.shiftright(F.col(name), 33), F.col(name).bitwiseAND(F.lit((1 << 33) - 1))
    before, starts = 0, []
    for r in dealt.groupBy(part.cast("int").alias("part")).count().orderBy("part").collect():
        starts += [before] * (r["part"] + 1 - len(starts))  # partitions without rows too
        before += r["count"]
    return dealt.withColumn(name, F.get(F.lit(starts or [0]).cast("array<long>"), part.cast("int")) + place + 1)


def resample(docs: DataFrame, target: DataFrame, grams: tuple[int, int] = GRAMS, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank (null: not drawn): a row for each of docs."""
    every = saved(scored(weigh(docs, gain_table(docs, target, grams, buckets), grams, buckets), seed))
    able = F.col("n_words") >= least_words
    drawn = every.where(able).count() * percent // 100
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features"), F.col("weight"), F.col("row")]
    placed = ranked(every.where(able), order)
    placed = placed.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    out = placed.unionByName(every.where(~able).withColumn("rank", F.lit(None).cast("long")))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = r"""
WITH RECURSIVE steps AS (
  SELECT i AS byte, i AS c, 0 AS turn FROM range(256) r(i)
  UNION ALL SELECT byte, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, turn + 1 FROM steps WHERE turn < 8
), crc AS (
  SELECT list(c ORDER BY byte) AS t FROM steps WHERE turn = 8
), d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
), b AS (
  SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark
), df AS (SELECT doc_id, unnest(words) AS word FROM d), bf AS (SELECT unnest(words) AS word FROM b),
u AS (SELECT DISTINCT word FROM (SELECT word FROM df UNION ALL SELECT word FROM bf)),
bytes AS (SELECT word, hex(encode(word)) AS h FROM u),
hashed AS (
  SELECT word, xor(4294967295, list_reduce(
    list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, CAST(length(h) AS BIGINT), 2), lambda i: CAST(16 * (instr('0123456789ABCDEF', h[i]) - 1) + instr('0123456789ABCDEF', h[i + 1]) - 1 AS BIGINT))),
    lambda a, x: xor(a >> 8, t[xor(a & 255, x) + 1]))) % 10000 AS bucket
  FROM bytes, crc
), s AS (SELECT bucket, count(*) AS n FROM df JOIN hashed USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM bf JOIN hashed USING (word) GROUP BY bucket),
gains AS (
  SELECT i AS bucket, CAST(floor(1000 * ln(
    (CAST(coalesce(t.n, 0) + 1 AS DOUBLE) * CAST((SELECT coalesce(sum(n), 0) FROM s) + 10000 AS DOUBLE))
    / (CAST(coalesce(s.n, 0) + 1 AS DOUBLE) * CAST((SELECT coalesce(sum(n), 0) FROM t) + 10000 AS DOUBLE)))) AS BIGINT) AS gain
  FROM range(10000) r(i) LEFT JOIN s ON s.bucket = i LEFT JOIN t ON t.bucket = i
), summed AS (
  SELECT doc_id, count(*) AS n, CAST(sum(gain) AS BIGINT) AS total FROM df JOIN hashed USING (word) JOIN gains USING (bucket) GROUP BY doc_id
), weighed AS (
  SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_features,
    CASE WHEN n IS NULL THEN 0 ELSE (total - ((total % n) + n) % n) // n END AS weight FROM d LEFT JOIN summed USING (doc_id)
), noised AS (
  SELECT *, weight + CAST(floor(-1000 * ln(-ln((CAST(concat('0x', substr(sha256(concat('2024:', doc_id)), 1, 8)) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM weighed
), placed AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, 10 * count(*) OVER () // 100 AS drawn FROM noised WHERE n_features >= 20
)
SELECT doc_id, n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score, CASE WHEN place <= drawn THEN place END AS rank
FROM noised LEFT JOIN placed USING (doc_id)
"""
