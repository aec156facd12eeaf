"""Operator 2: a quality classifier: logistic regression on hashed word n-grams, trained with FTRL-proximal updates.

A text's features are its words, pairs of neighbouring words and words' last two bytes (A-Z lower-cased), hashed to
2 ** BITS coordinates; all pairs of one word twice share a coordinate. A feature's value is its count over the square root of all counts. Scores are sparse dot products, through the logistic
function, of whole texts.

Training takes at most FIT_ROWS labelled rows, those whose hashed doc_id is least (a bounded sample, for every input
size), in EPOCHS passes in that order, in one task; weights of fixed size (2 ** BITS floats, 1 MB) go to all tasks.
Only texts and labels are used: doc_id decides which rows are learned from, never a score.

Cases: null or empty text: the score of the bias alone; null label: not learned from; a null doc_id: scored, not held out
and without a label; no labelled row: every score is 0.5; repeated rows score alike; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm.common import every, mixed, side_by_side, span_hashes, table, utf8, word_spans

BITS = 18
FIT_ROWS = 6_000
EPOCHS = 3
ALPHA, BETA, L1, L2 = 1.0, 1.0, 0.05, 0.1

#: The coordinate of all pairs of equal words.
SAME = np.uint64(0x5851F42D4C957F2D)


def features(texts: list[bytes]) -> Iterator[np.ndarray]:
    """Coordinates of each text's words, words' ends and pairs."""
    for own in side_by_side([t.lower() for t in texts]):
        a, starts, ends, cut = word_spans(own)
        words = span_hashes(a, starts, ends)
        with np.errstate(over="ignore"):
            last = a[ends - 1].astype(np.uint64) | np.where(ends - starts > 1, a[np.maximum(ends - 2, 0)], 0).astype(np.uint64) << np.uint64(8)
            tails = mixed((last + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
            pairs = np.where(words[1:] == words[:-1], SAME, mixed(words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:]))
        words, tails, pairs = ((x >> np.uint64(64 - BITS)).astype(np.int64) for x in (words, tails, pairs))
        for i, j in zip(np.r_[0, cut], np.r_[cut, len(words)]):
            yield np.concatenate([words[i:j], tails[i:j], pairs[i : max(i, j - 1)]])


def logistic(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def train(texts: list[bytes], labels: list[int]) -> np.ndarray:
    """Weights after EPOCHS passes of FTRL-proximal updates; the last is the bias."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    rows = []
    for found in features(texts):
        at, count = np.unique(found, return_counts=True)
        total = max(1, count.sum())
        rows.append((np.r_[at, 1 << BITS].astype(np.int32), np.r_[count / np.sqrt(total), 1.0].astype(np.float32)))

    def weights(at) -> np.ndarray:
        w = -(z[at] - np.sign(z[at]) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2)
        return np.where(np.abs(z[at]) > L1, w, 0.0)

    for _ in range(EPOCHS):
        for (at, x), y in zip(rows, labels):
            w = weights(at)
            g = (logistic(w @ x) - y) * x
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA * w
            n[at] += g * g
    return weights(slice(None)).astype(np.float32)


def fit(documents: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> np.ndarray:
    """Weights learned from at most `rows` of the labels (doc_id, quality)."""
    sample = labels.where("quality in (0, 1) and doc_id is not null").select("doc_id", F.col("quality").cast("int").alias("quality"))
    sample = sample.withColumn("place", F.xxhash64("doc_id")).orderBy("place", "doc_id", "quality").limit(rows)
    chosen = documents.select("doc_id", utf8("text").alias("text")).join(F.broadcast(sample), "doc_id")

    def run(batches):
        got = [x for b in batches for x in zip(*(b.column(k).to_pylist() for k in range(4)))]
        got.sort()
        if got:
            w = train([x[3] for x in got], [x[2] for x in got])
            yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()], pa.binary())], ["w"])

    found = chosen.select("place", "doc_id", "quality", "text").repartition(1).mapInArrow(run, "w binary").collect()
    return np.frombuffer(found[0]["w"], np.float32) if found else np.zeros((1 << BITS) + 1, np.float32)


def score(docs: DataFrame, weights: np.ndarray, name: str = "score") -> DataFrame:
    """docs with a column `name` (double) that none of them has; the text may be null."""
    sent = docs.sparkSession.sparkContext.broadcast(weights)
    names = docs.columns

    def run(batches):
        w = sent.value
        for b in batches:
            out = []
            for at in features(b.column(len(names)).to_pylist()):
                out.append(float(logistic(w[-1] + w[at].sum(dtype=np.float64) / np.sqrt(max(1, len(at))))))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(out, pa.float64())], [*names, name])

    schema = docs.limit(0).withColumn(name, F.lit(0.0)).schema
    numbered = docs.select(*every(docs), utf8("text")).toDF(*(f"c{i}" for i in range(len(names) + 1)))  # whatever names hold
    return numbered.mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels")
    w = fit(docs, labels.where(~held_out(F.col("doc_id"))))
    out = score(docs, w)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
