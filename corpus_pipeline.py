"""A training corpus from documents, in five stages; each reads what the one before has written.

Quality classifier, near duplicates, personal data, mixing, packing. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm import jaccard, mixing, packing, pii, quality
from marginalia.llm.common import every, free, saved, tuned, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 0.5 or more; it learns from the labels that are not held out.

    Cases: null or empty text: scored by the bias alone; no labels: every score is 0.5, so all stay; repeated rows score
    alike; an empty table: no rows; other columns stay, whatever their names.
    """
    labels = tuned(spark).read.parquet(f"{sf_dir}/labels.parquet")
    weights = quality.fit(docs, labels.where(~quality.held_out(F.col("doc_id"))))
    (name,) = free(docs, "quality_score")
    return quality.score(docs, weights, name).where(F.col(name) >= 0.5).select(*every(docs))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row: that with the least doc_id (a null one is the least), then the least hash.

    Cases: rows of one doc_id but different texts are different documents; of repeated rows (equal doc_id and text) one
    stays; texts without words link with nothing, so each such row stays; an empty table: no rows; other columns stay.
    """
    key, of, n, group, turn = free(docs, "row_key", "key_of", "n_grams", "group_key", "turn")
    keyed = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    classes = jaccard.ngram_classes(keyed.select(F.col(key).alias("doc_id"), "text")).distinct()
    classes = classes.select(F.col("doc_id").alias(of), F.col("n_shingles").alias(n), F.col("component_id").alias(group))
    named = saved(keyed.select("doc_id", key).distinct().join(classes, F.col(key) == F.col(of)))
    least = named.where(F.col(n) > 0).groupBy(group).agg(F.min(F.struct("doc_id", key))[key].alias(of), F.lit(0).alias(n))
    kept = least.select(of, F.lit(True).alias(n)).union(named.where(F.col(n) == 0).select(of, F.lit(False)))
    out = keyed.join(kept.distinct(), F.col(key) == F.col(of)).withColumn(turn, F.when(~F.col(n), F.monotonically_increasing_id()))
    return out.dropDuplicates([key, turn]).select(*every(docs))


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind in angle brackets; n_chars, if there, is counted anew.

    Cases: null and empty texts stay as they are; nulls elsewhere: no matter; repeated rows: each is redacted; an empty
    table: no rows; other columns stay, whatever their names.
    """
    return pii.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them.

    Cases: texts without words have nothing to take and go; a null source is a source; repeated rows: each counts, and
    has equally many copies; an empty table: no rows; other columns stay, whatever their names.
    """
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens in sequences.

    Cases: null or empty text: the end id alone; repeated rows and copies are packed each; an empty table: no rows; other
    columns are ignored.
    """
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("quality", good),
    ("near_duplicates", distinct),
    ("pii", redacted),
    ("mixing", mixed),
    ("packing", packed),
]

#: Hashes, models and tokens are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what goes between them is written as Parquet in the shared folder."""
    docs = tuned(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
