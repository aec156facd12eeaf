"""Operator 13: vectors compressed to codes of a few bytes: a codebook for each part, learnt by exact rounds in whole numbers.

Components become whole numbers, and tasks turn their rows into blocks, NumPy arrays with a row for each dimension, written
once as Parquet. A round is one treeAggregate over the blocks: squared distances to all entries add up dimension by
dimension, each vector's part goes to its nearest entry, np.add.at adds it to sums and counts of whole numbers, and these
tensors (parts x entries x dimensions, of a fixed size) merge in a reduction tree. So a round sends tensors only, and
results don't depend on how rows are dealt. To the driver come the tensors, the first entries and one bound.

Sums and distances that could exceed 63 bits (components beyond about 10^8) are added as Python's whole numbers, which is
slower and as exact; an error beyond 63 bits is the greatest long.

Cases: vectors that are null, hold null or a non-finite number, or have another length than most (in ties: than the
longest) take no part; a zero vector does; null vec_id: after all others; of equal vec_ids that with the lesser vector
comes first; repeated rows: each counts; fewer vectors than entries: as many entries as vectors; a length that parts don't
divide: the first parts are longer by one; a part without dimensions: entry 0; an empty table: no rows; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm.common import Stored, saved, table

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
#: Rows of a block.
BLOCK = 4_096
#: Groups of labels that are broadcast (up to 24 bytes and a label each); more are joined by shuffling.
SMALL = 10_000
#: Into so many a label is split where its rows are joined with its error.
SALT = 32
LONG = (1 << 63) - 1

Tensors = tuple[list[np.ndarray], list[np.ndarray]]  # of each part, sums (entries x dimensions) and counts


def taking_part(rows: DataFrame) -> DataFrame:
    """vec_id, label (null where the table has none) and x (doubles) of the rows that take part."""
    e = F.col("embedding")
    label = F.col("label") if "label" in rows.columns else F.lit(None).cast("int").alias("label")
    fit = e.isNotNull() & F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    kept = rows.where(fit).select("vec_id", label, e.cast("array<double>").alias("x"))
    lengths = kept.groupBy(F.size("x").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return kept.where(F.size("x") == lengths["n"]) if lengths else kept


def cut(n: int, parts: int = PARTS) -> list[tuple[int, int]]:
    """Where each part of n dimensions starts and ends."""
    sizes = [n // parts + (p < n % parts) for p in range(parts)]
    return [(sum(sizes[:p]), sum(sizes[: p + 1])) for p in range(parts)]


def whole(x: np.ndarray, kind: type, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) as whole numbers of this kind; doubles hold the products exactly, as scale is a power of two."""
    y = np.floor(x * float(scale))
    return y.astype(np.int64) if kind is np.int64 else np.vectorize(int, otypes=[object])(y)


def nearest(block: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each column of block (dimensions x rows) the nearest entry (ties: the lower index) and the squared distance."""
    d = np.zeros((block.shape[1], len(entries)), block.dtype)
    for j, column in enumerate(block):
        gap = column[:, None] - entries[:, j]
        d += gap * gap
    best = d.argmin(1)
    return best, d[np.arange(len(d)), best]


def zero(codebooks: list[np.ndarray]) -> Tensors:
    return [np.zeros_like(c) for c in codebooks], [np.zeros(len(c), np.int64) for c in codebooks]


def add_block(into: Tensors, block: np.ndarray, codebooks: list[np.ndarray]) -> Tensors:
    at = 0
    for total, count, entries in zip(*into, codebooks):
        own = block[at : at + entries.shape[1]]
        best, _ = nearest(own, entries)
        np.add.at(total, best, own.T)
        np.add.at(count, best, 1)
        at += entries.shape[1]
    return into


def merge(a: Tensors, b: Tensors) -> Tensors:
    return [x + y for x, y in zip(a[0], b[0])], [x + y for x, y in zip(a[1], b[1])]


def moved(codebooks: list[np.ndarray], found: Tensors) -> list[np.ndarray]:
    """Each entry becomes the floored mean of its parts; one without parts stays."""
    return [np.where(n[:, None] > 0, s // np.maximum(n, 1)[:, None], c) for c, s, n in zip(codebooks, *found)]


def _blocks(batches: Iterator[pa.RecordBatch], kind: type) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows by BLOCK at most, and their components (dimensions x rows)."""
    for b in batches:
        for at in range(0, b.num_rows, BLOCK):
            own = b.slice(at, BLOCK)
            x = own.column("x").flatten().to_numpy(zero_copy_only=False).reshape(own.num_rows, -1)
            yield own, whole(x.T, kind)


def _packed(block: np.ndarray) -> bytes:
    """Components as 32 bits where they fit."""
    small = block.dtype != object and block.size and abs(int(block.min())) < 1 << 31 and abs(int(block.max())) < 1 << 31
    return pickle.dumps(np.ascontiguousarray(block.astype(np.int32) if small else block))


def _read(data: bytes) -> np.ndarray:
    block = pickle.loads(data)
    return block.astype(np.int64) if block.dtype == np.int32 else block


def learn(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> list[np.ndarray]:
    """Codebooks (entries x dimensions) of the parts of rows' x, after these rounds."""
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "x").select("x").limit(entries).collect()
    if not first:
        return [np.zeros((0, 0), np.int64)] * parts
    kind = kind_of(rows, scale)
    start = whole(np.array([r["x"] for r in first], float), kind, scale)
    codebooks = [start[:, a:b] for a, b in cut(start.shape[1], parts)]

    def run(batches):
        for _, block in _blocks(batches, kind):
            yield pa.RecordBatch.from_arrays([pa.array([_packed(block)], pa.binary())], ["block"])

    stored = Stored(rows.select("x").mapInArrow(run, "block binary"), "vector-blocks")
    try:
        blocks = stored.df.rdd.map(lambda r: _read(bytes(r["block"])))
        for _ in range(rounds):
            now = codebooks
            found = blocks.treeAggregate(zero(now), lambda into, block, now=now: add_block(into, block, now), merge)
            codebooks = moved(now, found)
    finally:
        stored.drop()
    return codebooks


def kind_of(rows: DataFrame, scale: int = SCALE) -> type:
    """np.int64 where sums of rows' components and squared distances of whole vectors fit 62 bits, else object."""
    top, n = rows.agg(F.max(F.array_max(F.transform("x", F.abs))), F.count(F.lit(1))).first()
    size = math.floor((top or 0.0) * scale) + 2
    width = rows.select(F.size("x").alias("n")).first()
    return np.int64 if max(size * (n + 1), (2 * size) ** 2 * max(1, width["n"] if width else 1)) < 1 << 62 else object


def digest(codebooks: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(int(v)) for c in codebooks for e in c for v in e).encode()).hexdigest()


def encode(rows: DataFrame, codebooks: list[np.ndarray], kind: type, scale: int = SCALE) -> DataFrame:
    """vec_id, label, code (two hex digits a part, as many as an index needs beyond 256 entries), error."""
    digits = max(2, len(f"{max(len(codebooks[0]) - 1, 0):x}"))

    def run(batches):
        for own, block in _blocks(batches, kind):
            at, error, codes = 0, np.zeros(own.num_rows, block.dtype), []
            for entries in codebooks:
                best, d = nearest(block[at : at + entries.shape[1]], entries)
                error = error + d
                codes.append([f"{i:0{digits}x}" for i in best.tolist()])
                at += entries.shape[1]
            columns = [pa.array(["".join(c) for c in zip(*codes)], pa.string()), pa.array([min(int(e), LONG) for e in error], pa.int64())]
            yield pa.RecordBatch.from_arrays([own.column("vec_id"), own.column("label"), *columns], ["vec_id", "label", "code", "error"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.select("vec_id", "label", "x").mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def with_label_error(coded: DataFrame) -> DataFrame:
    """coded with label_error, the sum of error over the rows of equal label; errors are added up before they are shuffled."""
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONG).cast("decimal(38,0)")).cast("long")
    sums = saved(coded.groupBy(F.col("label").alias("of_label")).agg(total.alias("label_error")))
    if sums.count() <= SMALL:
        return coded.join(F.broadcast(sums), F.col("label").eqNullSafe(F.col("of_label")), "left").drop("of_label")
    sums = sums.withColumn("of_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    salted = coded.withColumn("salt", F.pmod(F.xxhash64("vec_id", "code", "error"), F.lit(SALT)).cast("int"))
    return salted.join(sums, F.col("label").eqNullSafe(F.col("of_label")) & (F.col("salt") == F.col("of_salt")), "left").drop("of_label", "salt", "of_salt")


def compress(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, list[np.ndarray]]:
    """vec_id, label, code, error of the rows that take part, and the codebooks."""
    kept = taking_part(rows)
    codebooks = learn(kept, parts, entries, rounds, scale)
    return encode(kept, codebooks, codebooks[0].dtype.type if codebooks[0].dtype == np.int64 else object, scale), codebooks


def restore(coded: DataFrame, codebooks: list[np.ndarray], scale: int = SCALE) -> DataFrame:
    """coded with x: the components that its code stands for."""
    digits = max(2, len(f"{max(len(codebooks[0]) - 1, 0):x}"))
    books = F.lit([[[float(v) / scale for v in e] for e in c] for c in codebooks]).cast("array<array<array<double>>>")
    index = F.transform(F.sequence(F.lit(0), F.lit(len(codebooks) - 1)), lambda p: F.conv(F.substr("code", p * digits + 1, F.lit(digits)), 16, 10).cast("int"))
    return coded.withColumn("x", F.flatten(F.transform(index, lambda i, p: F.get(F.get(books, p), i))))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, codebooks = compress(table(spark, sf_dir, "embeddings"))
    coded = with_label_error(saved(coded))
    return coded.select("vec_id", "code", "error", "label_error", F.lit(digest(codebooks)).alias("codebooks_sha256"), "label")


def _sql() -> str:
    """The same in SQL over rows for components; each round is a table of entries made of the one before."""
    near = """
n{r} AS MATERIALIZED (
  SELECT vec_id, part, min(d * 16 + entry) % 16 AS entry, min(d * 16 + entry) // 16 AS d
  FROM (SELECT x.vec_id, x.part, e.entry, CAST(sum((x.v - e.v) * (x.v - e.v)) AS HUGEINT) AS d FROM x JOIN e{r} e USING (part, pos) GROUP BY ALL) GROUP BY ALL
)"""
    move = """
e{s} AS MATERIALIZED (
  SELECT e.part, e.entry, e.pos, coalesce((total - ((total % n) + n) % n) // n, e.v) AS v FROM e{r} e LEFT JOIN (
    SELECT x.part, n{r}.entry, x.pos, CAST(sum(x.v) AS BIGINT) AS total, count(*) AS n FROM x JOIN n{r} USING (vec_id, part) GROUP BY ALL
  ) USING (part, entry, pos)
)"""
    rounds = ",".join(near.format(r=r) + "," + move.format(r=r, s=r + 1) for r in range(ROUNDS)) + "," + near.format(r=ROUNDS)
    return f"""
WITH k AS (
  SELECT vec_id, label, embedding AS a FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0
), x AS MATERIALIZED (
  SELECT vec_id, (i - 1) // (len(a) // 8) AS part, (i - 1) % (len(a) // 8) AS pos, CAST(floor(4096 * CAST(a[i] AS DOUBLE)) AS BIGINT) AS v FROM (SELECT vec_id, a, unnest(range(1, len(a) + 1)) AS i FROM k)
), f AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM k ORDER BY vec_id LIMIT 16),
e0 AS MATERIALIZED (SELECT part, entry, pos, v FROM x JOIN f USING (vec_id)),{rounds},
c AS (
  SELECT vec_id, string_agg(format('{{:02x}}', CAST(entry AS BIGINT)), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM n{ROUNDS} GROUP BY vec_id
), b AS (SELECT sha256(string_agg(CAST(CAST(v AS BIGINT) AS VARCHAR), ',' ORDER BY part, entry, pos)) AS codebooks_sha256 FROM e{ROUNDS})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256, label FROM c JOIN k USING (vec_id), b
"""


SQL = _sql()
