"""What several corpus operators share: words, their hashes, settings of the session."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Iterator
from functools import cache

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of bytes other than space and \t\n\v\f\r; bytes.split() cuts at exactly these.
WORD = r"[^\x20\x09-\x0D]+"

def mixed(x: np.ndarray) -> np.ndarray:
    """A fixed 64-bit finaliser: spreads every input bit over the result."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


#: Bytes that one running sum goes over; longer words are hashed alone.
SPAN = 1 << 16
#: Bytes of texts that are hashed side by side.
TOGETHER = 1 << 20
BASE = 0x9E3779B97F4A7C15
SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse, and a number for each byte."""
    powers = []
    for base in (BASE, pow(BASE, -1, 1 << 64)):
        row = [1]
        for _ in range(SPAN - 1):
            row.append(row[-1] * base % (1 << 64))
        powers.append(np.array(row, np.uint64))
    with np.errstate(over="ignore"):
        return *powers, mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_spans(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts' bytes end to end, where each word starts and ends, and how many words are before each text but the first."""
    a = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    edge = np.flatnonzero(np.diff(SPACE[a], prepend=True))
    starts, ends = edge[::2], edge[1::2]
    return a, starts, ends, np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts])[:-1])


def span_hashes(a: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of words: sums of bytes' numbers times powers, shifted to the word's start, with its length, mixed."""
    up, down, letter = _tables()
    out, i = np.empty(len(starts), np.uint64), 0
    with np.errstate(over="ignore"):
        while i < len(starts):
            first = int(starts[i])
            j = int(np.searchsorted(ends, first + SPAN, "right"))
            if j == i:
                out[i] = xxhash.xxh3_64_intdigest(a[first : int(ends[i])].tobytes())
                i += 1
                continue
            s, e = starts[i:j] - first, ends[i:j] - first
            total = np.cumsum(letter[a[first : first + int(e[-1])]] * up[: int(e[-1])])
            own = total[e - 1] - np.where(s > 0, total[s - 1], np.uint64(0))
            out[i:j] = mixed(own * down[s] + (e - s).astype(np.uint64))
            i = j
    return out


def side_by_side(texts: list[bytes], size: int = TOGETHER) -> Iterator[list[bytes]]:
    """The texts in runs of about so many bytes."""
    first, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= size:
            yield texts[first : i + 1]
            first, held = i + 1, 0
    if first < len(texts):
        yield texts[first:]


def word_hashes(texts: list[bytes]) -> Iterator[np.ndarray]:
    """The hashes of each text's words, in order."""
    for own in side_by_side(texts):
        a, starts, ends, cut = word_spans(own)
        yield from np.split(span_hashes(a, starts, ends), cut)


def window_hashes(words: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """64-bit hashes of all runs of k word hashes, by doubling: each run is hashed from two halves and a rest."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.full(n, 0x9E3779B97F4A7C15 + seed, np.uint64)
        level, width, at = mixed(words + np.uint64(seed)), 1, 0
        while width <= k:
            if k & width:
                out = mixed(out * np.uint64(0x2545F4914F6CDD1D) + level[at : at + n])
                at += width
            if 2 * width <= k:
                level = mixed(level[:-width] * np.uint64(0x9FB21C651E98DF25) + level[width:])
            width *= 2
        return out


def free(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before those that columns of df have."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def every(df: DataFrame) -> list[Column]:
    """All columns of df, whatever their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def utf8(text: str | Column) -> Column:
    """The text's bytes; null texts count as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")).cast("binary")


def tuned(spark: SparkSession) -> SparkSession:
    """Batches sent to Python hold at most 2,000 rows and 16 MB, so that long texts don't fill a worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    return spark


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


@cache
def _own_dir() -> str:
    return tempfile.mkdtemp(prefix="marginalia-")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; where none is named, one of our own in local mode, and an error elsewhere."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not found:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = _own_dir()
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(found)
    return found


def saved(df: DataFrame) -> DataFrame:
    """df, computed once: reliable checkpoint in the shared folder, with the lineage cut.

    Shuffle files of what is done go when the JVM collects the objects that stood for them, so it is asked to.
    """
    shared_dir(df.sparkSession)
    out = df.checkpoint(eager=True)
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    return out


def released(spark: SparkSession) -> None:
    """Lets go of the files of DataFrames that nobody holds any more: py4j tells the JVM within a second, so that is waited for."""
    gc.collect()
    time.sleep(1.5)
    spark.sparkContext._jvm.System.gc()


def written(df: DataFrame, name: str) -> DataFrame:
    """df as Parquet under the shared folder, read back with its schema."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Stored:
    """df as Parquet under the shared folder, until it is dropped.

    Iterations use this: a checkpoint keeps the estimated size of what it stands for, which multiplies with every join
    until the driver does nothing but multiply; files have the size that they have.
    """

    def __init__(self, df: DataFrame, name: str):
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tuned(spark).read.parquet(f"{sf_dir}/{name}.parquet")
