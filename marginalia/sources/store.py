"""Stage results as Parquet, so that a call is never repeated because Spark computes a branch again, or a run starts anew."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache, cached_property

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@cache
def _own_dir() -> str:
    return tempfile.mkdtemp(prefix="marginalia-")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names; where none is named, a temporary one in local mode, and an error elsewhere."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _own_dir()


def settled(rows: DataFrame) -> DataFrame:
    """rows, computed once and kept by a reliable checkpoint in the shared folder; partitions and their order stay."""
    context = rows.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(rows.sparkSession))
    return rows.checkpoint(eager=True)


#: Spark's setting that a query's shuffle files go when it ends; else they stay until the driver happens to collect garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What is written herein leaves no shuffle files: it is read back as Parquet, and never by its plan."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


class Ledger:
    """Replies of calls, each committed as it comes: a file under the hash of what was asked.

    Tasks read it before they ask, so that a task that fails amid its calls, or a run that starts anew, asks only what has no
    reply yet. A reply is written beside its place and moved there, so none is half there; of two tasks that ask the same at
    once the last one's stays. Goes to the workers by its URI, which pyarrow must be able to open.
    """

    def __init__(self, uri: str):
        self.uri = uri if "://" in uri or uri.startswith(("file:", "/")) else os.path.abspath(uri)

    @cached_property
    def _place(self) -> tuple:
        return fs.FileSystem.from_uri(self.uri)

    def __getstate__(self) -> dict:
        return {"uri": self.uri}

    def _path(self, key: str) -> str:
        return f"{self._place[1]}/{key[:2]}/{key}"

    def get(self, key: str) -> str | None:
        try:
            with self._place[0].open_input_stream(self._path(key)) as f:
                return f.read().decode()
        except FileNotFoundError:
            return None

    def put(self, key: str, reply: str) -> None:
        system, path = self._place[0], self._path(key)
        system.create_dir(os.path.dirname(path))
        beside = f"{path}.{uuid.uuid4().hex}"
        with system.open_output_stream(beside) as f:
            f.write(reply.encode())
        system.move(beside, path)

    def drop(self) -> None:
        system, path = self._place
        if system.get_file_info(path).type == fs.FileType.Directory:
            system.delete_dir(path)


class StageStore:
    """One folder for each stage. Rows are named by key columns; what is there already isn't asked for again.

    While a stage runs, its replies are in a ledger beside it, one by one; once the stage is written the ledger goes. A store
    without a root has a folder that no other run can find (own).
    """

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = spark
        self.own = root is None
        self._scratch: list[str] = []
        self.root = root or f"{shared_dir(spark).rstrip('/')}/stages-{uuid.uuid4().hex}"

    def ledger(self, stage: str) -> Ledger:
        return Ledger(f"{self.root}/{stage}-ledger")

    def path(self, stage: str) -> str:
        return f"{self.root}/{stage}"

    def _place(self, path: str) -> tuple:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def _found(self, stage: str, schema) -> DataFrame | None:
        system, where = self._place(self.path(stage))
        return self.spark.read.schema(schema).parquet(self.path(stage)) if system.exists(where) else None

    def _write(self, rows: DataFrame, path: str) -> None:
        with _shuffles_dropped(self.spark):
            rows.write.mode("append").parquet(path, compression="zstd")

    def _delete(self, path: str) -> None:
        system, where = self._place(path)
        system.delete(where, True)

    def once(self, stage: str, requests: DataFrame, keys: list[str], run) -> DataFrame:
        """run(requests not yet answered), appended to the stage; then all answers to the requests.

        run keeps the keys and prompt_hash. Prompts are built once in a new stage; in one that has answers, once to see what
        is new and once to ask it.
        """
        asked = requests.withColumn("prompt_hash", F.sha2(F.concat_ws("\0", "model", "system", "user"), 256))
        names = [*keys, "prompt_hash"]
        schema = run(asked.limit(0)).schema
        before = self._found(stage, schema)
        if before is None:
            self._write(run(asked), self.path(stage))
            done = self.spark.read.schema(schema).parquet(self.path(stage))
        else:
            wanted = self.keep(f"{stage}-asked", asked.select(*names))
            new = wanted.join(before.select(*names), names, "left_anti").distinct()
            self._write(run(asked.join(new, names, "left_semi")), self.path(stage))
            done = self.spark.read.schema(schema).parquet(self.path(stage)).join(wanted, names, "left_semi")
        self.ledger(stage).drop()
        return done.dropDuplicates(names).drop("prompt_hash")

    def keep(self, name: str, rows: DataFrame) -> DataFrame:
        """rows, written once and read back: what many branches read is neither computed again nor planned again."""
        return self._kept(f"{self.path(name)}-{uuid.uuid4().hex}", rows)

    def _kept(self, path: str, rows: DataFrame) -> DataFrame:
        self._write(rows, path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def scratch(self, rows: DataFrame) -> DataFrame:
        """rows, written once and read back until the next drop_scratch()."""
        self._scratch.append(f"{self.path('scratch')}-{uuid.uuid4().hex}")
        return self._kept(self._scratch[-1], rows)

    def drop_scratch(self) -> None:
        while self._scratch:
            self._delete(self._scratch.pop())

    def drop(self, stage: str) -> None:
        """A stage's replies, for those that are kept elsewhere and cost nothing to ask for again."""
        self._delete(self.path(stage))
