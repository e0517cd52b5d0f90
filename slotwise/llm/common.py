"""Shared helpers: scratch tables in the cluster's shared folder, words, output columns."""

from __future__ import annotations

import tempfile
import uuid
from bisect import bisect_right
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word, in Spark's and Python's regular expressions.
WORD = r"[^\x20\x09-\x0D]+"


#: Folder of each local application whose session names none; the setting itself can't be changed in a running one.
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset: a new one on a single machine (local tests), else an error,
    since executors that don't share a disk would each write to their own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        found = _OWN.get(app) or _OWN.setdefault(app, tempfile.mkdtemp(prefix="slotwise-"))
    return found.rstrip("/")


#: Folder of scratch tables and list of their paths, of the calling thread's context.
_FOLDER: ContextVar[str | None] = ContextVar("folder", default=None)
_PATHS: ContextVar[list[str] | None] = ContextVar("paths", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """Scratch tables of what runs inside go to a folder of their own, which is deleted at the end."""
    folder = f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"
    token = _FOLDER.set(folder)
    try:
        yield folder
    finally:
        _FOLDER.reset(token)
        delete(spark, folder)


@contextmanager
def keeping(spark: SparkSession, *labels: str) -> Iterator[None]:
    """Of the scratch tables that are written inside, those of these labels stay, for an enclosing block to decide on; the others are deleted at the end."""
    paths: list[str] = []
    token = _PATHS.set(paths)
    try:
        yield
    finally:
        _PATHS.reset(token)
    around = _PATHS.get()
    for path in paths:
        if path.rsplit("/", 1)[1].rsplit("-", 1)[0] not in labels:
            delete(spark, path)
        elif around is not None:
            around.append(path)


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the scratch folder, or in the shared one where there is none."""
    path = f"{_FOLDER.get() or shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    paths = _PATHS.get()
    if paths is not None:
        paths.append(path)
    return path


#: Rows that a task writes at least, where it's known that a table has no more than some number.
ROWS_A_TASK = 100_000


def materialize(df: DataFrame, label: str, most_rows: int | None = None) -> DataFrame:
    """Write df to a scratch table and reread it.

    Cuts the lineage, so that a lost executor costs no recomputation of what lies before, and
    makes both sides of a later join plain exchanges, which AQE can split when a key is hot.
    most_rows: a bound on df's rows, so that a small table is not as many files as a shuffle has partitions.
    """
    path = new_path(df.sparkSession, label)
    if most_rows is not None:
        df = df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-most_rows // ROWS_A_TASK)))
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Taken:
    """Which stretches of a text some spans cover: one sort, then a binary search a question."""

    def __init__(self, spans):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for a, b in sorted((s[0], s[1]) for s in spans):
            if self.ends and a <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def touches(self, a: int, b: int) -> bool:
        i = bisect_right(self.ends, a)
        return i < len(self.ends) and self.starts[i] < b


class Rows:
    """Columns of many documents, handed on in batches of some size."""

    def __init__(self, *names: str, rows: int = 50_000):
        self.names, self.rows, self.parts, self.size = names, rows, [], 0

    def add(self, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.parts.append(columns)
        self.size += len(columns[0])
        if self.size >= self.rows:
            yield from self.drain()

    def drain(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*self.parts, strict=True)], names=list(self.names))
            self.parts, self.size = [], 0


#: What a Python worker keeps from task to task, by operator.
_KEPT: dict[str, dict] = {}


def kept(name: str) -> dict:
    return _KEPT.setdefault(name, {})


def let_go_of_kept() -> None:
    """In a worker: empty what operators before have kept. For tasks that need the memory; results don't change."""
    for held in _KEPT.values():
        held.clear()


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def words_of(text: str | None) -> list[bytes]:
    """Words as UTF-8; bytes.split() cuts at exactly the six ASCII white-space characters."""
    return text.encode().split() if text else []


def without(df: DataFrame, names) -> DataFrame:
    """df without columns of these names in any case: a result column replaces its namesake."""
    taken = {n.lower() for n in names}
    return df.select([F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def extended(schema: T.StructType, ddl: str) -> T.StructType:
    """schema with the fields of ddl after its own."""
    return T.StructType([*schema.fields, *T.StructType.fromDDL(ddl).fields])


def delete_table(df: DataFrame) -> None:
    """Delete the table of a materialized df that nothing reads any more."""
    for file in df.inputFiles()[:1]:
        delete(df.sparkSession, file.rsplit("/", 1)[0])


def discard(df: DataFrame) -> None:
    """The same, and let go of finished shuffles' files."""
    delete_table(df)
    release(df.sparkSession)


def release(spark: SparkSession) -> None:
    """Let go of finished shuffles' files: the driver's cleaner removes them once their plans are garbage.

    The end of the last query takes a moment to reach Spark's listeners, which hold its plan until then.
    """
    import gc
    import time

    gc.collect()
    time.sleep(1)
    spark._jvm.System.gc()


def delete(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
