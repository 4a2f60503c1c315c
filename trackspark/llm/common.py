"""What the corpus operators share: scratch tables, skew-safe joins, ranks."""

from __future__ import annotations

import ctypes
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar
from functools import lru_cache
from typing import Any

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ids or small rows that one broadcast may hold; more go through a shuffle.
BROADCAST_ROWS = 500_000
#: A group is heavy with more than one row in so many: so at most this many are.
HEAVY_GROUPS = 1024
#: Rows that one sorted run (a window partition) should hold.
RUN_ROWS = 20_000
#: A table of a few numbers a row has one file for so many shuffle partitions.
NARROW = 8

ASCII_SPACE = "[\\x20\\x09-\\x0D]+"
NOT_SPACE = "[^\\x20\\x09-\\x0D]+"


class Scratch:
    """Folders and broadcasts that are given up together, by :func:`release`."""

    def __init__(self) -> None:
        self.folders: list[str] = []
        self.broadcasts: list[Broadcast] = []


_unscoped = Scratch()  # folders made outside of any block
_scope: ContextVar[Scratch | None] = ContextVar("scratch", default=None)


@contextmanager
def scratch() -> Iterator[Scratch]:
    """What is made in the block, apart from what other blocks and threads make."""
    made = Scratch()
    before = _scope.set(made)
    try:
        yield made
    finally:
        _scope.reset(before)


Step = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


#: Rows that go to a Python worker at a time, and about how many bytes: a batch of long texts must
#: fit in memory, in the executor's JVM as in the worker.
BATCH_ROWS, BATCH_BYTES = 1_000, 4 << 20


def small_batches(spark: SparkSession) -> None:
    """From here on the session's Arrow batches have BATCH_ROWS rows and about BATCH_BYTES bytes at most.

    So have the batches in which Parquet is read, but for their bytes, which Spark does not limit.
    """
    for name in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize"):
        if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
            spark.conf.set(name, BATCH_ROWS)
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    size = re.fullmatch(r"(\d+)([kmg]?)b?", spark.conf.get(name).strip().lower())
    if size is None or int(size[1]) << 10 * " kmg".index(size[2] or " ") > BATCH_BYTES:
        spark.conf.set(name, BATCH_BYTES)


#: What this Python worker holds from task to task for the steps of a kind: how to let go of it.
_held: dict[str, Callable[[], None]] = {}


def hold(kind: str, let_go: Callable[[], None]) -> None:
    """Something is held from now on for :func:`tidy` steps that keep ``kind``; other steps call ``let_go``."""
    _held[kind] = let_go


def keep_only(kind: str | None) -> None:
    for other in _held.keys() - {kind}:
        _held.pop(other)()


def give_back() -> None:
    """Return the free memory of Arrow, and that of the C library where it can (glibc), to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if os.name == "posix" else None
    if trim is not None:
        trim(0)


def tidy(step: Step, kind: str | None = None) -> Step:
    """``step``, after which its Python worker, which other stages use next, gives its free memory back.

    What the worker still holds for steps of another ``kind`` goes first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only(kind)
        yield from step(batches)
        give_back()

    return run


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where a local session names none (as in tests) one is made for it; on a
    cluster a folder of one machine is of no use, so there it must be named.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = _local_dir()
    return found.rstrip("/")


@lru_cache(maxsize=1)
def _local_dir() -> str:
    return f"file://{tempfile.mkdtemp(prefix='trackspark-')}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, which :func:`release` deletes.

    Its parent's name keeps it out of what Spark reads from a folder above.
    """
    path = f"{shared_dir(spark)}/_trackspark/{name}-{uuid.uuid4().hex}"
    (_scope.get() or _unscoped).folders.append(path)
    return path


def told(spark: SparkSession, value: Any) -> Broadcast:
    """A broadcast of ``value``, which :func:`release` destroys if made in a block of :func:`scratch`."""
    found = spark.sparkContext.broadcast(value)
    if made := _scope.get():
        made.broadcasts.append(found)
    return found


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage with files that outlive lost executors, and gives
    later steps column pruning, cheap counts and one fixed row order per file.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def narrow_files(spark: SparkSession) -> int:
    """Files for a scratch table whose rows are a few numbers, which other tables' partitions would cut too small.

    On a local file system Hadoop starts a ``chmod`` from the executor for each
    file, its checksums and its task's folder. Until it runs, that process
    shares the memory of the JVM, and counts as large.
    """
    return -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // NARROW)


def release(spark: SparkSession, made: Scratch | None = None) -> None:
    """Delete the scratch tables of a block, and the broadcasts; by default tables made in none.

    Call it once what was read from them is stored.
    """
    made = made or _unscoped
    jvm, hadoop = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for name in made.folders:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(hadoop).delete(path, True)
    for shared in made.broadcasts:
        shared.destroy()
    made.folders.clear()
    made.broadcasts.clear()


def join_groups(
    rows: DataFrame, groups: DataFrame, key: str, size: str, total: int, how: str = "left"
) -> DataFrame:
    """``rows`` joined with one row per ``key`` of ``groups``, safe for hot keys.

    ``size`` is the number of rows of a group, ``total`` that of all of them.
    Groups of more than ``total / 1024`` rows are 1024 at most, whatever the
    data: their rows meet them by a broadcast and stay where they are. Only the
    rows of other groups are shuffled, and no task gets one large group.
    Both inputs are read twice, so they should be scratch tables.
    """
    line = max(1, total // HEAVY_GROUPS)
    heavy = groups.filter(F.col(size) > line).withColumn("__heavy", F.lit(True))
    light = groups.filter(F.col(size) <= line)
    extra = [c for c in groups.columns if c != key]
    met = rows.join(F.broadcast(heavy), key, "left")
    stay = met.filter("__heavy").drop("__heavy")
    move = met.filter("__heavy is null").drop("__heavy", *extra).join(light, key, how)
    return stay.unionByName(move)


def without_ids(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` without the rows whose id is in ``ids`` (a scratch table, one column).

    A short list is broadcast; a long one is joined by a shuffle. Rows with a
    null id stay.
    """
    gone = ids.toDF("__gone")
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    return docs.join(gone, docs[id_col] == F.col("__gone"), "left_anti")


def only_ids(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` with the rows whose id is in ``ids``; as :func:`without_ids`."""
    wanted = ids.toDF("__wanted")
    if wanted.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    return docs.join(wanted, docs[id_col] == F.col("__wanted"), "left_semi")


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A scratch table, marked for broadcast if it holds ``rows`` rows or fewer."""
    return F.broadcast(df) if df.count() <= rows else df


def ranked(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """``df`` with ``rank`` (0, 1, 2 ...) by ``order``, without a one-task sort.

    Rows are dealt out by range and numbered within each range; the ranges'
    starts are a table of one row per range.
    """
    spark = df.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    low = (1 << 33) - 1  # the row number within its partition
    placed = materialise(
        df.repartitionByRange(ranges, *order)
        .sortWithinPartitions(*order)
        .withColumn("__range", F.spark_partition_id())
        .withColumn("__at", F.monotonically_increasing_id().bitwiseAND(F.lit(low))),
        name,
    )
    counts = placed.groupBy("__range").count().orderBy("__range").collect()  # one row per range
    starts, at = [], 0
    for r in counts:
        starts.append({"__range": r["__range"], "__start": at})
        at += r["count"]
    # From Arrow: of Python rows Spark makes an RDD, which starts further Python workers.
    kinds = pa.schema([("__range", pa.int32()), ("__start", pa.int64())])
    start = spark.createDataFrame(pa.Table.from_pylist(starts, schema=kinds))
    return (
        placed.join(F.broadcast(start), "__range")
        .withColumn("rank", F.col("__start") + F.col("__at"))
        .drop("__range", "__at", "__start")
    )
