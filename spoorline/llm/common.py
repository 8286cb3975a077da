"""What the ten operators share: work tables, row keys and Arrow helpers."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress
from contextvars import ContextVar

import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where it is unset, a local session, as in tests, gets one of
    its own, and a cluster an error: executors would each write to their own disk."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is unset: name a folder that the driver and all executors share")
        path = f"file://{tempfile.mkdtemp(prefix='spoorline-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


class _Scratch:
    """Tables and broadcasts of a scratch() block; what it keeps belongs to the block around it, if there is one."""

    def __init__(self, outer: _Scratch | None):
        self.outer, self.used = outer, []


_scratch: ContextVar[_Scratch | None] = ContextVar("scratch", default=None)
#: Folders of this process that nothing has deleted yet.
_left: set[str] = set()


def broadcast(spark: SparkSession, value) -> Broadcast:
    """value, of a size that doesn't depend on the input, for all tasks. Within scratch() it is taken back at the end."""
    out = spark.sparkContext.broadcast(value)
    if block := _scratch.get():
        block.used.append(out)
    return out


def saved(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write df as a table in the shared folder and read it again: lineage is cut, and a lost executor loses nothing."""
    spark = df.sparkSession
    folder = f"{shared_dir(spark)}/spoorline/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(f"{folder}/{name}")
    _left.add(folder)
    block = _scratch.get()
    if keep and block:
        block = block.outer
    if block:
        block.used.append(folder)
    return spark.read.schema(df.schema).parquet(f"{folder}/{name}")


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    _left.discard(folder)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables saved within, but for those with keep, are deleted at the end, and broadcasts taken back: Python workers live on
    and would hold them. What goes on may read only the kept tables; a block around this one deletes them at its own end."""
    token = _scratch.set(block := _Scratch(_scratch.get()))
    try:
        yield
    finally:
        _scratch.reset(token)
        for x in block.used:
            x.destroy() if isinstance(x, Broadcast) else _delete(spark, x)


def discard(spark: SparkSession) -> None:
    """Delete all tables that this process has saved: for when no result is read any more."""
    for folder in sorted(_left):
        _delete(spark, folder)


def row_key(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> Column:
    """A hash of id and text: rows that are equal in both share it, and share their results. Never null."""
    t = F.coalesce(docs[text].cast("string"), F.lit(""))
    return F.unhex(F.md5(F.concat(F.coalesce(docs[doc_id].cast("long").cast("string"), F.lit("-")), F.lit(" "), t)))


def keyed(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(rk, doc_id, text) of docs, text never null. Joins on rk are safe for null ids, repeated ids and repeated rows."""
    return docs.select(row_key(docs, text, doc_id).alias("rk"), docs[doc_id].cast("long").alias("doc_id"), F.coalesce(docs[text].cast("string"), F.lit("")).alias("text"))


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """run, with what it has freed given back to the system at its end: Python workers live on between stages."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with suppress(OSError, AttributeError):  # only where the C library has it
                ctypes.CDLL(None).malloc_trim(0)

    return whole


def over_batches(make: Callable[[], Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]]):
    """A function for mapInArrow: make() runs once a task and gives what turns one batch into others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for b in batches:
            if b.num_rows:
                yield from step(b)

    return released(run)


def texts(b: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """A string column as UTF-8 bytes; null as empty."""
    return [x or b"" for x in b.column(name).cast(pa.binary()).to_pylist()]
