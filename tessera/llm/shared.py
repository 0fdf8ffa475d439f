"""What the corpus operators share: the folder all executors see, size-checked broadcasts, row keys, word splits."""

from __future__ import annotations

import contextlib
import contextvars
import ctypes
import gc
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only after it has been found to have no more bytes than this, written as JSON.
BROADCAST_BYTES = 32 << 20
#: Rows of an Arrow batch that a task has as Python objects at a time.
SLICE_ROWS = 512

#: Working tables of the innermost passing() block.
PASSING: contextvars.ContextVar[list[str]] = contextvars.ContextVar("passing")

#: White space that ends a word, as Java and Python regular expressions write it.
SPACE = r"\x20\x09-\x0D"


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, a temporary one, set from here on, if all runs on this machine; else an error,
    as executors of a cluster would each write to a disk of their own."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def on_files(spark: SparkSession, path: str):
    to = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return to.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), to


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses; it goes when the application ends, or with the passing() block that it is named in."""
    path = f"{shared_dir(spark)}/tessera/{name}-{uuid.uuid4().hex}"
    fs, to = on_files(spark, path)
    fs.deleteOnExit(to)
    if (inside := PASSING.get(None)) is not None:
        inside.append(path)
    return path


def sweep(spark: SparkSession) -> None:
    """Lets Spark's cleaner remove the shuffle files of plans that nothing refers to any more. It waits for the driver's garbage collector,
    which seldom runs on a driver with memory to spare; the first of the two runs may only find what the second can give up."""
    gc.collect()
    for _ in range(2):
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


@contextlib.contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """The working tables named inside go when the block ends: what is to last must be written, to a path named outside, within the block."""
    paths: list[str] = []
    before = PASSING.set(paths)
    try:
        yield
    finally:
        PASSING.reset(before)
        for path in paths:
            fs, to = on_files(spark, path)
            fs.delete(to, True)
        sweep(spark)


def settled(spark: SparkSession, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The rows of make() as a table, without the working tables that they were made through."""
    path = new_path(spark, name)
    with passing(spark):
        df = make()
        schema = df.schema
        df.write.option("compression", "zstd").parquet(path)
        del df
    return spark.read.schema(schema).parquet(path)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: computed once, without lineage, safe when an executor goes."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if all its rows, written as JSON, have at most that many bytes; else as it is, for a shuffled join that AQE can
    split. A first look at the number of rows settles it for large tables.

    df should be cheap to read: a table written by materialize()."""
    if df.count() > most // 16:
        return df
    found = df.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))) + 16).alias("n")).first()
    return F.broadcast(df) if (found.n or 0) <= most else df


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """df through run, which gets Arrow batches of at most SLICE_ROWS rows. Columns that run passes on stay as they are: ids keep all their
    bits beside nulls. A worker gives its memory back to the system when a task ends, so idle ones of an executor hold little."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())
        try:
            yield from run(b.slice(i, SLICE_ROWS) for b in batches for i in range(0, b.num_rows, SLICE_ROWS))
        finally:
            gc.collect()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except AttributeError:  # not glibc
                pass

    return df.mapInArrow(task, schema)


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """Never null, and equal only for rows with equal id and text: rows that repeat in full get equal results."""
    return F.concat_ws(":", F.coalesce(F.col(doc_id).cast("string"), F.lit("null")), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")), F.col(text).isNull().cast("string"))


def columns(df: DataFrame, names: list[str], types: list[str]) -> DataFrame:
    """Only the named columns, cast; what else df has, under whatever names, plays no part."""
    return df.select(*(F.col(f"`{n}`").cast(t).alias(n) for n, t in zip(names, types, strict=True)))


def free(df: DataFrame, *names: str) -> list[str]:
    """The names, with as many underscores before them as it takes that no column of df has them, in any case of letters."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        taken.add(n.lower())
        out.append(n)
    return out


def same_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """The named columns, whatever characters their names have."""
    return df.select(*(F.col(f"`{n.replace('`', '``')}`") for n in names))
