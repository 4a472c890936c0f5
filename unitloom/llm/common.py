"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

A_TO_Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: ASCII characters that part words: all but letters and digits.
APART = "".join(chr(c) for c in range(128) if not chr(c).isalnum())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints; a temporary one only where none is set and Spark runs on one
    machine, as in tests."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found and not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not found:  # one machine: all executors are here
        found = f"file://{tempfile.mkdtemp(prefix='unitloom-')}"
        context.setCheckpointDir(found)
        found = context.getCheckpointDir()
    return found.rstrip("/")


#: Spark deletes a query's shuffle files when it ends, instead of when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows that Spark hands to a Python worker at once, and how many where rows hold texts or all hashes of one: both sides keep
#: buffers of a whole batch outside the heap.
BATCH, TEXTS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1024


def tidy(of: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``of``, after which a worker gives back the memory it no longer uses: workers outlive their tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from of(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
        if trim:
            trim(0)

    return run


def materialise(df: DataFrame, label: str, partition_by: str | None = None, batch: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, and a lost executor loses nothing. What was
    shuffled for it is deleted as soon as it is written. Python workers get ``batch`` rows at once, if given."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/unitloom-{label}-{uuid.uuid4().hex}"
    writer = df.write.mode("errorifexists").option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    held = {CLEANUP: "true"} | ({BATCH: str(batch)} if batch else {})
    before = {name: spark.conf.get(name, None) for name in held}
    for name, value in held.items():
        spark.conf.set(name, value)
    try:
        writer.parquet(path)
    finally:
        for name, value in before.items():
            spark.conf.set(name, value) if value is not None else spark.conf.unset(name)
    back = spark.read.schema(df.schema).parquet(path)
    back._written = path
    return back


def release(*written: DataFrame) -> None:
    """Delete what ``materialise`` wrote for these. Only for tables that no later step reads."""
    for df in written:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._written)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z alone."""
    return F.translate(text, A_TO_Z, A_TO_Z.lower())


def plain_words(text: Column) -> Column:
    """Words of letters, digits and characters beyond ASCII, A-Z lower-cased; a null text has none."""
    spaced = F.translate(F.coalesce(text, F.lit("")), A_TO_Z + APART, A_TO_Z.lower() + " " * len(APART))
    return F.array_remove(F.split(spaced, " "), "")


def text_key(text: Column) -> Column:
    """With the document's id, identifies a row by what it holds: equal rows share one key and one result."""
    return F.xxhash64(F.coalesce(text, F.lit("")))
