"""What the operators of this subpackage share: input normalisation, durable tables, words."""

from __future__ import annotations

import ctypes
import gc
import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: By application: the folder used where the session names no ``spark.checkpoint.dir``, and whether the package was sent to workers.
_own_dirs: dict[str, str] = {}
_shipped: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, with its scheme: ``spark.checkpoint.dir``; where it is unset, a temporary one if all runs on this machine, else an error."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    app = sc.applicationId
    if app not in _own_dirs:
        if named:
            path = sc._jvm.org.apache.hadoop.fs.Path(named.rstrip("/"))
            fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
            _own_dirs[app] = fs.makeQualified(path).toString().replace("file:/", "file:///", 1).replace("file://///", "file:///")
        elif sc.master.startswith("local"):
            _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="gustline-")
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    return _own_dirs[app]


def new_path(spark: SparkSession, tag: str, keep: bool = True) -> str:
    """A path in the shared folder that nothing has yet; keep: False removes it when the application ends."""
    path = f"{shared_dir(spark)}/gustline/{tag}-{uuid.uuid4().hex}"
    if not keep:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        there = jvm.org.apache.hadoop.fs.Path(path)
        _marked(there.getFileSystem(conf), there)
    return path


def _marked(fs, path) -> None:
    fs.mkdirs(path.getParent())
    fs.mkdirs(path)  # deleteOnExit takes only what is there
    fs.deleteOnExit(path)
    fs.delete(path, True)


@contextmanager
def _setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    old = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if old is None else spark.conf.set(key, old)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back.

    The table outlives any executor, cuts the lineage, and lets Spark drop the
    shuffle files of the query that made it as soon as that query has ended. It
    goes when the application ends.
    """
    spark = df.sparkSession
    path = new_path(spark, tag, keep=False)
    with _setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of an Arrow batch, where the session leaves Spark's default of 64 MB: every task holds some batches outside the heap.
ARROW_BYTES, _DEFAULT_BYTES = "4m", "67108864b"


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each application, as an archive that Spark hands to every executor; make Arrow batches smaller."""
    sc = spark.sparkContext
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", _DEFAULT_BYTES) == _DEFAULT_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
    if sc.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if os.path.isdir(package):  # else the driver itself reads it from an archive, which then is on the workers' path too
        target = os.path.join(tempfile.mkdtemp(prefix="gustline-"), "gustline.zip")
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
            for folder, _, files in os.walk(package):
                for f in files:
                    if f.endswith(".py"):
                        full = os.path.join(folder, f)
                        z.write(full, os.path.relpath(full, os.path.dirname(package)))
        sc.addPyFile(target)
    _shipped.add(sc.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame) -> DataFrame:
    """(doc_id long, text string): null texts become empty, further columns and their names don't matter."""
    ship_package(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def held_out() -> Column:
    """True for the fifth of the documents that labels are never learned from; null ids are not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """(text, label) of at most ``most`` labelled documents that aren't held out.

    The sample is the ``most`` smallest hashes of doc_id, so it is the same on
    every run. A document with two labels counts once, with the larger.
    """
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    rows = rows.groupBy("doc_id").agg(F.max("label").alias("label"))
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)  # TakeOrdered: each task sends its first rows only
    return id_and_text(docs).join(F.broadcast(rows), "doc_id").select("doc_id", "text", "label")


def give_back() -> None:
    """Return what a task has freed to the system: a worker waits for its next task with little more than its modules; so does the driver after numerical work."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # not glibc
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def settle(spark: SparkSession) -> None:
    """Collect the driver's garbage, which also tells executors to drop the broadcasts and shuffle files that nothing refers to any more; then the executors'.

    An executor's heap grows as far as it may, whatever it holds, and stays so
    while Python workers need memory beside it; a full collection gives back what
    is free, classes of ended queries among it. A task for each core reaches all
    executors that are idle; calls at once in one of them are one collection.
    """
    give_back()
    gc.collect()  # plans that only dead Python objects hold
    sc = spark.sparkContext
    sc._jvm.System.gc()
    if not re.match(r"local(\[|$)", sc.master):  # there the driver is the executor
        n = sc.defaultParallelism
        spark.range(0, n, 1, n).select(F.expr("java_method('java.lang.System', 'gc')")).collect()


def in_arrow(df: DataFrame, kernel: Callable, schema: str | StructType) -> DataFrame:
    """df.mapInArrow(kernel, schema) by workers that give back their memory after each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from kernel(batches)
        give_back()

    return df.mapInArrow(run, schema)


def in_bytes(batches: Iterator[pa.RecordBatch], column: int, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in slices whose strings of one column take ``most`` bytes together, or of one row: what a kernel makes of them is bounded by this or by one text."""
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < b.num_rows:
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
            yield b.slice(at, end - at)
            at = end
        if not b.num_rows:
            yield b


def by_text(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    """(ids, texts) of slices of Arrow batches with the columns of ``id_and_text``."""
    for b in in_bytes(batches, 1):
        yield b.column(0).to_pylist(), b.column(1).to_pylist()


def words_of(text: str) -> list[bytes]:
    """The words ``[^\\x20\\x09-\\x0D]+`` as UTF-8: bytes.split cuts at exactly these six characters."""
    return text.encode("utf-8", "surrogatepass").split()
