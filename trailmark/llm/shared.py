"""Storage helpers shared by the training-data operators.

Intermediate tables cut lineage in the folder that ``spark.checkpoint.dir``
names, which every executor and the driver can reach; a lost executor then
only costs the tasks that it was running.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import re
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa

from pyspark.sql import DataFrame, SparkSession, functions as F

from trailmark.llm import hashing

BLOOM_BITS = 24
BATCH = {"spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}
_LOCAL: dict[str, str] = {}
_FOLDERS: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, or of ``SparkContext.setCheckpointDir``.

    Where neither is set, a session on one machine (``local[n]``) gets a temporary
    folder; a cluster has no folder that all its machines share, so this raises.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
        found = _LOCAL.setdefault(sc.applicationId, "file://" + tempfile.mkdtemp(prefix="trailmark-"))
    return found.rstrip("/")


def stage_folder(spark: SparkSession) -> str:
    """This application's part of the shared folder, deleted when the application ends."""
    app = spark.sparkContext.applicationId
    folder = f"{shared_dir(spark)}/trailmark/{app}"
    if folder not in _FOLDERS:
        target = spark._jvm.org.apache.hadoop.fs.Path(folder)
        files = target.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(target)
        files.deleteOnExit(target)
        _FOLDERS.add(folder)
    return folder


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings for the time of one write."""
    before = {key: spark.conf.get(key, None) for key in values}
    try:
        for key, value in values.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def stage(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here.

    Rows pass to Python in batches of at most 4 MB (or one row): a batch is held by the JVM, off its
    heap, and by the worker at once, and 10 000 texts or packed rows would be tens of MB each.
    """
    spark = df.sparkSession
    path = f"{stage_folder(spark)}/{name}-{uuid.uuid4().hex}"
    with settings(spark, BATCH):
        df.write.parquet(path, compression=compression)
    out = spark.read.schema(df.schema).parquet(path)
    out._stage_path = path
    return out


def drop_stage(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_stage_path", None)
        if path:
            jvm = df.sparkSession._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop shuffle files of frames that went out of scope."""
    for _ in range(2):  # Python's references go first, then the JVM's
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over a partition, giving freed memory back to the machine when the partition ends.

    Workers live on for later stages; what theirs left behind would count beside them.
    """

    @functools.wraps(run)
    def whole(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            hashing.forget()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
                ctypes.CDLL(None).malloc_trim(0)

    return whole


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id is in ``ids`` (unique), with the columns of both.

    A bit table of fixed size, 2**24 bits, keeps most other texts out of the shuffle.
    """
    bit = F.pmod(F.xxhash64(F.lit("bit"), "doc_id"), F.lit(1 << BLOOM_BITS))
    words = ids.select(F.shiftright(bit, 6).alias("word"), (bit % 64).cast("int").alias("bit")).groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
    near = docs.withColumn("word", F.shiftright(bit, 6)).join(F.broadcast(words), "word").where(F.expr(f"shiftrightunsigned(bits, cast(pmod(xxhash64('bit', doc_id), {1 << BLOOM_BITS}L) % 64 as int)) & 1L = 1L")).drop("word", "bits")
    return near.join(ids.hint("shuffle_hash"), "doc_id")
