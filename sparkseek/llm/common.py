"""What the corpus operators share: the word class, durable intermediates, joins with hot keys."""

from __future__ import annotations

import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkseek import shipping

#: Words are runs of anything but ASCII space, tab, newline, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

#: Bytes of an Arrow batch that goes to a Python worker.
BATCH_BYTES = 8 << 20

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BROADCASTS = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")

#: The share of the driver's heap that may be taken when a table is made durable, and the least seconds between two collections.
HEAP_SHARE, COLLECT_S = 0.4, 10

_collected = float("-inf")

#: A key is hot when it holds at least 1/HOT_SHARE of all rows; so there are HOT_SHARE hot keys at most.
HOT_SHARE = 1000


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder that the cluster names in spark.checkpoint.dir; set one of our own only where there is none (tests)."""
    if spark.conf.get("spark.checkpoint.dir", None):
        return
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="sparkseek-checkpoint-"))


def _trim_native_heap(spark: SparkSession) -> None:
    java, new_array = spark._jvm.java.lang, spark.sparkContext._gateway.new_array
    args = new_array(java.Object, 4)
    args[0], args[1] = spark._jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    # by the interface: the server's class is not open to reflection
    invoke = next(m for m in java.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
    invoke.invoke(java.management.ManagementFactory.getPlatformMBeanServer(), args)


def collect_driver(spark: SparkSession) -> None:
    """Let the driver's JVM give back memory that it holds and does not use, every few seconds at most.

    A chain of many jobs fills the whole heap before it is collected, however little of it is alive. Outside the heap every thread frees into
    an arena of the C library, which keeps it; HotSpot on Linux has a command that returns it, and other JVMs go without.
    """
    global _collected
    if time.monotonic() - _collected < COLLECT_S:
        return
    java = spark._jvm.java.lang
    heap = java.Runtime.getRuntime()
    if heap.totalMemory() >= HEAP_SHARE * heap.maxMemory():
        java.System.gc()
    with suppress(Py4JJavaError):
        _trim_native_heap(spark)
    _collected = time.monotonic()


def durable(df: DataFrame) -> DataFrame:
    """Compute df once into the shared checkpoint folder and cut its lineage there."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")  # what was shuffled for it is needed no more
    try:
        return df.select("*").checkpoint(eager=True)  # a new plan: the setting counts when a plan is made
    finally:
        spark.conf.set(_CLEANUP, before) if before is not None else spark.conf.unset(_CLEANUP)
        collect_driver(spark)


@contextmanager
def no_automatic_broadcasts(spark: SparkSession) -> Iterator[None]:
    """Joins that run within are broadcast only where a hint asks for it.

    A long chain of small joins otherwise builds dozens of tables in the driver, and holds threads and memory there for each.
    """
    before = {k: spark.conf.get(k, None) for k in _BROADCASTS}
    for k in _BROADCASTS:
        spark.conf.set(k, "-1")
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def ship(spark: SparkSession) -> None:
    """The package for Python workers, and batches of a bounded size for them, however long the texts."""
    shipping.ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def _table_path(spark: SparkSession) -> str:
    ensure_checkpoint_dir(spark)
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return f"{folder.rstrip('/')}/tables/{uuid.uuid4().hex}"


def table(df: DataFrame, path: str | None = None) -> DataFrame:
    """df written as Parquet to the shared checkpoint folder and read again."""
    path = path or _table_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch_table(df: DataFrame) -> Iterator[DataFrame]:
    """table(df), deleted afterwards: what is made of it has to be durable by then."""
    spark, path = df.sparkSession, _table_path(df.sparkSession)
    try:
        yield table(df, path)
    finally:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def file_order(docs: DataFrame) -> Column:
    """A row's place in the order that a table was written in, of a DataFrame just read from Spark's Parquet files: the file's number, then the row's in it.

    Other DataFrames give their own order, by partition.
    """
    try:
        docs.select("_metadata.row_index", "_metadata.file_name")
    except AnalysisException:
        return F.monotonically_increasing_id()
    part = F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).try_cast("long")
    return F.coalesce(part, F.lit(0).cast("long")) * F.lit(1 << 40) + F.col("_metadata.row_index")


def join_hot(rows: DataFrame, table: DataFrame, key: str, count: Column, total: int, spread: Column, how: str = "inner") -> DataFrame:
    """rows joined with table, which has one row for each key and, as ``count``, the number of rows with that key.

    Keys with at least total / HOT_SHARE rows are joined by a broadcast of at most HOT_SHARE rows of the
    table; all others meet by a shuffle, in which no key is large. ``spread`` is a column of ``rows`` of
    the key's type that equals no key: rows whose key is hot are dealt out by it in the shuffle.
    """
    least = max(2, -(-total // HOT_SHARE))
    others = [c for c in table.columns if c != key]
    hot = table.where(count >= least).select(F.col(key), F.struct(*others).alias("_hot"))
    cold = table.where(count < least).select(F.col(key).alias("_key"), F.struct(*others).alias("_cold"))
    out = rows.join(F.broadcast(hot), key, "left")
    out = out.withColumn("_key", F.when(F.col("_hot").isNull(), F.col(key)).otherwise(spread))
    out = out.join(cold, "_key", "left")
    if how == "inner":
        out = out.where(F.col("_hot").isNotNull() | F.col("_cold").isNotNull())
    got = F.coalesce("_hot", "_cold")
    return out.select(*rows.columns, *[got[c].alias(c) for c in others])

