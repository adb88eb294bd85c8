"""Shared plumbing: tables, the shared folder, intermediate tables, workers."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import time
import uuid
from pathlib import Path

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees, from ``spark.checkpoint.dir``.

    A temporary one only in local mode, where driver and executors are one
    process; on a cluster it must be set.
    """
    sc = spark.sparkContext
    known = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not known:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        known = tempfile.mkdtemp(prefix="spanforge-shared-")
        sc.setCheckpointDir(known)
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(known)
    return known.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    relieve_driver(spark)
    return spark.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint of a narrow table."""
    shared_dir(df.sparkSession)
    out = df.checkpoint(eager=True)
    relieve_driver(df.sparkSession)
    return out


def drop_written(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


#: Bytes of rows that go to a Python worker at once, where the session leaves Spark's 64 MB.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES, BATCH_DEFAULT = 8 << 20, 64 << 20


def workers(spark: SparkSession) -> None:
    """Let Python workers import this package when only the driver's path has it, and take rows in small batches.

    A batch stands in the executor's heap, its Arrow buffers and the worker at
    once, on the way there and back, so large ones cost many times their size.
    """
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "")
    if ROOT not in have.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, have) if x)
    if spark.conf.get(BATCH, None) in (None, str(BATCH_DEFAULT), f"{BATCH_DEFAULT}b"):
        spark.conf.set(BATCH, str(BATCH_BYTES))


def trimmed() -> None:
    """What this Python process no longer needs goes back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def _trim_jvm(spark: SparkSession) -> bool:
    """Ask the JVM to return freed native memory; False where it knows no such command (HotSpot on Linux does)."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway

    def array(kind, items):
        out = gateway.new_array(kind, len(items))
        for i, x in enumerate(items):
            out[i] = x
        return out

    try:
        bean = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        kinds = [jvm.Class.forName(x) for x in ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")]
        invoke = jvm.Class.forName("javax.management.MBeanServer").getMethod("invoke", array(jvm.Class, kinds))
        server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        invoke.invoke(server, array(jvm.Object, [bean, "systemTrimNativeHeap", array(jvm.Object, []), array(jvm.String, [])]))
    except Py4JError:
        return False
    return True


#: Seconds that pass at least between two times that the driver gives memory back.
RELIEF_S = 5
_relieved = float("-inf")


def relieve_driver(spark: SparkSession, now: bool = False) -> None:
    """Let the driver give idle memory back, both of its Python and of its JVM, at most every ``RELIEF_S`` seconds.

    A long job starts hundreds of stages. Their plans, events and broadcasts
    are soon garbage, but the JVM rather grows towards its largest heap than
    collects them, and what native code has freed stays with the allocator.
    A collection also lets Spark drop the shuffle files of plans that are gone.
    """
    global _relieved
    if not now and time.monotonic() - _relieved < RELIEF_S:
        return
    _relieved = time.monotonic()
    trimmed()
    spark.sparkContext._jvm.System.gc()
    _trim_jvm(spark)


def lean(run):
    """``run`` over a task's batches; then what the worker no longer needs goes back to the system.

    Workers live on from stage to stage, and the room that one of them leaves
    lying idle is missing to the executor beside it.
    """

    def task(batches):
        yield from run(batches)
        trimmed()

    return task


def text_or_empty(col: str = "text"):
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
