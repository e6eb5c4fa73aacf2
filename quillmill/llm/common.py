"""Shared folders, tables and small helpers of the ``llm`` operators."""

from __future__ import annotations

import atexit
import ctypes
import functools
import inspect
import re
import shutil
import tempfile
import uuid

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_TRIM = "systemTrimNativeHeap"  # HotSpot's diagnostic command


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session leaves it unset on a single machine (as in tests) is
    a folder of our own taken and recorded in the session.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        own = tempfile.mkdtemp(prefix="quillmill-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        at = "file://" + own
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/quillmill/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it again.

    The files survive the loss of any executor, unlike cached blocks.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    release_driver(spark)
    return spark.read.schema(df.schema).parquet(path)


def remove(df: DataFrame) -> None:
    """Delete a table that ``written`` made, once nothing reads it any more."""
    spark = df.sparkSession
    for f in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cleanup(spark: SparkSession) -> None:
    """Delete all tables and files that operators left in the shared folder; call it when their results are written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/quillmill")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def release() -> None:
    """Give memory that is free again back to the system; a worker that waits for its next task would keep it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim:
        trim(0)


def release_driver(spark: SparkSession) -> None:
    """The same for the driver: for its Python, and for what its JVM holds outside of the heap.

    The JVM's compilers and threads free much in small pieces, which glibc keeps
    for each thread; over many jobs that adds up. HotSpot can hand it back on
    glibc (tried with Java 17.0.19); a JVM that cannot is left as it is.
    """
    release()
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    name = jvm.java.lang.Class.forName
    # the server's class is not exported to Py4J, its interface is
    kinds = gateway.new_array(jvm.java.lang.Class, 4)
    for i, kind in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
        kinds[i] = name(kind)
    args = gateway.new_array(jvm.java.lang.Object, 4)
    args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), _TRIM
    try:
        name("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)
    except Py4JJavaError:  # no such command
        pass


def released(group):
    """The function of a group of rows, with ``release`` after each group."""

    @functools.wraps(group)
    def run(*args):
        try:
            return group(*args)
        finally:
            release()

    run.__signature__ = inspect.signature(group)
    return run


def fold(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a row without id counts as the empty id."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


class settings:
    """Session settings held while a block runs its own jobs."""

    def __init__(self, spark: SparkSession, **values):
        self.conf, self.values = spark.conf, {k.replace("__", "."): str(v) for k, v in values.items()}

    def __enter__(self):
        self.old = {k: self.conf.get(k, None) for k in self.values}
        for k, v in self.values.items():
            self.conf.set(k, v)

    def __exit__(self, *_):
        for k, v in self.old.items():
            self.conf.unset(k) if v is None else self.conf.set(k, v)
