"""Tables in the folder that driver and executors share (``spark.checkpoint.dir``)."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession


_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch_dir(spark: SparkSession) -> str:
    """A new path in the shared folder.  Only where none is set and Spark is one process is a folder of this machine used."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="twinlens-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/twinlens-{uuid.uuid4().hex}"


def _file_system(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a path through Hadoop's file system, wherever it is."""
    target, system = _file_system(spark, path)
    system.delete(target, True)


def exists(spark: SparkSession, path: str) -> bool:
    target, system = _file_system(spark, path)
    return system.exists(target)


def read_text(spark: SparkSession, path: str) -> str:
    target, system = _file_system(spark, path)
    stream = system.open(target)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file in one step: a reader sees the old text or the new one."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    target, system = _file_system(spark, path)
    part = hadoop.Path(f"{path}-{uuid.uuid4().hex}")
    system.mkdirs(target.getParent())
    stream = system.create(part, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    over = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    over[0] = hadoop.Options.Rename.OVERWRITE
    hadoop.FileContext.getFileContext(target.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(part, target, over)


def children(spark: SparkSession, path: str) -> list[str]:
    target, system = _file_system(spark, path)
    return [str(x.getPath().getName()) for x in system.listStatus(target)] if system.exists(target) else []


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Queries that run inside give their shuffle files back when they end, not when the driver next collects garbage."""
    before = spark.conf.get(_FREE, "false")
    spark.conf.set(_FREE, "true")
    try:
        yield
    finally:
        spark.conf.set(_FREE, before)


def trim_jvm(spark: SparkSession) -> None:
    """Native memory that the driver's JVM has freed goes back to the system.  The C library keeps it otherwise, an arena for
    some of the threads each, and planning hundreds of stages takes much of it for a short time.  Nothing happens where the
    JVM has no such command."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway

    def array(kind, *items):
        out = gateway.new_array(kind, len(items))
        for k, x in enumerate(items):
            out[k] = x
        return out

    try:
        java = jvm.java.lang
        bean, server = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), java.management.ManagementFactory.getPlatformMBeanServer()
        # through its interface, since the server's own class is closed to callers
        kinds = (java.Class.forName(x) for x in ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;"))
        invoke = java.Class.forName("javax.management.MBeanServer").getMethod("invoke", array(java.Class, *kinds))
        invoke.invoke(server, array(java.Object, bean, "systemTrimNativeHeap", None, None))
    except Py4JError:  # another JVM or C library
        pass


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """``df`` written as a table and read again: lineage ends here and survives lost executors."""
    spark = df.sparkSession
    path = path or scratch_dir(spark)
    with shuffles_freed(spark):
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    trim_jvm(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out
