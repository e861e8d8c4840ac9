"""Folders and small files that the driver and all executors share."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir.

    Where that is unset a local master, as in tests, gets a temporary folder;
    a cluster is refused, as its machines share no such folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not re.match(r"local($|\[)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{tempfile.gettempdir()}/checkpoints"


def fixed(df: DataFrame) -> DataFrame:
    """df, computed once and read back from a reliable checkpoint in the shared folder."""
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


def new_folder(spark: SparkSession, name: str) -> str:
    """The name of a folder in the shared one that is not there yet."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _file(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def remove(spark: SparkSession, path: str) -> None:
    """Removes a folder or file, on any file system that Spark reads."""
    system, where = _file(spark, path)
    system.delete(where, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text file, on any file system that Spark writes; its folder is made."""
    system, where = _file(spark, path)
    out = system.create(where, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    """The whole text of a small file, on any file system that Spark reads."""
    system, where = _file(spark, path)
    stream = system.open(where)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def stored(df: DataFrame) -> DataFrame:
    """df written once as a Parquet table in the shared folder and reread: readers take the columns they need."""
    folder = new_folder(df.sparkSession, "stored")
    df.write.parquet(folder)
    release(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def release(spark: SparkSession) -> None:
    """Frees what finished steps hold in the driver.

    Spark lets go of their broadcasts and shuffles only when the driver's garbage is
    collected, and a heap that has room is filled before that and then kept."""
    gc.collect()
    jvm = spark.sparkContext._jvm
    jvm.System.gc()
    trim(spark)


def trim(spark: SparkSession) -> str:
    """Returns native memory that the driver's JVM has freed, its compilers' above all, to the system.

    The C library keeps it otherwise. What was returned, in the JVM's words; empty for
    a JVM without such a command (other makers, other systems, older versions)."""
    jvm, new_array = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array
    beans = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
    # its class is hidden, and only its interface's methods can be called
    invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
    arguments = new_array(jvm.Object, 4)
    arguments[0], arguments[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    try:
        return invoke.invoke(beans, arguments) or ""
    except Py4JJavaError:
        return ""
