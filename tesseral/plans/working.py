"""Working tables in the folder that all executors share."""

from __future__ import annotations

import contextlib
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a temporary one only where it is unset on a
    local master, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = _local_dir()
    return found.rstrip("/")


@functools.cache
def _local_dir() -> str:
    return tempfile.mkdtemp(prefix="tesseral-")


def file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def new_path(spark: SparkSession, name: str = "") -> str:
    """A new place in the shared folder for a table; it goes when the session's JVM ends, if not before."""
    path = f"{shared_dir(spark)}/tesseral-{uuid.uuid4().hex}{name}"
    files, at = file_system(spark, path)
    files.mkdirs(at)
    files.deleteOnExit(at)
    return path


def exists(spark: SparkSession, path: str) -> bool:
    files, at = file_system(spark, path)
    return files.exists(at)


def write_new(spark: SparkSession, path: str, text: str) -> bool:
    """Writes a small file under a name that nothing has yet, as a whole: written beside it and renamed
    without overwriting. False if the name is taken."""
    files, at = file_system(spark, path)
    beside, jvm = spark._jvm.org.apache.hadoop.fs.Path(at.getParent(), f"_{uuid.uuid4().hex}"), spark._jvm
    out = files.create(beside, False)
    try:
        out.write(bytearray(text, "utf-8"))
    finally:
        out.close()
    kept = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    kept[0] = getattr(jvm.org.apache.hadoop.fs.Options.Rename, "NONE")
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(files.makeQualified(beside), files.makeQualified(at), kept)
        return True
    except Py4JJavaError as e:
        files.delete(beside, False)
        if "FileAlreadyExists" in e.java_exception.getClass().getName():
            return False
        raise


def remove(spark: SparkSession, path: str) -> None:
    files, at = file_system(spark, path)
    files.delete(at, True)


def settle(df: DataFrame) -> DataFrame:
    """Writes the rows to the shared folder and reads them back: later steps start from files that
    outlive any executor, and nothing above is computed twice. The table is there until the session's
    JVM ends."""
    path = new_path(df.sparkSession)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def working(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A `settle` for steps in between: its tables are deleted when the block ends, so whatever
    leaves the block must not read them any more."""
    paths = []

    def put(df: DataFrame) -> DataFrame:
        paths.append(new_path(spark))
        df.write.mode("overwrite").parquet(paths[-1])
        return spark.read.schema(df.schema).parquet(paths[-1])

    try:
        yield put
    finally:
        for path in paths:
            remove(spark, path)
