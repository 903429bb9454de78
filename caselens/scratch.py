"""Where intermediate tables go.

A cluster names a shared folder in ``spark.checkpoint.dir``; tables written there
outlive the executor that wrote them. A machine-local folder is only ever used by a
local session that has no such setting.
"""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
_local_base: str | None = None


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared scratch folder."""
    base = spark.conf.get(_SETTING, None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {_SETTING} to a folder that all executors share")
        global _local_base
        if _local_base is None:
            _local_base = tempfile.mkdtemp(prefix="run-", dir="/tmp")
        base = _local_base
    return f"{base.rstrip('/')}/caselens/{name}-{uuid.uuid4().hex}"


def write_and_reread(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Cut lineage by a written table; the result is read back from storage."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """What is run inside leaves no shuffle files behind: each job's result is stored or collected."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def file_system(spark: SparkSession, path: str):
    """A path and its file system, whatever it is."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there, there.getFileSystem(spark._jsc.hadoopConfiguration())


def remove(spark: SparkSession, path: str) -> None:
    """Remove what was written at ``path``."""
    there, system = file_system(spark, path)
    system.delete(there, True)


def numbers(spark: SparkSession, path: str, kind: str, file: str | None = None) -> list[int]:
    """The n of the folders ``kind=n`` below ``path``, of those that hold ``file`` if given."""
    pattern, system = file_system(spark, f"{path}/{kind}=*" + (f"/{file}" if file else ""))
    names = [f.getPath().getParent().getName() if file else f.getPath().getName() for f in system.globStatus(pattern) or ()]
    return sorted(int(name.split("=")[1]) for name in names)


def finished_numbers(spark: SparkSession, path: str, kind: str) -> list[int]:
    """The n of the finished folders ``kind=n`` below ``path``."""
    return numbers(spark, path, kind, "_SUCCESS")


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a short text from the driver: a new file that takes its name when it is whole."""
    there, system = file_system(spark, path)
    before, _ = file_system(spark, f"{there.getParent()}/_{uuid.uuid4().hex}")
    out = system.create(before, True)
    out.write(bytearray(text.encode()))
    out.close()
    system.delete(there, False)
    if not system.rename(before, there):
        raise OSError(f"{path} could not be written")


def read_text(spark: SparkSession, path: str) -> str | None:
    """A short text, or None if there is no such file."""
    there, system = file_system(spark, path)
    if not system.exists(there):
        return None
    stream = system.open(there)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
