"""Image files as rows."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from caselens.operators.skew import fits_broadcast, skew_join
from caselens.scratch import file_system, write_and_reread
from caselens.sources.files import entries, open_file, reachable

TASKS_PER_CORE = 4  # that list, open and describe files, however many there are
OPENED_ROWS, OPENED_BYTES = 256, 8 << 20  # of files handed on at a time
LISTED_ROWS = 8192  # of a folder handed on at a time
GLOB_CHARACTERS = set("{}[]*?\\")
IMAGE_GLOB = "*.{jpg,jpeg,png,gif,webp,bmp,svg}"


def read_images(spark: SparkSession, folder: str, glob: str = IMAGE_GLOB) -> DataFrame:
    """(relative_path, path, length, modificationTime, content) of the files below
    ``folder``. Files are only opened when ``content`` is used.

    Tasks list the folders and the list is stored: Spark's own reader holds every file it found, and
    every task that it makes of some of them, in the driver. That reader is left for stores
    which only it can reach.
    """
    there, system = file_system(spark, folder)
    if GLOB_CHARACTERS & set(folder) or not system.exists(there) or not reachable(root := system.makeQualified(there).toString()):
        reader = spark.read.format("binaryFile").option("pathGlobFilter", glob)
        files = reader.option("recursiveFileLookup", True).load(folder)
    else:
        files = _listed(spark, root, glob).withColumn("content", _content("path"))
    return files.withColumn("relative_path", relative_path(F.col("path"), folder))


def _listed(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """(path, modificationTime, length) of the files below ``root`` that Spark's reader would find, which
    leaves out empty ones, one step down at a time; a folder is listed by one task."""
    tasks = TASKS_PER_CORE * spark.sparkContext.defaultParallelism
    pattern = spark._jvm.org.apache.hadoop.fs.GlobPattern(glob).compiled().pattern()
    schema = "path string, modificationTime timestamp, length bigint, folder boolean"
    types = [pa.string(), pa.timestamp("us", "UTC"), pa.int64(), pa.bool_()]
    names = ["path", "modificationTime", "length", "folder"]

    def listing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, found = re.compile(pattern, re.DOTALL), []

        def listed() -> pa.RecordBatch:
            columns = [pa.array(values, kind) for values, kind in zip(zip(*found), types)]
            found.clear()
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            for above in batch.column(0).to_pylist():
                for name, folder, length, changed in entries(above):
                    if not _hidden(name, folder) and (folder or length and wanted.fullmatch(name)):
                        found.append((f"{above.rstrip('/')}/{name}", changed // 1000 * 1000, length, folder))
                        if len(found) >= LISTED_ROWS:
                            yield listed()
        if found:
            yield listed()

    levels, folders = [], spark.createDataFrame([(root,)], "path string")
    while not levels or not folders.isEmpty():
        level = write_and_reread(folders.repartition(tasks, "path").mapInArrow(listing, schema), "listed")
        levels.append(level.where(~F.col("folder")).drop("folder"))
        folders = level.where("folder").select("path")
    return reduce(DataFrame.unionByName, levels)


def _hidden(name: str, folder: bool) -> bool:
    """Whether Spark's readers pass over a file or folder of this name."""
    if folder and name.startswith(("_metadata", "_common_metadata")):
        return False
    return name.startswith(".") or name.endswith("._COPYING_") or (name.startswith("_") and "=" not in name)


@F.udf(T.BinaryType(), useArrow=False)  # takes few rows at a time, unlike one by Arrow
def _content(path: str) -> bytes:
    with open_file(path) as file:
        return file.read()


def relative_path(path: Column, folder: str) -> Column:
    """What follows ``folder`` in a file URL; the URL is percent-decoded."""
    bare = folder.split(":", 1)[1] if "://" in folder or folder.startswith("file:") else folder
    marker = "/" + bare.strip("/") + "/"
    plain = F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    return F.substring_index(plain, marker, -1)


def with_found(records: DataFrame, images: DataFrame, path: str = "image_path") -> DataFrame:
    """Records with ``found``: whether their image file is there. No file is opened."""
    files = images.select(F.col("relative_path").alias(path), F.lit(True).alias("found"))
    joined = skew_join(records, files, [path], how="left")
    return joined.withColumn("found", F.coalesce("found", F.lit(False)))


def missing_images(records: DataFrame, images: DataFrame, path: str = "image_path") -> DataFrame:
    """Records whose image file is not there."""
    return with_found(records, images, path).where(~F.col("found")).drop("found")


def described_files(
    images: DataFrame, records: DataFrame, describe: Callable[[DataFrame], DataFrame], path: str = "image_path"
) -> DataFrame:
    """(path, description, describe_error) of the files that ``records`` name, each described once,
    beside its scan: the bytes of a file go nowhere else. The number of tasks follows the cores, as
    small files would otherwise make one per few of them. The result is stored."""
    tasks = TASKS_PER_CORE * records.sparkSession.sparkContext.defaultParallelism
    wanted = write_and_reread(records.select(F.col(path).alias("relative_path")).distinct(), "wanted-images")
    if fits_broadcast(wanted):
        wanted = F.broadcast(wanted)
    listed = images.select("relative_path", "path")
    some = listed.first()
    if some is not None and not reachable(some["path"]):
        files = images.join(wanted, "relative_path", "left_semi").select("relative_path", "content")
    else:  # choose by the listing, then open what was chosen
        chosen = listed.coalesce(tasks).join(wanted, "relative_path", "left_semi").repartition(tasks, "path")
        files = chosen.mapInArrow(_opened, "relative_path string, content binary")
    return write_and_reread(describe(files.withColumnRenamed("relative_path", path)).drop("content"), "descriptions")


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Some files at a time, bounded in number and in bytes."""
    names, contents = [], []

    def opened() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(contents, pa.binary())], ["relative_path", "content"])
        names.clear()
        contents.clear()
        return out

    for batch in batches:
        for name, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            with open_file(path) as file:
                names.append(name)
                contents.append(file.read())
            if len(names) >= OPENED_ROWS or sum(map(len, contents)) >= OPENED_BYTES:
                yield opened()
    if names:
        yield opened()
