"""Typed CSV rows from a folder that keeps growing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql.streaming import StreamingQuery

from caselens.sources.csv_tables import existing_table, read_csv

FILES_PER_BATCH = 1000
_LISTED = "path string, modificationTime timestamp, length long, content binary"
_REJECTS = T.StructType().add("record", "string").add("reason", "string")


def stream_csv(
    spark: SparkSession,
    path: str,
    target: str,
    checkpoint: str,
    schema: T.StructType,
    mapping: dict[str, str] | None = None,
    *,
    multi_line: bool = False,
    files_per_batch: int = FILES_PER_BATCH,
    available_now: bool = True,
) -> StreamingQuery:
    """Load each new file below ``path`` once, as :func:`caselens.sources.csv_tables.read_csv` does.

    The stream is one of files, not of lines, so every file is read by its own header. A batch
    names at most ``files_per_batch`` files, which are judged together; ``rows`` and ``rejects``
    below ``target`` get a folder per batch, and a batch that runs again replaces its own two.
    One checkpoint writes to a target.
    """
    files = (
        spark.readStream.format("binaryFile")
        .schema(_LISTED)
        .option("recursiveFileLookup", True)
        .option("maxFilesPerTrigger", files_per_batch)
        .load(path)
        .where("length > 0")
        .select("path")  # no file is opened for this
    )

    def load(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        names = sorted(r["path"] for r in batch.collect())  # files_per_batch at most
        if not names:
            return
        rows, rejects = read_csv(session, names, schema, mapping, multi_line)
        rows.write.mode("overwrite").parquet(f"{target}/rows/batch={batch_id}")
        rejects.write.mode("overwrite").parquet(f"{target}/rejects/batch={batch_id}")

    writer = files.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def _read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    stored = existing_table(spark, path, T.StructType([*schema.fields, T.StructField("batch", T.IntegerType())]))
    return stored.select(*schema.names)


def read_loaded(spark: SparkSession, target: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) loaded so far."""
    return _read(spark, f"{target}/rows", schema), _read(spark, f"{target}/rejects", _REJECTS)
