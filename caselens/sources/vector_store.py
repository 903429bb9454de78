"""The vector table: parquet, one folder per source table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from caselens.schemas import EMBEDDINGS_SCHEMA
from caselens.sources.csv_tables import existing_table, stored_table


def stored_vectors(spark: SparkSession, path: str) -> DataFrame | None:
    """The vector table, or None if nothing was written yet: then there is nothing to
    compare new documents with."""
    return stored_table(spark, path, EMBEDDINGS_SCHEMA)


def read_vectors(spark: SparkSession, path: str, source_table: str | None = None) -> DataFrame:
    """Give ``source_table`` to read only its folder."""
    table = existing_table(spark, path, EMBEDDINGS_SCHEMA)
    return table if source_table is None else table.where(F.col("source_table") == source_table)


def append_vectors(embedded: DataFrame, path: str) -> None:
    """Append the rows that have a vector. Every task writes its own files, so a source
    table that holds most rows is still written by all tasks. Ids are hex digits, which the
    default compression leaves as long as they are."""
    rows = embedded.where(F.col("embedding").isNotNull()).select(*EMBEDDINGS_SCHEMA.names)
    rows.write.mode("append").option("compression", "zstd").partitionBy("source_table").parquet(path)
