"""Typed CSV tables."""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from caselens.operators.skew import missing_from
from caselens.schemas import RECORD_TABLES, TIME_COLUMNS
from caselens.scratch import write_and_reread
from caselens.sources.files import open_file


def _headers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, its first record as JSON) of listed files. No more of a file is read."""
    for batch in batches:
        paths = batch.column(0).to_pylist()
        headers = []
        for path in paths:
            with open_file(path, unpacked=True) as file, io.TextIOWrapper(file, "utf-8-sig", errors="replace", newline="") as text:
                headers.append(json.dumps(next(csv.reader(text), [])))
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(headers, pa.string())], ["file", "header"])


def _by_header(spark: SparkSession, path: str | list[str], options: dict) -> list[tuple[list[str], list[str]]]:
    """(column names, files) of the files at ``path``, those with the same header together.

    Files are listed without being opened, and tasks read their first records. Where all files
    have one header, as a rule, the folder is read as it is; else the names come to the
    driver, which has to name them to the readers.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", False).load(path).where("length > 0").select("path")
    headers = write_and_reread(listed.mapInArrow(_headers, "file string, header string"), "headers")
    kinds = headers.select("header").distinct().limit(2).collect()
    if len(kinds) < 2:
        return [(spark.read.options(**options).csv(path).columns, [path] if isinstance(path, str) else path)]
    groups = headers.groupBy("header").agg(F.sort_array(F.collect_list("file")).alias("files")).collect()
    return [(spark.read.options(**options).csv(r["files"][0]).columns, r["files"]) for r in groups]


def read_csv(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType,
    mapping: dict[str, str] | None = None,
    multi_line: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """(rows in ``schema``, rejected rows with their reason) of a file, a folder or a list of files.

    ``mapping`` names the CSV column of each target column; other CSV columns are
    ignored. Files may have their columns in different orders: each is read by its own
    header. Everything is read as text, so leading zeros stay, then cast. A row is
    rejected if it has the wrong number of cells, of ignored columns too, or a cell that
    does not fit its type. All lines are judged once and stored; each is either a row or
    a reject.
    """
    mapping = mapping or {name: name for name in schema.names}
    # without pruning, so that the number of cells is that of the line
    options = {"header": True, "multiLine": multi_line, "escape": '"', "columnPruning": False}

    def typed(field: T.StructField) -> Column:
        cell = F.col(f"`{mapping[field.name]}`")
        if field.name in TIME_COLUMNS:
            cell = F.lpad(cell, 8, "0")
            return F.when(cell.rlike(r"^([01]\d|2[0-3]):[0-5]\d:[0-5]\d$"), cell)
        return cell.try_cast(field.dataType)

    def judged(header: list[str], files: list[str]) -> DataFrame:
        missing = sorted(set(mapping.values()) - set(header))
        if missing:
            raise ValueError(f"{files[0]} has no column {', '.join(missing)}")
        text = T.StructType([T.StructField(c, T.StringType()) for c in [*header, "_corrupt_record"]])
        raw = spark.read.options(**options).schema(text).csv(files)
        bad_cells = F.array(
            *[
                F.when(F.col(f"`{mapping[f.name]}`").isNotNull() & typed(f).isNull(), F.lit(f.name))
                for f in schema.fields
            ]
        )
        reason = F.when(F.col("_corrupt_record").isNotNull(), F.lit("wrong number of cells")).otherwise(
            F.nullif(F.array_join(bad_cells, ", "), F.lit(""))
        )
        cells = F.to_json(F.struct(*[f"`{c}`" for c in header]))
        record = F.when(reason.isNotNull(), F.coalesce("_corrupt_record", cells))
        row = F.struct(*[typed(f).alias(f.name) for f in schema.fields])
        return raw.select(row.alias("row"), record.alias("record"), reason.alias("reason"))

    parts = [judged(header, files) for header, files in _by_header(spark, path, options)]
    checked = write_and_reread(reduce(DataFrame.unionByName, parts), "csv")
    rows = checked.where(F.col("reason").isNull()).select("row.*")
    return rows, checked.where(F.col("reason").isNotNull()).select("record", "reason")


def read_record_table(spark: SparkSession, path: str, table: str) -> tuple[DataFrame, DataFrame]:
    return read_csv(spark, path, RECORD_TABLES[table].schema)


def append_new(df: DataFrame, path: str, key: list[str]) -> None:
    """Append rows whose key the table at ``path`` does not hold yet, so a repeated run
    adds nothing."""
    stored = stored_table(df.sparkSession, path, df.schema)
    new = df if stored is None else missing_from(df, stored, key)
    new.select(*df.columns).write.mode("append").parquet(path)


def stored_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame | None:
    """The table at ``path``, or None if nothing was written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def existing_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The table at ``path``, empty if nothing was written yet."""
    stored = stored_table(spark, path, schema)
    return spark.createDataFrame([], schema) if stored is None else stored


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    counts = [
        df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, counts)
