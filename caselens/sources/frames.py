"""Event frames: ``data: {json}`` followed by an empty line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# How a frame starts and ends, and what its JSON may hold.
PREFIX = "data:"
FRAME_END = "\n\n"
EVENT_SCHEMA = "type string, text string, message string"


def frame(event: Column) -> Column:
    """A frame without the closing empty line, which the writer adds."""
    return F.concat(F.lit(PREFIX + " "), F.to_json(event))


def data_line(raw: Column | str) -> Column:
    """The first line that starts with ``data:``, or empty text. Bytes that are not UTF-8
    become replacement characters."""
    raw = F.col(raw) if isinstance(raw, str) else raw
    return F.regexp_extract(F.make_valid_utf8(raw), r"(?md)^data:.*$", 0)


def parse_frames(df: DataFrame, raw: str = "frame", extra: str = "") -> DataFrame:
    """Add type, text, message and ``malformed`` (the data line is not JSON); rows
    without a data line are left out. ``extra`` names further JSON fields, as DDL."""
    schema = ", ".join(filter(None, [EVENT_SCHEMA, extra, "_bad string"]))
    payload = F.trim(F.substr("_line", F.lit(len(PREFIX) + 1)), F.lit(" \t\r"))
    event = F.from_json(payload, schema, {"columnNameOfCorruptRecord": "_bad"})
    return (
        df.withColumn("_line", data_line(raw))
        .where(F.col("_line") != "")
        .withColumn("_event", event)
        .withColumn("malformed", F.col("_event").isNull() | F.col("_event._bad").isNotNull())
        .select(*df.columns, "_event.*", "malformed")
        .drop("_bad")
    )


def write_frames(frames: DataFrame, path: str, column: str = "frame") -> None:
    frames.select(column).write.option("lineSep", FRAME_END).mode("overwrite").text(path)


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", FRAME_END).text(path).withColumnRenamed("value", "frame")


def stream_frames(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    reader = spark.readStream.option("lineSep", FRAME_END).option("maxFilesPerTrigger", files_per_trigger)
    return reader.text(path).withColumnRenamed("value", "frame")
