"""Pipeline log lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# The patterns that tell log lines apart; the first that matches wins.
SQL_LINE = r"(?i)\A\s*sql query written by gemini\s*->\s*([^\n\r\x{2028}\x{2029}]*)\z"
MODEL_LINE = r"(?i)trying gemini|gemini.*(?:fallback|quota)|(?:fallback|quota).*gemini"


def line_kind(line: Column) -> Column:
    return F.when(line.rlike(SQL_LINE), "sql").when(line.rlike(MODEL_LINE), "model").otherwise("plain")


def classify_log_lines(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """(kept columns, line_no, line, kind, sql_text): one row per line of ``text``."""
    lines = df.select(*keep, F.posexplode(F.split(F.col(text), "\n", -1)).alias("line_no", "line"))
    kind = line_kind(F.col("line"))
    return lines.withColumn("kind", kind).withColumn(
        "sql_text", F.when(F.col("kind") == "sql", F.regexp_extract("line", SQL_LINE, 1))
    )
