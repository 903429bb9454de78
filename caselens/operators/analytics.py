"""Exact questions on record tables.

Counts and sums combine before they shuffle, so an uneven group costs nothing extra.
Joins with a parent that may be hot go through :func:`skew_join`; no side is broadcast by
hint, Spark does so where its own size check allows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def count_all(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"))


def count_where(df: DataFrame, condition: Column) -> DataFrame:
    return count_all(df.where(condition))


def count_by(df: DataFrame, keys: list[str], values: list | None = None) -> DataFrame:
    """Rows per key; ``values`` keeps only these values of the first key."""
    if values is not None:
        df = df.where(F.col(keys[0]).isin(values))
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def sum_by(df: DataFrame, amount: str, keys: list[str] | None = None) -> DataFrame:
    """Exact decimal sums."""
    return df.groupBy(*(keys or [])).agg(F.sum(F.col(amount)).alias("total"), F.count(F.lit(1)).alias("n"))


def extremes(df: DataFrame, value: str, ids: list[str]) -> DataFrame:
    """Lowest and highest value, each with the ids of its first row in id order."""
    # the smallest (-value, ids) is the highest value at its first id
    low, high = F.struct(value, *ids), F.struct((-F.col(value)).alias(value), *ids)
    known = df.where(F.col(value).isNotNull())
    found = known.agg(F.min(low).alias("lo"), F.min(high).alias("hi"))
    return found.select(
        F.col(f"lo.{value}").alias("lowest"),
        *[F.col(f"lo.{c}").alias(f"lowest_{c}") for c in ids],
        (-F.col(f"hi.{value}")).alias("highest"),
        *[F.col(f"hi.{c}").alias(f"highest_{c}") for c in ids],
    )


def argmax_groups(df: DataFrame, keys: list[str]) -> DataFrame:
    """The groups with the most rows; ties are all kept. The largest count is found by an
    aggregate, not by ranking all groups in one place."""
    counts = count_by(df, keys)
    return counts.where(F.col("n") == counts.agg(F.max("n")).scalar())


def having_more_than(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    return count_by(df, keys).where(F.col("n") > n)


def conditional_counts(df: DataFrame, keys: list[str], conditions: dict[str, Column]) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(condition).alias(name) for name, condition in conditions.items()],
    )


def lookup(df: DataFrame, column: str, value: str) -> DataFrame:
    """Rows whose text equals ``value`` in any case; none is a valid answer."""
    return df.where(F.lower(column) == F.lit(value.lower()))


def sort_records(df: DataFrame, value: str, ids: list[str], descending: bool = True) -> DataFrame:
    """All rows in order, NULL last, ties by id."""
    first = F.col(value).desc_nulls_last() if descending else F.col(value).asc_nulls_last()
    return df.orderBy(first, *ids)
