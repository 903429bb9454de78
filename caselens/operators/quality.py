"""Key, reference, null and type checks, each with one pass over a table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from caselens.schemas import RECORD_TABLES


def _any(conditions):
    return reduce(lambda a, b: a | b, conditions)


def primary_key_violations(df: DataFrame, keys: list[str]) -> DataFrame:
    """Key values that occur more than once or contain NULL, with their row counts."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
    return counts.where((F.col("n_rows") > 1) | _any([F.col(k).isNull() for k in keys]))


def foreign_key_violations(child: DataFrame, fk: str, parent: DataFrame, pk: str) -> DataFrame:
    """Referencing values without a parent, with the number of rows that use them.

    The child is counted per value first, so the join sees each value once however
    many rows share it.
    """
    used = child.where(F.col(fk).isNotNull()).groupBy(fk).agg(F.count(F.lit(1)).alias("n_rows"))
    known = parent.select(F.col(pk).alias("_known"))
    return used.join(known, F.col(fk) == F.col("_known"), "left_anti")


def null_counts(df: DataFrame, table: str, columns: list[str] | None = None) -> DataFrame:
    """One row per column: how many rows, how many NULLs. One pass over the table."""
    columns = columns or df.columns
    counts = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count(F.col(f"`{c}`")).alias(f"_c{i}") for i, c in enumerate(columns)],
    )
    entries = F.array(
        *[
            F.struct(F.lit(c).alias("column_name"), F.col(f"_c{i}").alias("n"))
            for i, c in enumerate(columns)
        ]
    )
    return counts.select("_rows", F.explode(entries).alias("e")).select(
        F.lit(table).alias("table_name"),
        "e.column_name",
        F.col("_rows").alias("n_rows"),
        (F.col("_rows") - F.col("e.n")).alias("n_nulls"),
    )


def type_rejects(df: DataFrame, key: str, types: dict[str, str]) -> DataFrame:
    """Text values that do not fit the wanted type: (key, column, value, type)."""
    checks = F.array(
        *[
            F.struct(
                F.lit(name).alias("column_name"),
                F.col(name).cast("string").alias("bad_value"),
                F.lit(kind).alias("expected_type"),
                (F.col(name).isNotNull() & F.col(name).try_cast(kind).isNull()).alias("bad"),
            )
            for name, kind in types.items()
        ]
    )
    failed = F.filter(checks, lambda c: c["bad"])
    return df.select(F.col(key), F.explode(failed).alias("c")).select(
        key, "c.column_name", "c.bad_value", "c.expected_type"
    )


def width_rejects(df: DataFrame, key: str, vector: str, width: int) -> DataFrame:
    """Vectors of the wrong width."""
    return df.where(F.col(vector).isNotNull() & (F.size(vector) != width)).select(
        key, F.size(vector).alias("n_dims")
    )


def check_record_tables(tables: dict[str, DataFrame]) -> DataFrame:
    """Violation counts for every key and reference of the loaded record tables.

    A rule reads the columns it is about, in their own types. References are counted per value
    in the tasks that read them, so a value that very many rows name meets its parent once.
    """
    n_rows, zero = F.count(F.lit(1)).alias("n"), F.lit(0).cast("bigint")
    found = []

    def add(name: str, rule: str, column: str, bad: DataFrame) -> None:
        counted = bad.agg(F.count(F.lit(1)).alias("n_values"), F.coalesce(F.sum("n"), zero).alias("n_rows"))
        labels = [F.lit(name).alias("table_name"), F.lit(rule).alias("rule"), F.lit(column).alias("column_name")]
        found.append(counted.select(*labels, "n_values", "n_rows"))

    for name, df in tables.items():
        spec = RECORD_TABLES[name]
        keys = df.groupBy(spec.key).agg(n_rows)
        add(name, "primary key", spec.key, keys.where((F.col("n") > 1) | F.col(spec.key).isNull()))
        for column, (parent, parent_key) in spec.references.items():
            if parent in tables:
                used = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("_value")).agg(n_rows)
                known = tables[parent].select(F.col(parent_key).alias("_value"))
                add(name, "reference", column, used.join(known, "_value", "left_anti"))
    return reduce(DataFrame.unionByName, found)
