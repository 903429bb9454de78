"""Ordered work within a key when one key may hold a large part of all rows.

Rows of a key are ordered by ``seq``, an integer or a time, dense or not. A key with more than
``span`` rows is cut into ranges at quantiles of its own ``seq`` values, so ranges hold about as
many rows each; ordered work happens inside ranges, and only one short summary row per range
is ordered within the whole key. All other keys are one range.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from caselens.operators.skew import fits_broadcast
from caselens.scratch import write_and_reread

SPAN = 1 << 20
RANGES = 1024  # of a key with more than ``span`` rows
MAX_CUT_BYTES = 64 << 20


def _ranged(df: DataFrame, key: str, seq: str, span: int) -> DataFrame | None:
    """Add ``_range``, or None if no key has to be cut, which one aggregate tells. No more than
    one key per ``span`` rows of the table can need cutting."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    if (counts.agg(F.max("_n")).first()[0] or 0) <= span:
        return None
    large = write_and_reread(counts.where(F.col("_n") > span).select(key), "large-keys")
    shares = [i / RANGES for i in range(1, RANGES)]
    own = df.select(key, seq).join(F.broadcast(large) if fits_broadcast(large) else large, key, "left_semi")
    cuts = own.groupBy(key).agg(F.percentile_approx(seq, shares, 4 * RANGES).alias("_cuts"))
    cuts = write_and_reread(cuts.withColumn("_cuts", F.array_sort(F.array_distinct("_cuts"))), "cuts")
    small = cuts.count() * RANGES * 8 <= MAX_CUT_BYTES
    placed = df.join(F.broadcast(cuts) if small else cuts, key, "left")
    before = F.size(F.filter(F.coalesce("_cuts", F.array().cast(cuts.schema["_cuts"].dataType)), lambda c: c < F.col(seq)))
    return placed.withColumn("_range", before).drop("_cuts")


def running_total(df: DataFrame, key: str, seq: str, value: str, name: str, span: int = SPAN) -> DataFrame:
    """Add ``name``: the sum of ``value`` over earlier rows of the key (0 for the first)."""
    ranged = _ranged(df, key, seq, span)
    if ranged is None:
        earlier = Window.partitionBy(key).orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumn(name, F.coalesce(F.sum(value).over(earlier), F.lit(0)))
    earlier_ranges = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        ranged.groupBy(key, "_range")
        .agg(F.sum(value).alias("_sum"))
        .select(key, "_range", F.coalesce(F.sum("_sum").over(earlier_ranges), F.lit(0)).alias("_start"))
    )
    earlier_rows = (
        Window.partitionBy(key, "_range").orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    )
    within = ranged.withColumn("_within", F.coalesce(F.sum(value).over(earlier_rows), F.lit(0)))
    return (
        within.join(starts, [key, "_range"])
        .withColumn(name, F.col("_start") + F.col("_within"))
        .drop("_range", "_start", "_within")
    )


def with_next(df: DataFrame, key: str, seq: str, columns: list[str], span: int = SPAN) -> DataFrame:
    """Add ``next_<column>`` from the following row of the key (NULL for the last)."""
    row = F.struct(*columns)
    ranged = _ranged(df, key, seq, span)
    if ranged is None:
        following = df.withColumn("_next", F.lead(row).over(Window.partitionBy(key).orderBy(seq)))
        return following.select(*df.columns, *[F.col("_next")[c].alias(f"next_{c}") for c in columns])
    inside = Window.partitionBy(key, "_range").orderBy(seq)
    ranged = ranged.withColumn("_next", F.lead(row).over(inside))
    # the first row of the next range that has any, one row per range
    by_range = Window.partitionBy(key).orderBy("_range")
    heads = (
        ranged.groupBy(key, "_range")
        .agg(F.min_by(row, seq).alias("_head"))
        .select(key, "_range", F.lead("_head").over(by_range).alias("_after"))
    )
    joined = ranged.join(heads, [key, "_range"])
    following = F.coalesce("_next", "_after")
    return joined.select(
        *df.columns, *[following[c].alias(f"next_{c}") for c in columns]
    )
