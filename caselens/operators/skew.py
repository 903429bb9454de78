"""Joins whose key may be very unevenly spread, and anti joins with a large table.

A key that holds more than ``share`` of the rows is hot. No more than ``1 / share`` keys
can be, so the list of hot keys is small whatever the data. It is found by sketches that
combine before they shuffle and fetched once, so that both sides of a join agree on it; a
key the sketches miss is joined like any other.
Rows of a hot key are spread over as many groups as bring each below ``share``, and the
matching rows of the other side are repeated once per group, at most ``2 / share`` times
over all keys together. Without hot keys the join is an ordinary one, and what is uneven
below ``share`` is left to adaptive execution.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from caselens.scratch import write_and_reread

MAX_BROADCAST_BYTES = 64 << 20
ADAPTIVE_SKEW = ("spark.sql.adaptive.enabled", "spark.sql.adaptive.skewJoin.enabled")
NO_KEY_GROUPS = 1009
SKETCH_GROUPS = 64


@dataclass(frozen=True)
class HotKeys:
    """Groups per hot key, by the key's hash, and for rows without a key."""

    groups: dict[int, int]
    null_groups: int


def default_share(df: DataFrame) -> float:
    """About the share of one shuffle partition."""
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return 1 / min(2000, max(200, partitions))


def find_hot_keys(df: DataFrame, keys: list[str], share: float) -> HotKeys:
    tracked, most = int(8 / share), int(1 / share)
    no_key = F.coalesce(*[F.when(F.col(k).isNull(), F.lit(True)) for k in keys], F.lit(False))
    sketches = (
        df.select(
            F.when(~no_key, F.xxhash64(*keys)).alias("_h"),
            F.pmod(F.spark_partition_id(), F.lit(SKETCH_GROUPS)).alias("_g"),
        )
        .groupBy("_g")
        .agg(
            F.expr(f"approx_top_k(_h, {most}, {tracked})").alias("_top"),
            F.count(F.lit(1)).alias("_n"),
            F.count("_h").alias("_keyed"),
        )
    )
    # one row per sketch for the totals (item NULL), and one per key it found
    total = F.struct(F.lit(None).cast("bigint").alias("item"), F.col("_n").alias("count"), "_keyed")
    items = F.transform(
        F.filter("_top", lambda e: e["item"].isNotNull()),
        lambda e: F.struct(e["item"].alias("item"), e["count"].alias("count"), F.lit(0).cast("bigint").alias("_keyed")),
    )
    counts = (
        sketches.select(F.explode(F.concat(F.array(total), items)).alias("e"))
        .groupBy("e.item")
        .agg(F.sum("e.count").alias("n"), F.sum("e._keyed").alias("keyed"))
    )
    # at most 1 / share keys can pass, apart from those the sketches miscount
    top = counts.orderBy(F.col("item").isNotNull(), F.col("n").desc()).limit(most + 1).collect()
    if not top or top[0]["item"] is not None:
        return HotKeys({}, 1)
    rows, keyed = top[0]["n"], top[0]["keyed"]
    limit = rows * share
    groups = {r["item"]: int(r["n"] / limit) + 1 for r in top[1:] if r["n"] > limit}
    return HotKeys(groups, int((rows - keyed) / limit) + 1)


def skew_join(
    large: DataFrame,
    small: DataFrame,
    on: list[str],
    how: str = "inner",
    salt_on: list[str] | None = None,
    share: float | None = None,
) -> DataFrame:
    """``large.join(small, on, how)`` for ``how`` inner or left.

    While adaptive execution splits skewed partitions, it does the work when it knows their
    sizes, and nothing is read to plan the join. With ``share``, or without adaptive
    execution, hot keys are looked for first.

    ``salt_on`` names columns of ``large`` that together tell its rows apart. The group
    of a row depends on these values alone, so a task that is run again repeats it.
    """
    if how not in ("inner", "left"):
        raise ValueError("skew_join supports inner and left joins")
    conf = large.sparkSession.conf
    adaptive = all(conf.get(c, "true") == "true" for c in ADAPTIVE_SKEW)
    split = large.join(small, on, how) if adaptive and share is None else None
    for key in on:
        if large.schema[key].dataType != small.schema[key].dataType:
            raise ValueError(f"{key} has different types on the two sides")
    if split is not None:
        return split
    hot = find_hot_keys(large, on, share or default_share(large))
    salt_nulls = how == "left" and hot.null_groups > 1
    if not hot.groups and not salt_nulls:
        return large.join(small, on, how)

    rows = [(0, 0), *hot.groups.items()]  # the first row only gives an empty list its type
    listed = large.sparkSession.createDataFrame(rows, "_h bigint, _groups int").where("_groups > 0")
    listed = F.broadcast(listed)

    def with_groups(df: DataFrame) -> DataFrame:
        marked = df.withColumn("_h", F.xxhash64(*on)).join(listed, "_h", "left").drop("_h")
        return marked.withColumn("_groups", F.coalesce("_groups", F.lit(1)))

    own = F.xxhash64(*(salt_on or [c for c in large.columns if c not in on] or on))
    groups: Column = F.col("_groups")
    if salt_nulls:
        no_key = F.coalesce(*[F.when(F.col(k).isNull(), F.lit(True)) for k in on], F.lit(False))
        groups = F.when(no_key, F.lit(hot.null_groups)).otherwise(groups)
    spread = with_groups(large).withColumn("_salt", F.pmod(own, groups).cast("int")).drop("_groups")
    repeated = (
        with_groups(small)
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_groups") - 1)))
        .drop("_groups")
    )
    return spread.join(repeated, [*on, "_salt"], how).drop("_salt")


def fits_broadcast(keys: DataFrame) -> bool:
    """Whether the rows of ``keys``, a stored table, are small enough to send everywhere."""
    sizes = [F.coalesce(F.octet_length(F.col(k).cast("string")), F.lit(0)) for k in keys.columns]
    return (keys.agg(F.sum(reduce(Column.__add__, sizes) + 64)).first()[0] or 0) <= MAX_BROADCAST_BYTES


def missing_from(df: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``df`` whose key ``existing`` does not hold; a key with a NULL is never held.

    ``existing`` may be far larger than ``df``: it is first cut to the keys in question,
    with the keys as the side to hash, and only what is left of it meets the rows. Keys of
    a checked size are broadcast, so ``existing`` is read without a shuffle. Rows without a
    key are spread, a key that repeats very often is split by adaptive execution.
    """
    asked = write_and_reread(df.select(*keys).distinct(), "keys")
    return without_keys(df, held_of(asked, existing, keys), keys)


def held_of(asked: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of ``existing`` that are among ``asked``, a stored table, which is sent to where
    ``existing`` is read if it is of a checked size."""
    asked = asked.select(*keys)
    return existing.select(*keys).join(F.broadcast(asked) if fits_broadcast(asked) else asked, keys, "left_semi")


def without_keys(df: DataFrame, held: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``df`` whose key is not in ``held``; rows without a key are spread."""
    no_key = F.coalesce(*[F.when(F.col(k).isNull(), F.lit(True)) for k in keys], F.lit(False))
    group = F.when(no_key, F.pmod(F.xxhash64(*df.columns), F.lit(NO_KEY_GROUPS))).otherwise(F.lit(0).cast("bigint"))
    none = F.pmod(F.xxhash64(*keys), F.lit(1))  # always 0, but no constant, so it stays a key of the join
    spread = df.withColumn("_group", group)
    return spread.join(held.withColumn("_group", none), [*keys, "_group"], "left_anti").select(*df.columns)
