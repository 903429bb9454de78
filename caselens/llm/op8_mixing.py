"""Mixing sources to target weights by pivotal dependent rounding.

A source that is to give ``target`` of its ``size`` words takes each of its documents
``target / size`` times: the whole part for certain, the fraction by dependent rounding. Two
documents with fractions are paired and words are moved from one fraction to the other, in
a random direction that keeps both expectations, until one of the two is 0 or 1; the other
goes on to the next pair. The words of the pair stay the same, so a source ends within half
a document of its target: only its last open fraction is rounded to the nearest. Pairs go
from long to short documents, so that this one tends to be short. They are formed in a tree: blocks of about ``BLOCK`` documents of a
source are reduced to one open document each, blocks of these to one again, and so on; no
group grows with its source, and a hot source only has more blocks.

The direction of a pair is a hash of the two documents, so reruns agree. Everything is
DataFrame functions.

Defined results: a null text has no words; documents without words are taken 0 times; null
sources form one source, last in order; rows that repeat id and text are rounded each on its
own, but share a block; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from caselens.scratch import write_and_reread

BLOCK = 256
MOST = 3
ITEM = "struct<size:bigint,h:bigint,doc_id:bigint,p:double>"
DONE = "array<struct<doc_id:bigint,size:bigint,h:bigint,extra:int>>"
STATE = f"struct<done:{DONE},open:{ITEM}>"
WORD = r"[^\x20\x09-\x0D]+"


def sized(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> DataFrame:
    """``doc_id``, ``source``, ``size`` in words, ``h``."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    return docs.select(
        F.col(id_column).cast("bigint").alias("doc_id"),
        F.col(source_column).cast("string").alias("source"),
        F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("size"),
        F.xxhash64(F.col(id_column), text).alias("h"),
    )


def targets(rows: DataFrame) -> DataFrame:
    """Per source: ``source_size``, ``n`` documents with words, ``target``.

    Weights 1, 2, 3 repeat over the sources in code point order. Sources are put in the order
    in which a rising level of words per weight would meet their caps: the level at which the
    words are used up is found by running sums, one row per source."""
    by_source = rows.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.sum((F.col("size") > 0).cast("bigint")).alias("n")
    )
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = by_source.withColumn("_w", (F.row_number().over(in_order) - 1) % 3 + 1).withColumn(
        "_cap", F.col("source_size") * MOST
    )
    everything = Window.partitionBy()
    before = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last()).rowsBetween(
        Window.unboundedPreceding, -1
    )
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0))) / (
        F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0))
    )
    levelled = weighed.withColumn("_level", level)
    final = F.max(F.when(F.col("_cap") >= F.col("_level") * F.col("_w"), F.col("_level"))).over(everything)
    return levelled.select(
        "source", "source_size", "n", F.least(F.col("_cap").cast("double"), F.coalesce(final, F.lit(0.0)) * F.col("_w")).alias("target")
    )


def _step(state: Column, x: Column) -> Column:
    """One pair: the open document ``a`` and the next ``x``."""
    a = state["open"]
    ratio = x["size"] / a["size"]
    up = F.least(1 - a["p"], x["p"] * ratio)
    down = F.least(a["p"], (1 - x["p"]) * ratio)
    u = F.pmod(F.xxhash64(a["h"], x["h"], a["doc_id"], x["doc_id"]), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rises = u * (up + down) < down

    def settled(which: Column, extra: int) -> Column:
        row = F.struct(which["doc_id"].alias("doc_id"), which["size"].alias("size"), which["h"].alias("h"), F.lit(extra).alias("extra"))
        return F.concat(state["done"], F.array(row))

    def left(which: Column, p: Column) -> Column:
        bounded = F.greatest(F.lit(0.0), F.least(F.lit(1.0), p))
        return F.struct(which["size"].alias("size"), which["h"].alias("h"), which["doc_id"].alias("doc_id"), bounded.alias("p"))

    def result(done: Column, still: Column) -> Column:
        return F.struct(done.alias("done"), still.alias("open")).cast(STATE)

    return (
        F.when(a.isNull(), result(state["done"], x))
        .when(rises & (1 - a["p"] <= x["p"] * ratio), result(settled(a, 1), left(x, x["p"] - (1 - a["p"]) / ratio)))
        .when(rises, result(settled(x, 0), left(a, a["p"] + x["p"] * ratio)))
        .when(a["p"] <= (1 - x["p"]) * ratio, result(settled(a, 0), left(x, x["p"] + a["p"] / ratio)))
        .otherwise(result(settled(x, 1), left(a, a["p"] - (1 - x["p"]) * ratio)))
    )


def _reduced(items: DataFrame) -> DataFrame:
    """One row per (source, block): what is settled, and the open document."""
    start = F.struct(
        F.array().cast(DONE).alias("done"),
        F.lit(None).cast(ITEM).alias("open"),
    ).cast(STATE)
    blocks = items.groupBy("source", "block").agg(F.sort_array(F.collect_list(F.col("item")), asc=False).alias("_items"))
    return blocks.select("source", "block", F.aggregate("_items", start, _step).alias("s")).select(
        "source", "block", "s.done", "s.open"
    )


def mix(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``source``, ``size``, ``source_size``, ``target``, ``copies``, ``taken`` words and
    ``h``, a hash of id and text, of all documents."""
    rows = write_and_reread(sized(docs), "mix-sizes")
    aims = write_and_reread(targets(rows), "mix-targets")
    most_blocks = aims.agg(F.max(F.ceil(F.col("n") / BLOCK))).first()[0] or 0
    mine = rows.alias("r").join(aims.alias("t"), F.col("r.source").eqNullSafe(F.col("t.source")))
    times = F.col("target") / F.col("source_size")
    worded = mine.where("size > 0").select(
        "r.source",
        F.pmod("h", F.ceil(F.col("n") / BLOCK)).alias("block"),
        F.struct("size", "h", "doc_id", (times - F.floor(times)).alias("p")).cast(ITEM).alias("item"),
    )
    settled, items = [], worded
    while True:
        level = write_and_reread(_reduced(items), "mix-level")
        settled.append(level.select("source", F.explode("done").alias("d")).select("source", "d.*"))
        if most_blocks <= 1:
            break
        most_blocks = -(-most_blocks // BLOCK)
        items = level.select("source", F.floor(F.col("block") / BLOCK).alias("block"), F.col("open").alias("item"))
    last = level.select("source", "open.doc_id", "open.size", "open.h", (F.col("open.p") >= 0.5).cast("int").alias("extra"))
    wordless = rows.where("size = 0").select("source", "doc_id", "size", "h", F.lit(0).alias("extra"))
    rounded = reduce(DataFrame.unionByName, [*settled, last, wordless])
    joined = rounded.alias("r").join(aims.alias("t"), F.col("r.source").eqNullSafe(F.col("t.source")))
    copies = F.when(F.col("size") > 0, F.floor(times) + F.col("extra")).otherwise(F.lit(0))
    return joined.select(
        "doc_id", F.col("r.source").alias("source"), "size", "source_size", "target",
        copies.cast("int").alias("copies"), (copies * F.col("size")).cast("bigint").alias("taken"), "h",
    )


def repeated(docs: DataFrame) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken, with its own columns."""
    h = F.xxhash64(F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")))
    times = write_and_reread(
        mix(docs).groupBy("doc_id", "h").agg(F.sum("copies").cast("int").alias("times"), F.count(F.lit(1)).alias("alike")), "mix"
    ).select(F.col("doc_id").alias("id"), F.col("h").alias("hash"), "times", "alike")
    # the row's own columns in one struct, where their names cannot clash with the ones made here
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("bigint").alias("own_id"), h.alias("own_hash"))
    if not times.where("alike > 1").isEmpty():  # rows alike in id and text share their copies
        rows = rows.dropDuplicates(["own_id", "own_hash"])
    taken = times.where("times > 0")
    joined = rows.join(taken, F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own_hash") == F.col("hash")))
    return joined.select("row", F.explode(F.array_repeat(F.lit(1), F.col("times"))).alias("copy")).select("row.*")
