"""Exact deduplication: group by a 128-bit content hash, compare bytes inside groups.

Everything is DataFrame functions. Texts with the same hash are only called equal when they
are: the texts themselves are a grouping key beside the hash, so two texts whose hashes
collide stay two groups. Copies of a text combine in the task that reads them, so a group
that holds a third of all rows reaches the reducers as one row per task. Only (doc_id,
hashes) of the rows meet the groups afterwards, in a join that adaptive execution can split
where a hash is hot.

Defined results: a null text counts as an empty one; the row with the largest id stays and
null ids come before all others (a group without any id keeps its rows, ``keep_id`` null);
rows that repeat both id and text are one record and share its verdict; columns beside the
two named are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def normalised(text: Column) -> Column:
    """A-Z in lower case and nothing else; null is empty. Texts of ASCII alone take the
    faster function, which does the same to them."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    ascii_only = F.length(text) == F.octet_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def exact_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: its id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``."""
    text = normalised(F.col(text_column))
    rows = docs.select(F.col(id_column).alias("doc_id"), text.alias("_text"))
    hashed = rows.select("doc_id", "_text", F.unhex(F.md5("_text")).alias("_h"))
    groups = (
        hashed.groupBy("_h", "_text")
        .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .where("group_size > 1")
        .select("_h", F.unhex(F.sha2("_text", 256)).alias("_sha"), "keep_id", "group_size")
    )
    members = rows.select("doc_id", F.unhex(F.md5("_text")).alias("_h"), F.unhex(F.sha2("_text", 256)).alias("_sha"))
    joined = members.join(groups, ["_h", "_sha"], "left")
    keep_id = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return joined.select(
        "doc_id",
        keep_id.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"),
        (F.col("doc_id").eqNullSafe(keep_id)).alias("kept"),
        F.lower(F.hex("_sha")).alias("text_sha256"),
    )
