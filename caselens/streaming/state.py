"""Latest states from a stream of updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from caselens.sources.upserts import UpsertTable


def _table(target: str, updates_schema: T.StructType, key: str, order: list[str], fields: list[str], **options) -> UpsertTable:
    at = T.StructType([T.StructField(c, updates_schema[c].dataType) for c in order])
    valued = [T.StructType([T.StructField("at", at), T.StructField("value", updates_schema[f].dataType)]) for f in fields]
    schema = T.StructType([updates_schema[key], *[T.StructField(f, v) for f, v in zip(fields, valued)]]).add("n_updates", "long")
    return UpsertTable(target, schema, [key], {**dict.fromkeys(fields, "max"), "n_updates": "sum"}, **options)


def stream_latest_state(
    updates: DataFrame,
    target: str,
    checkpoint: str,
    key: str,
    order: list[str],
    fields: list[str],
    clears: Column | None = None,
    *,
    available_now: bool = True,
    **options,
) -> StreamingQuery:
    """Keep each key's last non-NULL value of every field in an upsert table at ``target``.

    Rows for which ``clears`` is true delete everything before them. Batches come in the order
    of the updates: no row is before one of an earlier batch. Values of one key
    are combined before they shuffle. ``options`` are those of the table.
    """
    table = _table(target, updates.schema, key, order, fields, **options)
    at = F.struct(*order)

    def add(batch: DataFrame, batch_id: int) -> None:
        cleared = False
        if clears is not None:
            last_clear = batch.where(clears).agg(F.max(at).alias("at"))
            cleared = last_clear.first()["at"] is not None
            if cleared:
                batch = batch.join(F.broadcast(last_clear.withColumnRenamed("at", "_clear")), at > F.col("_clear"))
        rows = batch.select(
            key,
            *[F.when(F.col(f).isNotNull(), F.struct(at.alias("at"), F.col(f).alias("value"))).alias(f) for f in fields],
            F.lit(1).cast("bigint").alias("n_updates"),
        )
        table.upsert(rows, f"{checkpoint}:{batch_id}", cleared)

    writer = updates.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def read_latest_state(
    spark: SparkSession, target: str, updates_schema: T.StructType, key: str, order: list[str], fields: list[str], **options
) -> DataFrame:
    """(key, fields, n_updates) of the updates so far."""
    found = _table(target, updates_schema, key, order, fields, **options).read(spark)
    return found.select(key, *[F.col(f"{f}.value").alias(f) for f in fields], "n_updates")
