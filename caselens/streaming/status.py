"""Request statuses and deadlines from a stream of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from caselens.operators.events import (
    DEADLINE_SECONDS,
    TIMED_OUT,
    merge_status,
    status_columns,
    status_of,
)
from caselens.scratch import finished_numbers, remove
from caselens.sources.csv_tables import stored_table

MERGE_EVERY = 16  # batches whose summaries are merged into one
BUCKETS = 64  # folders of the closed requests of a batch


def stream_request_status(
    events: DataFrame,
    target: str,
    checkpoint: str,
    request: str = "request_id",
    *,
    available_now: bool = True,
    merge_every: int = MERGE_EVERY,
) -> StreamingQuery:
    """Write one summary row per request and micro-batch below ``target``.

    Rows combine before they shuffle, so a request that sends most events is no
    bottleneck, and nothing is kept in memory between batches. A batch that is run again
    overwrites its own folder. Every ``merge_every`` batches the summaries so far become one
    table, and those that went into the one before it are removed.
    """

    def summarise(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        summary = batch.groupBy(request).agg(*status_columns())
        summary.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")
        if batch_id % merge_every == merge_every - 1:
            parts = [f"{target}/batch={b}" for b in range(batch_id - merge_every + 1, batch_id + 1)]
            if batch_id >= merge_every:
                parts.append(f"{target}/merged={batch_id - merge_every}")
            merged = merge_status(spark.read.schema(summary.schema).parquet(*parts), request)
            merged.write.mode("overwrite").parquet(f"{target}/merged={batch_id}")
            for b in range(batch_id - 2 * merge_every + 1, batch_id - merge_every + 1):
                remove(spark, f"{target}/batch={b}")
            remove(spark, f"{target}/merged={batch_id - 2 * merge_every}")

    writer = events.writeStream.foreachBatch(summarise).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def read_request_status(spark: SparkSession, target: str, request: str = "request_id") -> DataFrame:
    """The status of every request so far: the last merged table and the batches after it."""
    merged = finished_numbers(spark, target, "merged")[-1:]
    parts = [f"{target}/merged={n}" for n in merged]
    parts += [f"{target}/batch={n}" for n in finished_numbers(spark, target, "batch") if not merged or n > merged[0]]
    return status_of(merge_status(spark.read.parquet(*parts), request), request)


def stream_deadlines(
    events: DataFrame,
    target: str,
    checkpoint: str,
    request: str = "request_id",
    *,
    seconds: int = DEADLINE_SECONDS,
    available_now: bool = True,
) -> StreamingQuery:
    """Report each request that has not ended when event time passes its deadline, once.

    Needs a column ``ts``. A request is open until event time passes its deadline; then it is
    closed, reported or not, and stays closed however long it is silent: later events
    of it change nothing. Below ``target``, ``open`` has the open requests after a batch and
    the event time reached, ``closed`` the ids each batch closed, by bucket, and ``late`` the
    reports. A batch reads the open requests of the one before it and the closed ids in the
    buckets its requests fall in; run again, it replaces its own folders. Open requests of
    batches before the last are removed.
    """
    bucket = F.pmod(F.xxhash64(request), F.lit(BUCKETS)).cast("int")

    def watch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        ended = F.min(F.when(F.col("type").isin("done", "error"), F.col("ts")))
        requests = batch.groupBy(request).agg(
            F.min("ts").alias("started_at"), F.max("ts").alias("last_at"), ended.alias("ended_at")
        )
        closed = stored_table(
            spark, f"{target}/closed", requests.select(request).schema.add("batch", "integer").add("bucket", "integer")
        )
        if closed is not None and batch_id > 0:
            touched = [r[0] for r in requests.select(bucket.alias("b")).distinct().collect()]
            done = closed.where(F.col("bucket").isin(touched) & (F.col("batch") < batch_id)).select(request)
            gone = requests.join(done, request, "left_anti")
        else:
            gone = requests
        known, time_before = gone, None
        if batch_id > 0:
            before = spark.read.parquet(f"{target}/open/batch={batch_id - 1}")
            time_before = before.agg(F.max("time")).first()[0]
            known = gone.unionByName(before.where(F.col(request).isNotNull()).drop("time"))
        merged = known.groupBy(request).agg(
            F.min("started_at").alias("started_at"),
            F.max("last_at").alias("last_at"),
            F.min("ended_at").alias("ended_at"),
        )
        now = max((t for t in (batch.agg(F.max("ts")).first()[0], time_before) if t is not None), default=None)
        now = F.lit(now).cast(batch.schema["ts"].dataType)
        deadline = F.col("started_at") + F.expr(f"interval {int(seconds)} seconds")
        over = F.coalesce(now > deadline, F.lit(False))
        late = over & (F.col("ended_at").isNull() | (F.col("ended_at") > deadline))
        state = merged.withColumns({"over": over, "late": late})
        path = f"{target}/state/batch={batch_id}"
        state.write.mode("overwrite").parquet(path)
        state = spark.read.schema(state.schema).parquet(path)
        clock = state.limit(0).drop("over", "late").withColumn("time", now)
        clock = clock.unionByName(
            spark.range(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in clock.schema.fields[:-1]], now.alias("time"))
        )
        still = state.where(~F.col("over")).drop("over", "late").withColumn("time", now)
        still.unionByName(clock).write.mode("overwrite").parquet(f"{target}/open/batch={batch_id}")
        shut = state.where("over").select(request, bucket.alias("bucket"))
        shut.repartition(1).write.mode("overwrite").partitionBy("bucket").parquet(f"{target}/closed/batch={batch_id}")
        state.where("late").select(
            request, "started_at", F.lit(TIMED_OUT.format(seconds=seconds)).alias("message")
        ).write.mode("overwrite").parquet(f"{target}/late/batch={batch_id}")
        remove(spark, path)
        if batch_id > 1:
            remove(spark, f"{target}/open/batch={batch_id - 2}")

    writer = events.writeStream.foreachBatch(watch).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def read_deadlines(spark: SparkSession, target: str) -> DataFrame:
    """(request, started_at, message) of the requests that missed their deadline so far."""
    return spark.read.parquet(f"{target}/late").drop("batch")
