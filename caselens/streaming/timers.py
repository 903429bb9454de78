"""Deadlines of requests by keyed state and event-time timers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from caselens.operators.events import DEADLINE_SECONDS, TIMED_OUT
from caselens.sources.csv_tables import existing_table

_TIMES = "started bigint, ended bigint, last timestamp"  # microseconds, and the event time


def _combined(request: str):
    """One row per request and batch of rows, so a request that sends most events is no
    bottleneck when rows meet by request."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.Table.from_batches([batch]).group_by(request).aggregate([("started", "min"), ("ended", "min"), ("last", "max")])
            named = found.select([request, "started_min", "ended_min", "last_max"]).rename_columns([request, "started", "ended", "last"])
            yield from named.to_batches()

    return run


class Watch:
    """The state of one request: (started, ended, closed), or closed for good.

    Times are microseconds; a timer is set in milliseconds, to the first one at which a
    watermark beyond it is beyond the deadline.
    """

    def __init__(self, seconds: int, keep_closed: int | None):
        self.wait, self.keep, self.message = seconds * 1_000_000, keep_closed, TIMED_OUT.format(seconds=seconds)

    def __call__(self, key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        started, ended, closed = state.get if state.exists else (None, None, False)
        if closed and self.forgotten(started, state):
            state.remove()
            started, ended, closed = None, None, False
        if state.hasTimedOut:
            if started is not None and not closed:
                yield from self.close(key, started, ended, state)
            return
        if closed:
            self.stay_closed(started, ended, state)
            return
        for part in rows:
            started = _least(started, part["started"])
            ended = _least(ended, part["ended"])
        if started is None:
            return  # no event had a time
        deadline = started + self.wait
        if state.getCurrentWatermarkMs() * 1000 > deadline:  # it came later than the watermark allows for
            yield from self.close(key, started, ended, state)
            return
        state.update((started, ended, False))
        state.setTimeoutTimestamp(max(deadline // 1000, state.getCurrentWatermarkMs() + 1))

    def close(self, key: tuple, started: int, ended: int | None, state: GroupState) -> Iterator[pd.DataFrame]:
        """The deadline has passed: report the request if it had not ended, and stay closed."""
        deadline = started + self.wait
        self.stay_closed(started, ended, state)
        if ended is None or ended > deadline:
            at = pd.to_datetime([started], unit="us")
            yield pd.DataFrame({"request": list(key), "started_at": at, "message": [self.message]})


    def forgotten(self, started: int, state: GroupState) -> bool:
        return self.keep is not None and state.getCurrentWatermarkMs() > self.forget_at(started)

    def forget_at(self, started: int) -> int:
        return (started + self.wait) // 1000 + 1000 * self.keep

    def stay_closed(self, started: int, ended: int | None, state: GroupState) -> None:
        if self.keep is None:
            state.update((started, ended, True))
        elif not self.forgotten(started, state):
            state.update((started, ended, True))
            state.setTimeoutTimestamp(max(self.forget_at(started), state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()


def _least(known: int | None, found: pd.Series) -> int | None:
    values = found.to_numpy()  # once per request and batch, where pandas' own methods are dear
    if values.dtype.kind != "i":
        values = found.dropna().to_numpy()
    if not len(values):
        return known
    least = int(values.min())
    return least if known is None else min(known, least)


def stream_deadlines_state(
    events: DataFrame,
    target: str,
    checkpoint: str,
    request: str = "request_id",
    *,
    seconds: int = DEADLINE_SECONDS,
    delay: str = "0 seconds",
    keep_closed: int | None = None,
    available_now: bool = True,
) -> StreamingQuery:
    """Report each request that has not ended when event time passes its deadline, once.

    Needs ``ts`` and ``type``. A request is keyed state with a timer at its deadline, which goes off
    when the watermark, the latest time of earlier batches less ``delay``, has passed it: within ``delay``
    events may come in any order; those that come later still may be left out. A closed
    request stays as one flag, for good or until ``keep_closed`` seconds of event time after its
    deadline; events it sends meanwhile change nothing. Reports are appended to the table at ``target``. Nothing
    else is written, and a batch reads no more than its own rows and the states they touch.
    """
    kind = events.schema[request].dataType
    ts = F.col("ts").cast("timestamp")
    ended = F.when(F.col("type").isin("done", "error"), F.unix_micros(ts))
    times = events.select(request, F.unix_micros(ts).alias("started"), ended.alias("ended"), ts.alias("last")).where("last IS NOT NULL")
    combined = times.mapInArrow(_combined(request), f"`{request}` {kind.simpleString()}, {_TIMES}")
    late = (
        combined.withWatermark("last", delay)
        .groupBy(request)
        .applyInPandasWithState(
            Watch(seconds, keep_closed),
            f"request {kind.simpleString()}, started_at timestamp, message string",
            "started bigint, ended bigint, closed boolean",
            "append",
            GroupStateTimeout.EventTimeTimeout,
        )
    )
    writer = late.withColumnRenamed("request", request).writeStream.format("parquet").outputMode("append")
    writer = writer.option("path", target).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def read_deadlines(spark: SparkSession, target: str, request: str = "request_id", kind: str = "string") -> DataFrame:
    """(request, started_at, message) of the requests that missed their deadline so far."""
    schema = T.StructType.fromDDL(f"`{request}` {kind}, started_at timestamp, message string")
    return existing_table(spark, target, schema)
