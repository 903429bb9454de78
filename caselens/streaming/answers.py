"""Answers while they stream: output is cut at the first marker as it comes.

The state of a request is some numbers whatever it has written: the length so far, how much of
the marker its end may be the start of, where the marker was, and where the first and last
character that is no white space is in front of the marker and behind it. A marker may be cut
anywhere, over any number of batches. The output itself is appended as pages; the places and the
state per request are merged into an upsert table, and a batch joins the states with its texts. A reader cuts the pages at these places, so at any
time it gets what the batch operator would make of the output so far.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, astuple, dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from caselens.functions.text import PYTHON_SPACE_CHARS
from caselens.operators.events import ANSWER_MARKER, PAGE_CHARS, split_pages
from caselens.sources.csv_tables import existing_table
from caselens.sources.upserts import UpsertTable

_PLACES = ["length", "marker_at", "thinking_from", "thinking_to", "answer_from", "answer_to"]


@dataclass
class Split:
    """Where a request's output is cut; -1 for places not seen yet. Of the ``length`` characters
    the last ``matched`` may begin the marker and are not judged yet."""

    length: int = 0
    matched: int = 0
    marker_at: int = -1
    thinking_from: int = -1
    thinking_to: int = -1
    answer_from: int = -1
    answer_to: int = -1

    def take(self, text: str) -> None:
        if self.marker_at >= 0:
            self._ink(text, self.length, "answer")
            self.length += len(text)
            return
        at = self.length - self.matched
        tail = ANSWER_MARKER[: self.matched] + text
        found = tail.find(ANSWER_MARKER)
        self.length += len(text)
        if found >= 0:
            self._ink(tail[:found], at, "thinking")
            self.marker_at, self.matched = at + found, 0
            rest = found + len(ANSWER_MARKER)
            self._ink(tail[rest:], at + rest, "answer")
            return
        self.matched = _open_marker(tail)
        self._ink(tail[: len(tail) - self.matched], at, "thinking")

    def _ink(self, text: str, at: int, part: str) -> None:
        inked = text.lstrip(PYTHON_SPACE_CHARS)
        if not inked:
            return
        if getattr(self, f"{part}_from") < 0:
            setattr(self, f"{part}_from", at + len(text) - len(inked))
        setattr(self, f"{part}_to", at + len(text.rstrip(PYTHON_SPACE_CHARS)))

    def places(self) -> list[int]:
        """The places if nothing more came: then what might have been a marker is thinking."""
        seen = Split(*astuple(self))
        seen._ink(ANSWER_MARKER[: seen.matched], seen.length - seen.matched, "thinking")
        return [getattr(seen, p) for p in _PLACES]


def _open_marker(text: str) -> int:
    """How many of the last characters begin the marker, at most."""
    longest = min(len(text), len(ANSWER_MARKER) - 1)
    return next((n for n in range(longest, 0, -1) if text.endswith(ANSWER_MARKER[:n])), 0)


def _pages(text: str, at: int, size: int) -> Iterator[tuple[int, int, str]]:
    """(page, place, piece) of text that begins at ``at``."""
    begin = 0
    while begin < len(text):
        page = (at + begin) // size
        end = min(len(text), (page + 1) * size - at)
        yield page, at + begin, text[begin:end]
        begin = end


_PLACES_TYPE = T.StructType([T.StructField(p, T.LongType()) for p in _PLACES])
_SPLIT_TYPE = T.StructType([T.StructField(f, T.LongType()) for f in Split.__dataclass_fields__])
_PLACES_ARROW, _SPLIT_ARROW = (pa.struct([(f.name, pa.int64()) for f in kind]) for kind in (_PLACES_TYPE, _SPLIT_TYPE))


def _advance(page_chars: int):
    """From (request, text of the batch, state before): the pieces of the text, and a row of the
    places and the state after it without a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, (text, state) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                split = Split(**state) if state else Split()
                begin = split.length
                if text:
                    split.take(text)
                    rows += [(i, page, at, piece, None, None) for page, at, piece in _pages(text, begin, page_chars)]
                rows.append((i, None, None, None, dict(zip(_PLACES, split.places())), asdict(split)))
            if rows:
                own, *columns = zip(*rows)
                kinds = [pa.int64(), pa.int64(), pa.string(), _PLACES_ARROW, _SPLIT_ARROW]
                arrays = [batch.column(0).take(pa.array(own)), *(pa.array(c, k) for c, k in zip(columns, kinds))]
                yield pa.RecordBatch.from_arrays(arrays, names=["request", "page", "at", "text", "places", "state"])

    return run


def _table(target: str, request: T.StructField, **options) -> UpsertTable:
    # the length comes first and never goes back, so the largest is the latest
    schema = T.StructType([T.StructField("request", request.dataType)]).add("places", _PLACES_TYPE).add("state", _SPLIT_TYPE)
    return UpsertTable(target, schema, ["request"], {"places": "max", "state": "max"}, **options)


def stream_answers(
    events: DataFrame,
    target: str,
    checkpoint: str,
    request: str = "request_id",
    *,
    page_chars: int = PAGE_CHARS,
    available_now: bool = True,
    **options,
) -> StreamingQuery:
    """Follow the output of all requests: (request, ``seq``, type, text) rows, batches in the order
    of ``seq``.

    Below ``target``, ``pages`` has the output by batch and ``requests`` the places and states. A batch
    reads the states in the buckets it touches; a request's output of one batch is put in order in one
    task. Events without a request are left out. A batch that runs again replaces its pages, and changes
    nothing once its states are written.
    """
    field = events.schema[request]
    table = _table(f"{target}/requests", field, **options)
    said = F.when(F.col("type") == "output", F.col("text")).alias("text")
    own = events.where(F.col(request).isNotNull()).select(F.col(request).alias("request"), "seq", said)
    schema = T.StructType([T.StructField("request", field.dataType)]).add("page", "long").add("at", "long").add("text", "string")
    schema = schema.add("places", _PLACES_TYPE).add("state", _SPLIT_TYPE)

    def write(batch: DataFrame, batch_id: int) -> None:
        spark, tag = batch.sparkSession, f"{checkpoint}:{batch_id}"
        if table.last(spark).tag == tag:
            return
        touched = [r[0] for r in batch.select(table.bucket()).distinct().collect()]
        known = table.read(spark, touched).select("request", "state")
        texts = batch.groupBy("request").agg(F.expr("listagg(text, '') within group (order by seq)").alias("text"))
        split = texts.join(known, "request", "left").mapInArrow(_advance(page_chars), schema)
        path = f"{target}/pages/batch={batch_id}"
        split.withColumn("is_text", F.col("page").isNotNull()).write.mode("overwrite").partitionBy("is_text").parquet(path)
        written = spark.read.schema(T.StructType(list(schema.fields)).add("is_text", "boolean")).parquet(path)
        table.upsert(written.where("NOT is_text").select("request", "places", "state"), tag)

    writer = own.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def read_answers(
    spark: SparkSession, target: str, request: T.StructField, page_chars: int = PAGE_CHARS, **options
) -> DataFrame:
    """(request, part, page, text) of the output so far, as :func:`caselens.operators.events.answer_split`."""
    places = _table(f"{target}/requests", request, **options).read(spark).select("request", "places.*")
    schema = T.StructType([T.StructField("request", request.dataType)]).add("page", "long").add("at", "long").add("text", "string")
    stored = existing_table(spark, f"{target}/pages", T.StructType(list(schema.fields)).add("batch", "integer").add("is_text", "boolean"))
    pieces = stored.where("is_text").select(*schema.names)
    pages = pieces.groupBy("request", "page").agg(F.expr("listagg(text, '') within group (order by at)").alias("body"))
    return split_pages(pages, places, "request", page_chars).withColumnRenamed("request", request.name)
