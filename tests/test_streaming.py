import datetime as dt
import json
import pathlib

from pyspark.sql import functions as F

from caselens.operators import events as E
from caselens.operators.embed import TokenHashEmbedder
from caselens.sources import frames, vector_store
from caselens.streaming import embed as stream_embedding, status as stream_status

DOC = "source_table string, source_id string, content string, metadata string"


def put(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def test_embeds_each_document_once(spark, tmp_path):
    source, target = str(tmp_path / "docs"), str(tmp_path / "vectors")

    def run(checkpoint):
        stream = spark.readStream.schema(DOC).option("maxFilesPerTrigger", 1).parquet(source)
        query = stream_embedding.stream_embed(stream, target, str(tmp_path / checkpoint), TokenHashEmbedder(8))
        query.awaitTermination()
        stored = vector_store.read_vectors(spark, target)
        return sorted((r.source_table, r.source_id) for r in stored.collect())

    put(spark, source, [("a", "1", "one", "{}"), ("a", "1", "one", "{}"), ("a", "2", "  ", "{}")], DOC)
    put(spark, source, [("a", "1", "one", "{}"), ("b", "1", "uno", "{}")], DOC)
    assert run("first") == [("a", "1"), ("b", "1")]
    put(spark, source, [("b", "2", "dos", "{}"), ("b", "1", "uno", "{}")], DOC)
    assert run("first") == [("a", "1"), ("b", "1"), ("b", "2")]  # goes on where it stopped
    assert run("second") == [("a", "1"), ("b", "1"), ("b", "2")]  # and from the start adds nothing


START = dt.datetime(2024, 1, 1)


def event(request, seq, second, kind, message=None):
    return (request, seq, START + dt.timedelta(seconds=second), kind, None, message, False)


EVENT = "request_id string, seq bigint, ts timestamp, type string, text string, message string, malformed boolean"
FILES = [
    [event("fine", 0, 0, "output"), event("slow", 1, 1, "output"), event("bad", 2, 2, "output")],
    [event("bad", 3, 50, "error", "first"), event("fine", 4, 60, "done"), event("tie", 5, 61, "output")],
    [event("bad", 6, 130, "error", "second"), event("slow", 7, 140, "output")],
    [event("slow", 8, 150, "done"), event("tie", 9, 181, "done"), event("open", 10, 200, "output")],
    [event("last", 11, 300, "output")],
]


def stored(spark, folder):
    for rows in FILES:
        put(spark, folder, rows, EVENT)
    assert len(list(pathlib.Path(folder).glob("*.parquet"))) == len(FILES)
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(folder)


def test_status_equals_batch(spark, tmp_path):
    stream = stored(spark, str(tmp_path / "events"))
    target = str(tmp_path / "status")
    stream_status.stream_request_status(stream, target, str(tmp_path / "checkpoint")).awaitTermination()
    found = stream_status.read_request_status(spark, target)
    batch = E.request_status(spark.read.parquet(str(tmp_path / "events")))
    assert sorted(map(repr, found.collect())) == sorted(map(repr, batch.collect()))
    assert found.where("request_id = 'bad'").first().message == "first"


def late_requests(spark, tmp_path, **options):
    stream = stored(spark, str(tmp_path / "events"))
    target = str(tmp_path / "late")
    stream_status.stream_deadlines(stream, target, str(tmp_path / "checkpoint"), **options).awaitTermination()
    return stream_status.read_deadlines(spark, target).collect()


def test_deadlines_equal_batch(spark, tmp_path):
    found = late_requests(spark, tmp_path, seconds=100)
    events = spark.read.parquet(str(tmp_path / "events"))
    batch = E.request_deadline(events, seconds=100, as_of=F.lit(START + dt.timedelta(seconds=300)))
    wanted = {(r.request_id, r.started_at, r.message) for r in batch.where("timed_out").collect()}
    assert {tuple(r) for r in found} == wanted and len(found) == len(wanted)  # each once
    assert {r.request_id for r in found} == {"slow", "tie"}


def test_a_request_that_returns_after_long_silence_is_reported_once(spark, tmp_path):
    folder, target = str(tmp_path / "events"), str(tmp_path / "late")
    day = 86_400
    files = [
        [event("r", 0, 0, "output"), event("quiet", 1, 0, "output"), event("quiet", 2, 5, "done")],
        [event("x", 3, 200, "output")],
        [event("x", 4, 5 * day, "output")],
        [event("r", 5, 5 * day + 1, "output"), event("quiet", 6, 5 * day + 1, "output")],
        [event("r", 7, 9 * day, "output"), event("y", 8, 9 * day, "output")],
    ]
    for rows in files:
        put(spark, folder, rows, EVENT)
    stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(folder)
    stream_status.stream_deadlines(stream, target, str(tmp_path / "c"), seconds=100).awaitTermination()
    found = stream_status.read_deadlines(spark, target).collect()
    assert sorted((r.request_id, r.started_at) for r in found) == [
        ("r", START), ("x", START + dt.timedelta(seconds=200)),
    ]
    kept = sorted(p.name for p in (tmp_path / "late" / "open").iterdir())
    assert kept == ["batch=3", "batch=4"]  # and no older copies


def test_status_summaries_are_merged(spark, tmp_path):
    stream = stored(spark, str(tmp_path / "events"))
    target = str(tmp_path / "status")
    stream_status.stream_request_status(stream, target, str(tmp_path / "c"), merge_every=2).awaitTermination()
    found = stream_status.read_request_status(spark, target)
    batch = E.request_status(spark.read.parquet(str(tmp_path / "events")))
    assert sorted(map(repr, found.collect())) == sorted(map(repr, batch.collect()))
    assert not (tmp_path / "status" / "batch=0").exists() and (tmp_path / "status" / "merged=3").exists()


def test_frames_as_a_stream(spark, tmp_path):
    folder = tmp_path / "frames"
    folder.mkdir()
    for i in range(3):
        payloads = [{"type": "output", "text": f"{i}\n"}, {"type": "done"}]
        (folder / f"{i}.txt").write_text("".join(f"data: {json.dumps(p)}\n\n" for p in payloads))
    parsed = frames.parse_frames(frames.stream_frames(spark, str(folder), 1)).drop("frame")
    parsed.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(
        availableNow=True
    ).start(str(tmp_path / "out")).awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted(r.text for r in rows if r.type == "output") == ["0\n", "1\n", "2\n"]
    assert sum(r.type == "done" for r in rows) == 3 and not any(r.malformed for r in rows)
