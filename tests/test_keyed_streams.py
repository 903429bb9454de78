"""Streams with keyed state and with upsert tables."""

import datetime as dt
import pathlib

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F, types as T

from caselens.operators import events as E
from caselens.plans import registered_flows
from caselens.streaming import answers, load, state, timers
from caselens.sources.upserts import UpsertTable

START = dt.datetime(2024, 1, 1)
LOG = "request_id string, ts timestamp, type string"


def put(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))


def stream_of(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


# ---- upsert table ---------------------------------------------------------------------

SCHEMA = T.StructType().add("k", "long").add("most", "integer").add("total", "long")


def upsert_table(tmp_path, **options):
    return UpsertTable(str(tmp_path / "table"), SCHEMA, ["k"], {"most": "max", "total": "sum"}, **options)


def content(table, spark):
    return sorted((tuple(r) for r in table.read(spark).collect()), key=repr)


def files(tmp_path):
    return {str(p.relative_to(tmp_path)) for p in (tmp_path / "table").rglob("*.parquet") if "kind=" in str(p)}


def test_upserts_merge_and_skip_what_was_applied(spark, tmp_path):
    table = upsert_table(tmp_path, buckets=4, compact_after=2)
    first = spark.createDataFrame([(1, 5, 1), (1, 7, 1), (2, 1, 1), (None, 3, 2)], SCHEMA)
    table.upsert(first, "run:0")
    table.upsert(first, "run:0")  # the batch again, after its manifest
    assert content(table, spark) == sorted([(1, 7, 2), (2, 1, 1), (None, 3, 2)], key=repr)
    for i in range(1, 8):
        table.upsert(spark.createDataFrame([(1, i, 1)], SCHEMA), f"run:{i}")
    assert content(table, spark) == sorted([(1, 7, 9), (2, 1, 1), (None, 3, 2)], key=repr)
    table.upsert(first.limit(0), "run:8")
    assert len(content(table, spark)) == 3
    table.upsert(spark.createDataFrame([(9, 9, 9)], SCHEMA), "run:9", cleared=True)
    assert content(table, spark) == [(9, 9, 9)]


def test_a_batch_writes_only_the_buckets_it_touches(spark, tmp_path):
    table = upsert_table(tmp_path, buckets=16, compact_after=3)
    table.upsert(spark.range(200).select(F.col("id").alias("k"), F.lit(1).alias("most"), F.lit(1).cast("long").alias("total")), "0")
    one = spark.createDataFrame([(5, 2, 1)], SCHEMA)
    (bucket,) = one.select(table.bucket()).first()
    for i in range(1, 12):
        before = files(tmp_path)
        table.upsert(one, str(i))
        new = files(tmp_path) - before
        assert new and all(f"bucket={bucket}/" in name for name in new)
        assert len(table.last(spark).of(bucket)) <= 4
    # compacted folders are removed, and so are old manifests
    assert len({n for n in files(tmp_path) if f"bucket={bucket}/" in n}) <= 8
    assert len(list((tmp_path / "table").glob("manifest=*"))) == 2
    assert dict((r.k, r.total) for r in table.read(spark).collect())[5] == 12
    assert table.read(spark, [bucket]).where("k = 5").count() == 1


def test_a_batch_that_failed_before_its_manifest_is_replaced(spark, tmp_path):
    table = upsert_table(tmp_path, buckets=4)
    table.upsert(spark.createDataFrame([(1, 1, 1)], SCHEMA), "0")
    table._write(spark.createDataFrame([(2, 2, 2), (3, 3, 3)], SCHEMA), "delta", 1)  # written, then lost
    assert content(table, spark) == [(1, 1, 1)]
    table.upsert(spark.createDataFrame([(2, 2, 2)], SCHEMA), "1")
    assert content(table, spark) == [(1, 1, 1), (2, 2, 2)]


# ---- latest state ---------------------------------------------------------------------

UPDATES = T.StructType().add("id", "string").add("seq", "long").add("status", "string").add("amount", "double").add("clear", "boolean")


def test_latest_state_equals_batch_after_each_file(spark, tmp_path):
    parts = [
        [("a", 1, "new", None, None), ("b", 2, None, 1.0, False), (None, 3, "x", None, None)],
        [("a", 4, None, 2.0, False), ("a", 5, "old", None, False)],
        [("a", 6, None, None, True), ("c", 7, "new", 3.0, None), ("a", 8, "again", None, False)],
        [("c", 9, "z", None, False), ("b", 10, "b", None, False)],
    ]
    source, fields = tmp_path / "updates", ["status", "amount"]
    for i, rows in enumerate(parts):
        put(spark, source, rows, UPDATES)
        state.stream_latest_state(
            stream_of(spark, source, UPDATES), str(tmp_path / "states"), str(tmp_path / "checkpoint"),
            "id", ["seq"], fields, F.col("clear"), buckets=4, compact_after=1,
        ).awaitTermination()
        found = state.read_latest_state(spark, str(tmp_path / "states"), UPDATES, "id", ["seq"], fields, buckets=4)
        batch = E.latest_state(spark.read.schema(UPDATES).parquet(str(source)), "id", ["seq"], fields, F.col("clear"))
        assert sorted(map(repr, found.collect())) == sorted(map(repr, batch.collect())), i


# ---- deadlines ------------------------------------------------------------------------


def at(second):
    return START + dt.timedelta(seconds=second)


def late(spark, tmp_path, parts, name="late", **options):
    folder = tmp_path / f"log-{name}"
    for rows in parts:
        put(spark, folder, [(r, at(s) if s is not None else None, kind) for r, s, kind in rows], LOG)
    timers.stream_deadlines_state(
        stream_of(spark, folder, LOG), str(tmp_path / name), str(tmp_path / f"checkpoint-{name}"), seconds=100, **options
    ).awaitTermination()
    found = timers.read_deadlines(spark, str(tmp_path / name)).collect()
    return sorted((r.request_id, int((r.started_at - START).total_seconds())) for r in found)


PARTS = [
    [("slow", 0, "output"), ("fine", 1, "output"), ("tie", 2, "output"), ("none", None, "output"), ("bad", 3, "output")],
    [("fine", 101, "done"), ("bad", 50, "error"), ("tie", 102, "output")],
    [("slow", 150, "done"), ("again", 160, "output")],
    [("slow", 400, "output"), ("fine", 410, "output"), ("open", 420, "output"), ("edge", 421, "output")],
    [("slow", 700, "output"), ("last", 521, "output")],
]


LATE = [("again", 160), ("edge", 421), ("last", 521), ("open", 420), ("slow", 0), ("tie", 2)]


def test_timers_report_each_late_request_once(spark, tmp_path):
    assert late(spark, tmp_path, PARTS) == LATE


def test_a_closed_request_can_be_forgotten(spark, tmp_path):
    found = late(spark, tmp_path, [*PARTS, [("z", 900, "output")]], "brief", keep_closed=60)
    assert set(found) - set(LATE) == {("slow", 700)}  # silent for longer, it is a new one


def test_a_delay_lets_events_come_out_of_order(spark, tmp_path):
    parts = [[("a", 50, "output")], [("a", 10, "output"), ("b", 120, "output")], [("a", 130, "done"), ("c", 400, "output")]]
    assert late(spark, tmp_path, parts, "delayed", delay="60 seconds") == [("a", 10), ("b", 120)]


def test_timers_go_on_where_they_stopped(spark, tmp_path):
    assert late(spark, tmp_path, PARTS[:2]) == [("slow", 0)]
    assert late(spark, tmp_path, PARTS[2:]) == LATE


# ---- answers --------------------------------------------------------------------------

OUTPUT = "request_id string, seq bigint, type string, text string"
CHARS = ["-", "--", " ", "Answer", "--- Answer ---", "--- Ans", "wer ---", "x", "\n", "　", "é", "--- ", ""]


def whole_split(text):
    thinking, marker, answer = text.partition(E.ANSWER_MARKER)
    return thinking.strip(), answer.strip() if marker else None


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(CHARS), max_size=12))
def test_the_matcher_resumes_anywhere(pieces):
    split, text = answers.Split(), ""
    for piece in pieces:
        split.take(piece)
        text += piece
        length, marker_at, t0, t1, a0, a1 = split.places()
        thinking, answer = whole_split(text)
        assert length == len(text) and marker_at == text.find(E.ANSWER_MARKER)
        assert (text[t0:t1] if t0 >= 0 else "") == thinking
        assert (text[a0:a1] if a0 >= 0 else "") == (answer or "")


def test_answers_equal_batch_after_each_file(spark, tmp_path):
    parts = [
        [("a", 1, "output", "  thin"), ("b", 1, "output", "-- Ans"), ("c", 1, "done", None), ("d", 2, "output", "--- Answer")],
        [("a", 3, "output", "king \n -"), ("a", 2, "output", "k"), ("b", 4, "output", "wer ---"), ("d", 5, "output", " ---  \n")],
        [("a", 6, "output", "-- Answer --"), ("d", 7, "error", "no"), (None, 8, "output", "x" * 25)],
        [("a", 9, "output", "-"), ("a", 10, "output", " 　 yes " * 5), ("d", 11, "output", "\t so \n")],
        [("a", 12, "output", "--- Answer --- more"), ("b", 13, "output", None)],
    ]
    source = tmp_path / "log"
    for i, rows in enumerate(parts):
        put(spark, source, rows, OUTPUT)
        stream = stream_of(spark, source, OUTPUT)
        answers.stream_answers(
            stream, str(tmp_path / "answers"), str(tmp_path / "checkpoint"), page_chars=10, buckets=4, compact_after=2
        ).awaitTermination()
        found = answers.read_answers(spark, str(tmp_path / "answers"), stream.schema["request_id"], 10, buckets=4)
        got = sorted((tuple(r) for r in found.collect()), key=repr)
        batch = E.answer_split(spark.read.schema(OUTPUT).parquet(str(source)), page_chars=10)
        want = sorted((tuple(r) for r in batch.collect()), key=repr)
        assert got == [r for r in want if r[0]], i  # output without a request is nobody's
    assert pathlib.Path(tmp_path / "answers" / "requests").exists()


# ---- CSV ------------------------------------------------------------------------------


def test_files_are_loaded_once_by_their_own_headers(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    schema, mapping = T.StructType().add("n", "integer").add("name", "string"), {"n": "id", "name": "label"}

    def run(checkpoint="checkpoint"):
        load.stream_csv(
            spark, str(folder), str(tmp_path / "out"), str(tmp_path / checkpoint), schema, mapping, files_per_batch=1
        ).awaitTermination()
        rows, rejects = load.read_loaded(spark, str(tmp_path / "out"), schema)
        return sorted(map(tuple, rows.collect())), sorted(r.reason for r in rejects.collect())

    (folder / "a.csv").write_text("id,label,other\n1,one,x\nx,two,y\n3,three\n")
    (folder / "b.csv").write_text('label,id\n"quoted, four",4\n')
    (folder / "empty.csv").write_text("")
    assert run() == ([(1, "one"), (4, "quoted, four")], ["n", "wrong number of cells"])
    assert run() == ([(1, "one"), (4, "quoted, four")], ["n", "wrong number of cells"])
    (folder / "c.csv").write_text("id,label\n5,five\n")
    assert run()[0] == [(1, "one"), (4, "quoted, four"), (5, "five")]
    # all batches again, as after a lost checkpoint: each replaces its own folder
    for file in sorted((tmp_path / "checkpoint" / "commits").glob("*")):
        file.unlink()
    assert run()[0] == [(1, "one"), (4, "quoted, four"), (5, "five")]


# ---- logs in slices -------------------------------------------------------------------


def test_slices_of_a_log_are_batches_of_several_files(spark, tmp_path, monkeypatch):
    """Slices of many rows are written by several tasks, and ties may leave slices without rows."""
    monkeypatch.setattr(registered_flows, "_FILE_ROWS", 20)
    for name, seq in {"spread": F.col("id"), "ties": F.when(F.col("id") < 390, 7).otherwise(F.col("id"))}.items():
        log = spark.range(400).select(seq.cast("long").alias("seq"), "id").repartition(5)
        stream, batches = registered_flows._in_order(spark, log, "seq"), []

        def keep(batch, number):
            rows = batch.select("seq", F.input_file_name().alias("file")).collect()
            batches.append((len({r.file for r in rows}), [r.seq for r in rows]))

        writer = stream.writeStream.foreachBatch(keep).option("checkpointLocation", str(tmp_path / name))
        writer.trigger(availableNow=True).start().awaitTermination()
        assert sorted(s for _, seqs in batches for s in seqs) == sorted(r.seq for r in log.collect())
        full = [seqs for _, seqs in batches if seqs]
        assert all(max(a) < min(b) for a, b in zip(full, full[1:]))
        if name == "spread":
            assert len(full) == 6 and all(files == 4 for files, _ in batches)
