"""Registered queries on whole flows and on cases the other ones leave out."""

from __future__ import annotations

import hashlib
import math

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import functions as F, types as T

from caselens.functions import links, paths
from caselens.functions.json_filter import metadata_contains
from caselens.functions.text import pretty_json
from caselens.functions.vectors import cosine_distance
from caselens.operators import bounds, documents, embed, events, ivf, pq, topk
from caselens.plans import ingest, sql_tool
from caselens.plans.registered_tables import as_double, as_text, registered
from caselens.plans.registered_text import (
    _DOCS,
    _DISTANCE_SQL,
    _documents,
    _MULTI_SQL,
    _PAGE,
    _SPLIT_SQL,
    _events,
    EMBEDDER,
    PROBED_SHARE,
    QUESTION,
    WIDTH,
    _as_questions,
    describe_by_size,
)
from caselens.plans.standins import table, view, with_views
from caselens.schemas import DEFAULT_TOP_K, RECORD_TABLES
from caselens.scratch import scratch_path, write_and_reread
from caselens.sources import csv_tables
from caselens.streaming import answers as stream_answers_, load, state as stream_state, status as stream_status, timers

# ---- CSV ------------------------------------------------------------------------------


@registered(
    with_views(
        "billing",
        then="""SELECT bill_id, patient_id, treatment_id, CAST(bill_date AS VARCHAR) AS bill_date,
                       CAST(amount AS DOUBLE) AS amount, payment_method, payment_status FROM billing""",
    )
)
def csv_mixed_headers(spark, sf):
    """One folder of files whose columns come in two orders."""
    source = scratch_path(spark, "bills-csv")
    bills = view(spark, sf, "billing")
    turned = bills.select(*reversed(bills.columns))
    for part, paid in ((bills, True), (turned, False)):
        part.where((F.col("payment_status") == "Paid") == paid).write.mode("append").option("header", True).csv(source)
    rows, _rejects = csv_tables.read_record_table(spark, source, "billing")
    return rows.transform(as_double("amount")).transform(as_text("bill_date"))


_MAPPED_SQL = """SELECT event_id, CASE WHEN event_type <> 'error' THEN event_type END AS kind, event_type = 'error' AS rejected
       FROM events"""


def _write_events(spark, sf, source, half=None):
    """Events, or a half of them in files of two column orders, as CSV: a column to ignore, and
    lines with a cell too many."""
    cells = table(spark, sf, "events").select(
        F.col("event_id").alias("id"),
        F.when(F.col("event_type") == "error", F.lit("x,y")).otherwise(F.lit("x")).alias("junk"),
        F.col("event_type").alias("type"),
    )
    parts = [cells]
    if half is not None:
        own = cells.where(F.col("id") % 2 == half)
        parts = [own.where(F.col("id") % 3 == 0), own.where(F.col("id") % 3 != 0).select("id", "type", "junk")]
    for part in parts:
        part.write.mode("append").option("header", True).option("quote", "\u0000").csv(source)  # unquoted, so x,y is two cells


def _with_rejects(rows, rejects):
    lost = rejects.select(
        F.regexp_extract("record", r"^(\d+),", 1).cast("bigint").alias("event_id"),
        F.lit(None).cast("string").alias("kind"),
        F.lit(True).alias("rejected"),
    )
    return rows.withColumn("rejected", F.lit(False)).unionByName(lost)


def _mapped():
    return T.StructType().add("event_id", "long").add("kind", "string"), {"event_id": "id", "kind": "type"}


@registered(_MAPPED_SQL)
def csv_mapped(spark, sf):
    """A renamed column, an ignored one, and lines with a cell too many, each line a row or a reject."""
    source = scratch_path(spark, "events-csv")
    _write_events(spark, sf, source)
    return _with_rejects(*csv_tables.read_csv(spark, source, *_mapped()))


@registered(_MAPPED_SQL)
def stream_csv(spark, sf):
    """The same from a folder that grows while it is loaded, by files of two headers; the second
    run loads only what came since the first."""
    source, target, checkpoint = (scratch_path(spark, name) for name in ("events-csv", "loaded", "checkpoint"))
    schema, mapping = _mapped()
    for part in (0, 1):
        _write_events(spark, sf, f"{source}/{part}", part)
        load.stream_csv(spark, source, target, checkpoint, schema, mapping, files_per_batch=2).awaitTermination()
    return _with_rejects(*load.read_loaded(spark, target, schema))


# ---- ingest ---------------------------------------------------------------------------


def _write_files(files, folder: str) -> int:
    """Write (image_path, image_text) rows as files below ``folder``, in tasks; their number."""
    url = folder if "://" in folder else "file://" + folder.removeprefix("file:")

    def write(batches):
        store, base = fs.FileSystem.from_uri(url)
        made = set()
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                below = f"{base}/{name}".rsplit("/", 1)[0]
                if below not in made:
                    store.create_dir(below, recursive=True)
                    made.add(below)
                with store.open_output_stream(f"{base}/{name}") as out:
                    out.write(text.encode())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    tasks = 2 * files.sparkSession.sparkContext.defaultParallelism
    written = files.select("image_path", "image_text").repartition(tasks).mapInArrow(write, "n bigint")
    return written.agg(F.sum("n")).first()[0] or 0


@registered(
    with_views(
        *_DOCS,
        then=f"""
        SELECT source_table, source_id, min(content) AS content,
               CAST(strlen(arg_min(metadata, content)) AS INT) AS metadata_bytes
        FROM ({" UNION ALL ".join(_DOCS.values())}) GROUP BY source_table, source_id""",
    )
)
def ingest_csv(spark, sf):
    """The record tables as CSV files and the images as files, ingested twice: loaded, described
    from the bytes read, embedded and stored. The second run adds nothing."""
    source, target = scratch_path(spark, "csv"), scratch_path(spark, "ingested")
    for name, spec in RECORD_TABLES.items():
        records = view(spark, sf, name)
        have = [c if c in records.columns else F.lit(None).cast("string").alias(c) for c in spec.schema.names]
        records.select(*have).write.option("header", True).csv(f"{source}/{name}.csv")
    _write_files(view(spark, sf, "xray"), source)
    for _ in range(2):
        store, _violations = ingest.ingest(spark, source, target, EMBEDDER, describe_by_size, attempts=1)
    stored = store.where(F.size("embedding") == WIDTH)
    return stored.select("source_table", "source_id", "content", F.octet_length("metadata").alias("metadata_bytes"))


def _failures(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16) % 5


class FailsAtFirst:
    """Stands in for a service that fails on its first calls for a text, up to four times."""

    def __init__(self):
        self.calls: dict[str, int] = {}

    def __call__(self, text: str) -> str:
        self.calls[text] = self.calls.get(text, 0) + 1
        if self.calls[text] <= _failures(text):
            raise RuntimeError(f"failure {self.calls[text]}")
        return str(len(text.encode()))


@registered(
    """WITH p AS (SELECT conv_id, turn, strlen(text) AS n, CAST('0x' || substr(md5(text), 1, 8) AS BIGINT) % 5 AS s
                  FROM conversations)
       SELECT conv_id, turn, CASE WHEN s < 3 THEN CAST(n AS VARCHAR) END AS result,
              CAST(least(s + 1, 3) AS INT) AS attempts, CASE WHEN s >= 3 THEN 'failure 3' END AS error FROM p"""
)
def retried_calls(spark, sf):
    """Each text is tried up to three times."""
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "text")
    return embed.call_each(turns, "text", FailsAtFirst, attempts=3, delay=0.0).drop("text")


# ---- vectors --------------------------------------------------------------------------


@registered(
    f"""SELECT p.way, m.* FROM ({_MULTI_SQL.replace("FROM unit q, unit v", "FROM unit q, unit v WHERE q.vec_id IN (SELECT vec_id FROM embeddings WHERE label <> 3)")}) m,
        (VALUES ('scan'), ('grid')) p(way)"""
)
def topk_null_question(spark, sf):
    """Questions without a vector, here those of label 3, find nothing, in the scan and in the grid."""
    embeddings = table(spark, sf, "embeddings")
    asked = embeddings.select(
        F.col("vec_id").alias("question_id"), F.when(F.col("label") != 3, F.col("embedding")).alias("embedding")
    )
    ways = {"scan": {}, "grid": {"limit_bytes": 0, "grid_rows": 250}}
    found = [
        topk.nearest(embeddings, asked, width=WIDTH, id_columns=["vec_id"], **options).withColumn("way", F.lit(way))
        for way, options in ways.items()
    ]
    return found[0].unionByName(found[1]).withColumn("distance", F.abs(F.round("distance", 6)))


@registered(_MULTI_SQL)
def ann_ivf_grid(spark, sf):
    """All cells, with more questions than are sent to every executor."""
    cells = ivf.build_cells(
        table(spark, sf, "embeddings"), scratch_path(spark, "cells"), width=WIDTH, id_columns=["vec_id"], n_cells=8
    )
    found = ivf.nearest_in_cells(cells, _as_questions(spark, sf), n_probe=8, limit_bytes=0, grid_rows=50)
    return found.withColumn("distance", F.abs(F.round("distance", 6)))


def _quality(found, exact, n, recall):
    """Whether what was found has k different rows a question, exact distances, enough recall."""
    key = ["question_id", "vec_id"]
    both = found.join(exact.select(*key, F.lit(1).alias("hit")), key, "left")
    return both.agg(
        F.count(F.lit(1)).alias("n_rows"),
        (F.countDistinct(F.struct(*key)) == F.count(F.lit(1))).alias("distinct_ids"),
        (F.max(F.abs(F.col("distance") - F.col("true_distance"))) < 1e-6).alias("exact_distances"),
        (F.sum("hit") >= recall * n).alias("recalled"),
    )


def _with_true_distance(found, embeddings, questions):
    joined = found.join(embeddings.select("vec_id", F.col("embedding").alias("e")), "vec_id")
    joined = joined.join(questions.select("question_id", F.col("embedding").alias("q")), "question_id")
    return joined.withColumn("true_distance", cosine_distance(F.col("e"), F.col("q"))).drop("e", "q")


@registered(
    f"""SELECT count(*) * {DEFAULT_TOP_K} AS n_rows, true AS distinct_ids, true AS exact_distances, true AS recalled
        FROM embeddings"""
)
def ann_ivf_quality(spark, sf):
    """The cells that ``ann_ivf`` probes: k different rows a question, exact distances, recall of 0.9 at least."""
    embeddings, asked = table(spark, sf, "embeddings"), _as_questions(spark, sf)
    cells = ivf.build_cells(embeddings, scratch_path(spark, "cells"), width=WIDTH, id_columns=["vec_id"])
    found = ivf.nearest_in_cells(cells, asked, n_probe=math.ceil(PROBED_SHARE * len(cells.centres)))
    exact = topk.nearest(embeddings, asked, width=WIDTH, id_columns=["vec_id"])
    return _quality(_with_true_distance(found, embeddings, asked), exact, embeddings.count() * DEFAULT_TOP_K, 0.9)


@registered(
    f"""SELECT count(*) * {DEFAULT_TOP_K} AS n_rows, true AS distinct_ids, true AS exact_distances, true AS recalled
        FROM embeddings"""
)
def ann_pq_quality(spark, sf):
    """Product codes at their defaults: k different rows a question, exact distances, recall of 0.9 at least."""
    embeddings, asked = table(spark, sf, "embeddings"), _as_questions(spark, sf)
    found = _by_codes(spark, embeddings, asked)
    exact = topk.nearest(embeddings, asked, width=WIDTH, id_columns=["vec_id"])
    return _quality(_with_true_distance(found, embeddings, asked), exact, embeddings.count() * DEFAULT_TOP_K, 0.9)


def _by_codes(spark, embeddings, asked):
    codes = pq.build_codes(embeddings, scratch_path(spark, "codes"), width=WIDTH, id_columns=["vec_id"])
    return write_and_reread(pq.nearest_by_codes(codes, asked), "found")


_FILTERED_SQL = _MULTI_SQL.replace("FROM unit q, unit v", "FROM unit q, unit v WHERE v.vec_id IN (SELECT vec_id FROM embeddings WHERE label IN (3, 5))")


@registered(f"SELECT 'all' AS records, * FROM ({_MULTI_SQL}) UNION ALL SELECT 'labels 3 and 5', * FROM ({_FILTERED_SQL})")
def topk_by_bounds(spark, sf):
    """Exact search that leaves out cells by their bounds and by the labels they hold."""
    embeddings, asked = table(spark, sf, "embeddings"), _as_questions(spark, sf)
    cells = bounds.build_bounded_cells(
        embeddings, scratch_path(spark, "cells"), width=WIDTH, id_columns=["vec_id"], filters=["label"]
    )
    ways = {"all": None, "labels 3 and 5": {"label": [3, 5]}}
    found = [bounds.nearest_by_bounds(cells, asked, wanted=w).select(F.lit(name).alias("records"), "*") for name, w in ways.items()]
    return found[0].unionByName(found[1]).withColumn("distance", F.abs(F.round("distance", 6)))


@registered(_MULTI_SQL)
def cosine_topk_bounded(spark, sf):
    """All nearest vectors in two passes: a bound from a tenth of the vectors, then what is within it."""
    embeddings = table(spark, sf, "embeddings")
    found = topk.nearest_bounded(
        embeddings, _as_questions(spark, sf), width=WIDTH, id_columns=["vec_id"], sample_rows=max(1, embeddings.count() // 10)
    )
    return found.withColumn("distance", F.abs(F.round("distance", 6)))


@registered(
    f"""SELECT least(count(*), {DEFAULT_TOP_K}) AS n_rows, true AS distinct_ids, true AS exact_distances, true AS recalled
        FROM (SELECT {_DISTANCE_SQL} AS d FROM embeddings)"""
)
def ann_lsh_quality(spark, sf):
    """Hashing as in ``ann_lsh``: k different rows, exact distances, recall of 0.9 at least."""
    embeddings = table(spark, sf, "embeddings")
    asked = spark.range(1).select(
        F.lit(0).alias("question_id"), F.array(*[F.lit(x).cast("float") for x in QUESTION]).alias("embedding")
    )
    found = ivf.nearest_by_hashing(embeddings, QUESTION, id_columns=["vec_id"]).withColumn("question_id", F.lit(0))
    exact = topk.nearest_to(embeddings, QUESTION, id_columns=["vec_id"]).withColumn("question_id", F.lit(0))
    return _quality(_with_true_distance(found, embeddings, asked), exact, DEFAULT_TOP_K, 0.9)


# ---- metadata, audits -----------------------------------------------------------------

_K = "CAST(json_extract_string(props, '$.k') AS INT)"


@registered(
    f"""SELECT event_id, CASE event_type WHEN 'click' THEN 'objects in lists' WHEN 'view' THEN 'empty lists'
              WHEN 'error' THEN 'nested lists' ELSE 'scalars in lists' END AS held
        FROM events WHERE event_type IN ('click', 'view') AND {_K} % 3 = 0 OR event_type = 'error' AND {_K} % 3 = 1
            OR event_type IN ('purchase', 'signup') AND {_K} IN (5, 17)"""
)
def metadata_contains_array(spark, sf):
    """Lists at several depths of metadata, some empty, and what is wanted in them."""
    k = F.get_json_object("props", "$.k").cast("int")
    metadata = F.concat(
        F.lit('{"tags": ["x", '), k.cast("string"), F.lit(', {"a": [1, {"m": '), (k % 3).cast("string"), F.lit('}], "b": "'),
        F.col("event_type"), F.lit('"}, [[2, "'), F.col("event_type"), F.lit('"], ['), (k % 3).cast("string"), F.lit("]], [], null], "),
        F.lit('"none": '), F.when(k % 3 == 0, "[]").otherwise("{}"), F.lit("}"),
    )
    wanted = {
        "objects in lists": {"tags": [{"b": "click", "a": [{"m": 0}]}]},
        "empty lists": {"tags": [[], None, {"b": "view"}], "none": []},
        "nested lists": {"tags": [[[1]], [["error", 2], [1]]]},
    }
    rows = table(spark, sf, "events").select("event_id", metadata.alias("m"))
    held = F.when(F.lit(False), F.lit(""))
    for name, value in wanted.items():
        held = held.when(metadata_contains("m", value), name)
    either = metadata_contains("m", {"tags": ["x", 5]}) | metadata_contains("m", {"tags": [17, "x", 17]})
    other = metadata_contains("m", {"tags": [{"b": "purchase"}]}) | metadata_contains("m", {"tags": [{"b": "signup"}]})
    held = held.when(either & other, "scalars in lists")
    return rows.select("event_id", held.alias("held")).where("held IS NOT NULL")


@registered(
    with_views(
        *_DOCS,
        then=f"""SELECT source_table, count(*) AS n_documents, CAST(0 AS BIGINT) AS n_blank,
                        count(*) FILTER (WHERE strlen(content) % 3 = 0) AS n_embedded,
                        count(*) FILTER (WHERE strlen(content) % 3 <> 0) AS n_to_embed
                 FROM (SELECT source_table, source_id, min(content) AS content
                       FROM ({" UNION ALL ".join(_DOCS.values())}) GROUP BY source_table, source_id) GROUP BY source_table""",
    )
)
def load_audit_observed(spark, sf):
    """The documents of all record tables, a third of them embedded before: what is counted while
    the rest is written."""
    found = [_documents(spark, sf, name) for name in _DOCS]
    records = documents.all_documents(*found).groupBy("source_table", "source_id").agg(F.min("content").alias("content"))
    stored = write_and_reread(records, "documents")
    before = stored.where(F.octet_length("content") % 3 == 0).select("source_table", "source_id")
    return documents.append_audited(stored, before, scratch_path(spark, "to-embed"), list(_DOCS))


# ---- text, SQL, links -----------------------------------------------------------------


@registered(
    """SELECT event_id, '{' || chr(10) || '  "a": 1000,' || chr(10) || '  "z": [],' || chr(10) || '  "ab": {' || chr(10)
              || '    "k": ' || json_extract_string(props, '$.k') || ',' || chr(10) || '    "list": [' || chr(10)
              || '      1.5,' || chr(10) || '      {' || chr(10) || '        "é": null' || chr(10) || '      }' || chr(10)
              || '    ]' || chr(10) || '  }' || chr(10) || '}' AS pretty FROM events"""
)
def metadata_nested(spark, sf):
    """Objects and lists inside metadata, each depth on its own lines."""
    nested = F.concat(
        F.lit('{"ab": {"list": [1.50, {"é": null}], "k": '), F.get_json_object("props", "$.k"), F.lit('}, "z": [], "a": 1e3}')
    )
    return table(spark, sf, "events").select("event_id", pretty_json(nested).alias("pretty"))


@registered(
    with_views(
        "billing",
        then="""SELECT '{"bill_id":"' || bill_id || '","amount":"' || amount || '"}' AS row_json,
                       count(*) OVER () AS row_count, 'bill_id,amount' AS columns FROM billing""",
    )
)
def sql_envelope(spark, sf):
    """The envelope with every row of the result."""
    view(spark, sf, "billing").createOrReplaceTempView("billing")
    found = sql_tool.execute_sql(spark, "SELECT bill_id, amount FROM billing")
    return found["rows"].withColumns(
        {"row_count": F.lit(found["row_count"]).cast("bigint"), "columns": F.lit(",".join(found["columns"]))}
    )


@registered(
    """SELECT page_id, '/archive/chest_xray_60/N/' || page_id || '.png' AS source, 'scan ' || page_id AS label,
              'archive/chest_xray_60/N/' || page_id || '.png' AS path FROM pages"""
)
def linked_images(spark, sf):
    """The images that pages link to, by their path in the archive; other links name none."""
    found = links.extract_links(view(spark, sf, "rich_pages"), "html", ["page_id"])
    resolved = paths.with_archive_path(found, "source")
    return resolved.where(F.col("path").isNotNull()).select("page_id", "source", "label", "path")


# ---- events ---------------------------------------------------------------------------


_CLEARED_SQL = """WITH last AS (SELECT max(event_id) AS id FROM events WHERE event_type = 'signup' AND user_id % 5 = 0)
       SELECT user_id, arg_max(event_type, event_id) AS status,
              arg_max(value, event_id) FILTER (WHERE event_type = 'purchase') AS amount, count(*) AS n_updates
       FROM events, last WHERE (last.id IS NULL OR event_id > last.id) AND NOT (event_type = 'signup' AND user_id % 5 = 0)
       GROUP BY user_id"""


@registered(_CLEARED_SQL)
def latest_state_cleared(spark, sf):
    """Some sign-ups delete all that was known before."""
    return events.latest_state(_updates(spark, sf), "user_id", ["event_id"], ["status", "amount"], _clears())


_FILE_ROWS = 500_000


def _in_order(spark, log, order, slices=6):
    """A stream of files that hold the rows of ``log`` in slices of ``order``, one a batch. A slice has
    as many files as its rows need, all slices the same number."""
    path, stored = scratch_path(spark, "log"), write_and_reread(log, "rows")
    number = F.unix_micros(order) if dict(log.dtypes)[order] == "timestamp" else F.col(order)
    rows, bounds = stored.select(F.count(F.lit(1)), F.percentile_approx(number, [i / slices for i in range(1, slices)])).first()
    files = max(1, -(-rows // (slices * _FILE_ROWS)))
    place = sum((number > F.lit(b)).cast("int") for b in bounds)
    for i in range(slices):  # written in order, so they are read in order
        part = stored.where(place == i)
        (part.coalesce(1) if files == 1 else part.repartition(files)).write.mode("append").parquet(path)
        written = len(spark.read.schema(log.schema).parquet(path).inputFiles()) if files > 1 else i + 1
        for _ in range(files * (i + 1) - written):  # a slice of few rows gets empty files, as a batch takes a number of files
            part.limit(0).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(log.schema).option("maxFilesPerTrigger", files).parquet(path)


def _updates(spark, sf):
    return table(spark, sf, "events").select(
        "user_id",
        "event_id",
        F.col("event_type").alias("status"),
        F.when(F.col("event_type") == "purchase", F.col("value")).alias("amount"),
    )


def _clears():
    return (F.col("status") == "signup") & (F.col("user_id") % 5 == 0)


@registered(_CLEARED_SQL)
def stream_latest_state(spark, sf):
    """Updates in six batches, some of which clear all that was known."""
    target, fields = scratch_path(spark, "states"), ["status", "amount"]
    stream = _in_order(spark, _updates(spark, sf), "event_id")
    stream_state.stream_latest_state(
        stream, target, scratch_path(spark, "checkpoint"), "user_id", ["event_id"], fields, _clears(), buckets=8, compact_after=2
    ).awaitTermination()
    return stream_state.read_latest_state(spark, target, stream.schema, "user_id", ["event_id"], fields, buckets=8)


_GAP_SECONDS = 60


def _requests_log(spark, sf):
    """A request per user."""
    return table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("request_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.when(F.col("event_type") == "error", F.lit("error")).otherwise(F.lit("output")).alias("type"),
    )


_GAPS_SQL = f"""WITH r AS (SELECT user_id, min(ts) AS s, max(ts) AS seen, min(ts) FILTER (WHERE event_type = 'error') AS ended
                   FROM events GROUP BY user_id)
        SELECT CAST(user_id AS VARCHAR) AS request_id, strftime(s, '%Y-%m-%d %H:%M:%S') AS started_at,
               '{events.TIMED_OUT.format(seconds=_GAP_SECONDS)}' AS message
        FROM r WHERE s + INTERVAL {_GAP_SECONDS} SECOND < (SELECT max(ts) FROM events)
          AND (ended IS NULL OR ended > s + INTERVAL {_GAP_SECONDS} SECOND)"""


@registered(_GAPS_SQL)
def stream_deadlines_gaps(spark, sf):
    """Requests, one per user, that return long after their deadline, over and over: each is
    reported once. The log comes in order of time."""
    target = scratch_path(spark, "deadlines")
    stream = _in_order(spark, _requests_log(spark, sf), "ts")
    stream_status.stream_deadlines(
        stream, target, scratch_path(spark, "checkpoint"), seconds=_GAP_SECONDS
    ).awaitTermination()
    found = stream_status.read_deadlines(spark, target)
    return found.withColumn("started_at", F.date_format("started_at", "yyyy-MM-dd HH:mm:ss"))


@registered(_GAPS_SQL)
def stream_deadlines_state(spark, sf):
    """The same by keyed state and timers."""
    target = scratch_path(spark, "deadlines")
    stream = _in_order(spark, _requests_log(spark, sf), "ts")
    timers.stream_deadlines_state(
        stream, target, scratch_path(spark, "checkpoint"), seconds=_GAP_SECONDS
    ).awaitTermination()
    found = timers.read_deadlines(spark, target)
    return found.withColumn("started_at", F.date_format("started_at", "yyyy-MM-dd HH:mm:ss"))


@registered(_SPLIT_SQL)
def stream_answer_split(spark, sf):
    """Answers followed over micro-batches. Each output comes in pieces of three characters,
    so files and batches end anywhere inside the marker."""
    log = _events(spark, sf).select("request_id", "seq", "type", F.coalesce("text", F.lit("")).alias("text"))
    starts = F.sequence(F.lit(1), F.greatest(F.length("text"), F.lit(1)), F.lit(3))
    pieces = log.select("*", F.explode(starts).alias("at"))
    piece = F.when(F.col("type") == "output", F.substring("text", F.col("at"), F.lit(3)))
    log = pieces.select("request_id", (F.col("seq") * 1000 + F.col("at")).alias("seq"), "type", piece.alias("text"))
    target = scratch_path(spark, "answers")
    stream = _in_order(spark, log, "seq")
    stream_answers_.stream_answers(
        stream, target, scratch_path(spark, "checkpoint"), page_chars=_PAGE, buckets=8
    ).awaitTermination()
    return stream_answers_.read_answers(spark, target, stream.schema["request_id"], page_chars=_PAGE, buckets=8)
