"""Event logs of many requests: answers, statuses, deadlines, latest states, pairs.

Input rows are (request id, ``seq``, type, text, message, malformed), where ``seq`` is
an integer that grows in the order of arrival.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from caselens.functions.text import PYTHON_SPACE_CHARS
from caselens.operators.ordered import SPAN, running_total, with_next
from caselens.operators.skew import skew_join
from caselens.scratch import write_and_reread

# The answer marker and the messages that results must carry.
ANSWER_MARKER = "--- Answer ---"
NO_MARKER = "No answer delimiter found in pipeline output."
FAILED = "The RAG pipeline failed."
ENDED_EARLY = "The streaming connection ended before the pipeline completed."
TIMED_OUT = "RAG pipeline timed out after {seconds} seconds"
DEADLINE_SECONDS = 120

PAGE_CHARS = 65_536
PAGES_PER_BLOCK = 1024


def output_pages(
    events: DataFrame, request: str = "request_id", page_chars: int = PAGE_CHARS, span: int = SPAN
) -> DataFrame:
    """The output of each request, cut into pages of ``page_chars`` characters.

    (request, page, body, ahead): ``ahead`` is the start of the next pages, as long as is
    needed to see a marker that begins in this page. A request may write any amount of
    output; no page holds more than its own characters.
    """
    margin = len(ANSWER_MARKER) - 1
    size = F.lit(page_chars)
    outputs = events.where((F.col("type") == "output") & (F.length("text") > 0)).select(
        request, "seq", "text", F.length("text").cast("bigint").alias("_n")
    )
    placed = running_total(outputs, request, "seq", "_n", "_at", span)
    first = F.greatest(F.floor((F.col("_at") - margin) / size), F.lit(0))
    last = F.floor((F.col("_at") + F.col("_n") - 1) / size)
    pieces = placed.withColumn("page", F.explode(F.sequence(first, last)))
    start = F.greatest(F.col("_at"), F.col("page") * size)
    stop = F.least(F.col("_at") + F.col("_n"), (F.col("page") + 1) * size + margin)
    piece = F.substring("text", (start - F.col("_at") + 1).cast("int"), (stop - start).cast("int"))
    whole = (
        pieces.select(request, "page", "seq", piece.alias("_piece"))
        .groupBy(request, "page")
        .agg(F.expr("listagg(_piece, '') within group (order by seq)").alias("_text"))
    )
    return whole.select(
        request,
        "page",
        F.substring("_text", 1, page_chars).alias("body"),
        F.substring("_text", page_chars + 1, margin).alias("ahead"),
    )


def _clip(body: Column, at: Column, low: Column, high: Column) -> tuple[Column, Column]:
    """The part of ``body`` (which begins at ``at``) inside [low, high), and its start."""
    start = F.greatest(at, low)
    stop = F.greatest(F.least(at + F.length(body), high), start)
    return F.substring(body, (start - at + 1).cast("int"), (stop - start).cast("int")), start


def split_pages(pages: DataFrame, places: DataFrame, request: str, page_chars: int) -> DataFrame:
    """(request, part, page, text) of pages (request, page, body), cut at known ``places``: per request
    ``marker_at`` and the first and last character of both parts that is no white space; -1
    for what there is not. A request may have any number of pages: its rows are spread."""
    at = F.col("page") * F.lit(page_chars)
    thinking, _ = _clip(F.col("body"), at, F.col("thinking_from"), F.col("thinking_to"))
    answer, _ = _clip(F.col("body"), at, F.col("answer_from"), F.col("answer_to"))
    parts = F.array(
        F.struct(F.lit("thinking").alias("part"), thinking.alias("text"), (F.col("thinking_from") >= 0).alias("there")),
        F.struct(F.lit("answer").alias("part"), answer.alias("text"), (F.col("answer_from") >= 0).alias("there")),
    )
    cut = skew_join(pages.select(request, "page", "body"), places, [request], salt_on=["page"])
    filled = cut.select(request, "page", F.explode(parts).alias("p")).where(F.col("p.there") & (F.length("p.text") > 0))
    # parts without any text: one empty row, or the message where there is no marker
    message = F.when(F.col("marker_at") < 0, F.lit(NO_MARKER)).otherwise("")
    empty = F.array(
        F.when(F.col("thinking_from") < 0, F.struct(F.lit("thinking").alias("part"), F.lit("").alias("text"))),
        F.when(F.col("answer_from") < 0, F.struct(F.lit("answer").alias("part"), message.alias("text"))),
    )
    unfilled = places.select(request, F.explode(F.filter(empty, lambda p: p.isNotNull())).alias("p"))
    return filled.select(request, "p.part", "page", "p.text").unionByName(
        unfilled.select(request, "p.part", F.lit(0).cast("bigint").alias("page"), "p.text")
    )


def answer_split(
    events: DataFrame, request: str = "request_id", page_chars: int = PAGE_CHARS, span: int = SPAN
) -> DataFrame:
    """(request, part, page, text): output before the first marker is ``thinking``, output
    after it is ``answer``, both stripped. Without a marker all output is thinking and the
    answer is a fixed message.

    A part that fits one page is one row; a longer one continues on its next pages, whose
    texts follow one another without a gap.
    """
    # the log is read once; what follows reads its outputs, and the pages made of them, as stored
    output = F.when(F.col("type") == "output", F.col("text")).alias("text")
    events = write_and_reread(events.select(request, "seq", "type", output), "outputs")
    pages = write_and_reread(output_pages(events, request, page_chars, span), "pages")
    pages = pages.withColumn("_at", F.col("page") * F.lit(page_chars))
    seen = F.locate(ANSWER_MARKER, F.concat("body", "ahead"))
    requests = pages.groupBy(request).agg(
        F.min(F.when(seen > 0, F.col("_at") + seen - 1)).alias("_marker"),
        F.max(F.col("_at") + F.length("body")).alias("_total"),
        F.max("page").alias("_last"),
    )
    everyone = events.select(request).distinct()

    # One row per request and block of pages, so no join key has more pages than a block.
    blocks = F.sequence(F.lit(0).cast("bigint"), F.floor(F.col("_last") / PAGES_PER_BLOCK))
    spread = requests.select("*", F.explode(blocks).alias("_block"))
    pages = pages.withColumn("_block", F.floor(F.col("page") / PAGES_PER_BLOCK))
    split_at = F.coalesce("_marker", "_total")
    after = F.coalesce(F.col("_marker") + len(ANSWER_MARKER), F.col("_total"))
    thinking, thinking_at = _clip(F.col("body"), F.col("_at"), F.lit(0).cast("bigint"), split_at)
    answer, answer_at = _clip(F.col("body"), F.col("_at"), after, F.col("_total"))
    parts = F.array(
        F.struct(F.lit("thinking").alias("part"), thinking.alias("text"), thinking_at.alias("at")),
        F.struct(F.lit("answer").alias("part"), answer.alias("text"), answer_at.alias("at")),
    )
    pieces = (
        pages.join(spread.drop("_last"), [request, "_block"])
        .select(request, "page", "_block", F.explode(parts).alias("p"))
        .select(request, "page", "_block", "p.*")
        .where(F.length("text") > 0)
    )
    space = F.lit(PYTHON_SPACE_CHARS)
    lead = F.length("text") - F.length(F.ltrim("text", space))
    trail = F.length("text") - F.length(F.rtrim("text", space))
    inked = F.length("text") > lead
    edges = pieces.groupBy(request, "part").agg(
        F.min(F.when(inked, F.col("at") + lead)).alias("_from"),
        F.max(F.when(inked, F.col("at") + F.length("text") - trail)).alias("_to"),
        F.min("_block").alias("_b0"),
        F.max("_block").alias("_b1"),
    )
    edges = edges.where(F.col("_from").isNotNull()).select(
        request, "part", "_from", "_to", F.explode(F.sequence("_b0", "_b1")).alias("_block")
    )
    stripped, _ = _clip(F.col("text"), F.col("at"), F.col("_from"), F.col("_to"))
    filled = (
        pieces.join(edges, [request, "part", "_block"])
        .select(request, "part", "page", stripped.alias("text"))
        .where(F.length("text") > 0)
    )
    # parts without any text: one empty row, or the message where there is no marker
    slots = everyone.join(requests.select(request, "_marker"), request, "left").select(
        request,
        F.explode(
            F.array(
                F.struct(F.lit("thinking").alias("part"), F.lit("").alias("empty")),
                F.struct(
                    F.lit("answer").alias("part"),
                    F.when(F.col("_marker").isNull(), F.lit(NO_MARKER)).otherwise("").alias("empty"),
                ),
            )
        ).alias("s"),
    ).select(request, "s.*")
    unfilled = slots.join(edges.select(request, "part").distinct(), [request, "part"], "left_anti")
    return filled.unionByName(
        unfilled.select(request, "part", F.lit(0).cast("bigint").alias("page"), F.col("empty").alias("text"))
    )


def status_columns(seq: str = "seq") -> list[Column]:
    """Aggregates that decide how a request ended; they can be merged by :func:`merge_status`."""
    bad = (F.col("type") == "error") | F.col("malformed")
    reason = F.when(F.col("malformed"), F.lit("malformed frame")).otherwise(
        F.coalesce(F.nullif(F.col("message"), F.lit("")), F.lit(FAILED))
    )
    first_error = F.when(F.coalesce(bad, F.lit(False)), F.struct(F.col(seq).alias("seq"), reason.alias("message")))
    return [
        F.min(first_error).alias("first_error"),
        F.coalesce(F.max(F.col("type") == "done"), F.lit(False)).alias("done"),
        F.count(F.lit(1)).alias("n_events"),
    ]


def status_of(summary: DataFrame, request: str = "request_id") -> DataFrame:
    failed = F.col("first_error").isNotNull()
    return summary.select(
        request,
        F.when(failed, "error").when(F.col("done"), "complete").otherwise("error").alias("status"),
        F.when(failed, F.col("first_error.message"))
        .when(~F.col("done"), F.lit(ENDED_EARLY))
        .alias("message"),
        "n_events",
    )


def merge_status(summaries: DataFrame, request: str = "request_id") -> DataFrame:
    return summaries.groupBy(request).agg(
        F.min("first_error").alias("first_error"),
        F.max("done").alias("done"),
        F.sum("n_events").alias("n_events"),
    )


def request_status(events: DataFrame, request: str = "request_id") -> DataFrame:
    """(request, status, message, n_events). Any error, or a frame that is not JSON,
    fails the request with the first such message; a request without ``done`` ended early."""
    return status_of(events.groupBy(request).agg(*status_columns()), request)


def request_deadline(
    events: DataFrame,
    request: str = "request_id",
    seconds: int = DEADLINE_SECONDS,
    as_of: Column | None = None,
) -> DataFrame:
    """(request, started_at, deadline_at, n_in_time, n_late, timed_out, message).

    A request times out if it has not ended (done or error) by its deadline although the
    log, or ``as_of``, goes on beyond it. Needs a timestamp column ``ts``.
    """
    ends = F.coalesce(F.max(F.col("type").isin("done", "error")), F.lit(False)).alias("_ends")
    # the log is read once: what is compared are its times per request
    times = write_and_reread(events.groupBy(request, "ts").agg(F.count(F.lit(1)).alias("_n"), ends), "times")
    starts = times.groupBy(request).agg(
        F.min("ts").alias("started_at"), F.max("ts").alias("_seen"), F.min(F.when(F.col("_ends"), F.col("ts"))).alias("_ended")
    )
    starts = starts.withColumn("deadline_at", F.col("started_at") + F.expr(f"interval {int(seconds)} seconds"))
    timed = skew_join(times.select(request, "ts", "_n"), starts, [request], salt_on=["ts"])
    now = F.col("_seen") if as_of is None else F.greatest(F.col("_seen"), as_of)
    open_at_deadline = F.col("_ended").isNull() | (F.col("_ended") > F.col("deadline_at"))
    timed_out = open_at_deadline & (now > F.col("deadline_at"))

    def rows(when: Column) -> Column:
        return F.coalesce(F.sum(F.when(when, F.col("_n"))), F.lit(0).cast("bigint"))

    per_request = timed.groupBy(request, "started_at", "deadline_at", "_seen", "_ended").agg(
        rows(F.col("ts") <= F.col("deadline_at")).alias("n_in_time"),
        rows(F.col("ts") > F.col("deadline_at")).alias("n_late"),
    )
    return per_request.select(
        request,
        "started_at",
        "deadline_at",
        "n_in_time",
        "n_late",
        timed_out.alias("timed_out"),
        F.when(timed_out, F.lit(TIMED_OUT.format(seconds=seconds))).alias("message"),
    )


def latest_state(
    updates: DataFrame,
    key: str,
    order: list[str],
    fields: list[str],
    clears: Column | None = None,
) -> DataFrame:
    """Per key, each field's last non-NULL value. Rows for which ``clears`` is true delete
    everything before them."""
    at = F.struct(*order)
    if clears is not None:
        last_clear = updates.where(clears).agg(F.max(at).alias("at")).scalar()
        updates = updates.where(F.coalesce(at > last_clear, F.lit(True)) & ~F.coalesce(clears, F.lit(False)))
    return updates.groupBy(key).agg(
        *[F.max_by(f, F.when(F.col(f).isNotNull(), at)).alias(f) for f in fields],
        F.count(F.lit(1)).alias("n_updates"),
    )


def pair_turns(
    turns: DataFrame, conversation: str = "conv_id", seq: str = "turn", span: int = SPAN
) -> DataFrame:
    """(conversation, turn, question, answer): each user message whose next message is the
    assistant's."""
    following = with_next(turns.select(conversation, seq, "role", "text"), conversation, seq, ["role", "text"], span)
    return following.where((F.col("role") == "user") & (F.col("next_role") == "assistant")).select(
        conversation, seq, F.col("text").alias("question"), F.col("next_text").alias("answer")
    )
