import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from caselens.operators import events as E, ordered
from caselens.sources import frames

EVENT = "request_id string, seq bigint, type string, text string, message string, malformed boolean"


def outputs(spark, texts_by_request):
    rows, seq = [], 0
    for request, texts in texts_by_request.items():
        for text in texts:
            rows.append((request, seq, "output", text, None, False))
            seq += 1
    return spark.createDataFrame(rows, EVENT)


def parts(df):
    found = {}
    for r in df.orderBy("request_id", "part", "page").collect():
        found.setdefault((r.request_id, r.part), []).append(r.text)
    return {key: "".join(texts) for key, texts in found.items()}


def expected(texts):
    whole = "".join(t or "" for t in texts)
    if E.ANSWER_MARKER not in whole:
        return whole.strip(), E.NO_MARKER
    thinking, answer = whole.split(E.ANSWER_MARKER, 1)
    return thinking.strip(), answer.strip()


@pytest.mark.parametrize("page_chars,span", [(65_536, 65_536), (16, 3), (7, 1)])
def test_answer_split(spark, page_chars, span):
    m = E.ANSWER_MARKER
    cases = {
        "plain": ["think\n", f"{m}\n", "the answer\n"],
        "no marker": ["only", " thinking "],
        "twice": ["a", m, "b", m, "c"],
        "across frames": ["x --- Ans", "w", "er ---", " --", "- A", "nswer", " ---", "y"],
        "one by one": list(f"before{m}after"),
        "empty frames": ["", None, f"  {m}  ", ""],
        "blank ends": ["\n\t " * 30, "mid  dle", " \u00a0\n" * 30, m, " " * 50, "z", " " * 50],
        "nothing": [""],
        "marker last": ["abc", m],
        "long frame": ["p" * 100 + m + "q" * 200],
        "unicode": ["\u00e9\U0001f600" * 20, m, "\U0001f600\u00e9 " * 20],
    }
    rng = random.Random(3)
    whole = "".join(rng.choice(["-", " ", "A", "nswer", "--- Answer ---", "x\n"]) for _ in range(300))
    cuts = sorted(rng.sample(range(len(whole)), 80))
    cases["random"] = [whole[a:b] for a, b in zip([0, *cuts], [*cuts, len(whole)])]
    found = parts(E.answer_split(outputs(spark, cases), page_chars=page_chars, span=span))
    for name, texts in cases.items():
        thinking, answer = expected(texts)
        assert found[(name, "thinking")] == thinking, name
        assert found[(name, "answer")] == answer, name
    assert len(found) == 2 * len(cases)


def test_pages_are_bounded(spark):
    df = outputs(spark, {"hot": ["ab"] * 500, "cold": ["c"]})
    pages = E.output_pages(df, page_chars=50, span=7).collect()
    assert max(len(p.body) for p in pages) == 50
    hot = sorted((p.page, p.body) for p in pages if p.request_id == "hot")
    assert "".join(body for _, body in hot) == "ab" * 500


def test_running_total_with_gaps(spark):
    rows = [("a", s, v) for s, v in [(5, 1), (6, 2), (900, 3), (901, 4), (5000, 5)]] + [("b", 1, 10), ("b", 2, 20)]
    df = spark.createDataFrame(rows, "k string, seq bigint, v bigint")
    found = {(r.k, r.seq): r.t for r in ordered.running_total(df, "k", "seq", "v", "t", span=100).collect()}
    assert found == {("a", 5): 0, ("a", 6): 1, ("a", 900): 3, ("a", 901): 6, ("a", 5000): 10, ("b", 1): 0, ("b", 2): 10}


@pytest.mark.parametrize("span", [1, 2, 100])
def test_pairs(spark, span):
    rows = [
        (1, 0, "system", "s"), (1, 1, "user", "q1"), (1, 2, "assistant", "a1"), (1, 5, "user", "q2"),
        (1, 9, "user", "q3"), (1, 40, "assistant", "a3"), (2, 0, "assistant", "x"), (2, 1, "user", "last"),
    ]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    found = {tuple(r) for r in E.pair_turns(df, span=span).collect()}
    assert found == {(1, 1, "q1", "a1"), (1, 9, "q3", "a3")}


def status(spark, rows):
    full = [(r, i, t, None, m, b) for i, (r, t, m, b) in enumerate(rows)]
    return {r.request_id: (r.status, r.message) for r in E.request_status(spark.createDataFrame(full, EVENT)).collect()}


def test_status(spark):
    found = status(spark, [
        ("ok", "output", None, False), ("ok", "done", None, False),
        ("cut", "output", None, False),
        ("err", "output", None, False), ("err", "error", "first", False), ("err", "error", "second", False),
        ("silent", "error", None, False), ("blank", "error", "", False),
        ("late", "done", None, False), ("late", "error", "after done", False),
        ("torn", None, None, True), ("torn", "done", None, False),
    ])
    assert found == {
        "ok": ("complete", None), "cut": ("error", E.ENDED_EARLY), "err": ("error", "first"),
        "silent": ("error", E.FAILED), "blank": ("error", E.FAILED), "late": ("error", "after done"),
        "torn": ("error", "malformed frame"),
    }


def test_status_can_be_merged(spark):
    rows = [("a", 0, "output", None, None, False), ("a", 1, "error", None, "x", False), ("b", 2, "output", None, None, False),
            ("b", 3, "done", None, None, False)]
    df = spark.createDataFrame(rows, EVENT)
    pieces = [df.where(f"seq % 2 = {i}").groupBy("request_id").agg(*E.status_columns()) for i in (0, 1)]
    merged = E.status_of(E.merge_status(pieces[0].unionByName(pieces[1])))
    assert sorted(map(repr, merged.collect())) == sorted(map(repr, E.request_status(df).collect()))


def timed(spark, rows):
    start = dt.datetime(2024, 1, 1)
    full = [(r, i, t, start + dt.timedelta(seconds=s)) for i, (r, t, s) in enumerate(rows)]
    return spark.createDataFrame(full, "request_id string, seq bigint, type string, ts timestamp")


DEADLINES = [
    ("fine", "output", 0), ("fine", "done", 120),
    ("slow", "output", 0), ("slow", "output", 121), ("slow", "done", 122),
    ("open", "output", 5), ("open", "output", 100),
    ("after", "output", 0), ("after", "done", 10), ("after", "output", 500),
]


def test_deadline(spark):
    found = {r.request_id: r for r in E.request_deadline(timed(spark, DEADLINES)).collect()}
    assert not found["fine"].timed_out and found["fine"].message is None
    assert found["slow"].timed_out and (found["slow"].n_in_time, found["slow"].n_late) == (1, 2)
    assert found["slow"].message == "RAG pipeline timed out after 120 seconds"
    assert not found["open"].timed_out  # the log ends before its deadline
    assert not found["after"].timed_out and found["after"].n_late == 1
    later = E.request_deadline(timed(spark, DEADLINES), as_of=F.lit("2024-01-01 00:10:00").cast("timestamp"))
    assert {r.request_id for r in later.where("timed_out").collect()} == {"slow", "open"}


def test_latest_state(spark):
    rows = [("m1", 1, "loading", None), ("m1", 3, "complete", "hi"), ("m1", 2, None, "partial"), ("m2", 4, "loading", None)]
    df = spark.createDataFrame(rows, "id string, seq bigint, status string, text string")
    found = {r.id: (r.status, r.text) for r in E.latest_state(df, "id", ["seq"], ["status", "text"]).collect()}
    assert found == {"m1": ("complete", "hi"), "m2": ("loading", None)}


def test_clear_deletes_what_came_before(spark):
    rows = [("m1", 1, "a"), ("all", 2, "clear"), ("m2", 3, "b")]
    df = spark.createDataFrame(rows, "id string, seq bigint, status string")
    found = E.latest_state(df, "id", ["seq"], ["status"], clears=F.col("status") == "clear").collect()
    assert [(r.id, r.status) for r in found] == [("m2", "b")]


def test_frames(spark):
    raw = [
        'data: {"type": "output", "text": "a\\nb"}',
        'event: x\r\ndata:{"type":"done"}\r\nid: 1',
        ": comment",
        "data: {broken",
        "data:",
        'xdata: {"type": "done"}',
        'data: {"type": "error", "message": "no"}\ndata: {"type": "done"}',
    ]
    df = spark.createDataFrame(list(enumerate(raw)), "i int, frame string")
    found = {r.i: (r.type, r.text, r.message, r.malformed) for r in frames.parse_frames(df).collect()}
    assert found == {
        0: ("output", "a\nb", None, False),
        1: ("done", None, None, False),
        3: (None, None, None, True),
        4: (None, None, None, True),
        6: ("error", None, "no", False),
    }


def test_bad_bytes_become_replacement_characters(spark):
    df = spark.sql("""select cast(concat(cast('data: {"type":"output","text":"a' as binary), X'FF',
                      cast('b"}' as binary)) as string) frame""")
    assert frames.parse_frames(df).first().text == "a\ufffdb"


def test_frame_files(spark, tmp_path):
    df = outputs(spark, {"r": ["one\n\ntwo", '"quoted" \u00e9']})
    path = str(tmp_path / "frames")
    frames.write_frames(df.select(frames.frame(F.struct("type", "text", "seq")).alias("frame")), path)
    back = frames.parse_frames(frames.read_frames(spark, path), extra="seq bigint").orderBy("seq").collect()
    assert [r.text for r in back] == ["one\n\ntwo", '"quoted" \u00e9']


def test_ranges_follow_rows_and_not_numbers(spark):
    """Sparse numbers: one key is cut into ranges of about as many rows, the results stay."""
    rows = [("hot", (i * i * 1_000_003) % (1 << 40), i % 7) for i in range(500)] + [(f"k{i % 20}", i << 30, 1) for i in range(60)]
    df = spark.createDataFrame(rows, "key string, seq bigint, n int")
    sizes = ordered._ranged(df, "key", "seq", 100).where("key = 'hot'").groupBy("_range").count().collect()
    assert len(sizes) > 100 and max(r["count"] for r in sizes) <= 5
    assert ordered._ranged(df, "key", "seq", 1000) is None  # no key is that long
    totals = {(r.key, r.seq, r.n): r.t for r in ordered.running_total(df, "key", "seq", "n", "t", span=100).collect()}
    following = {(r.key, r.seq): r.next_seq for r in ordered.with_next(df, "key", "seq", ["seq"], span=100).collect()}
    for key in ("hot", "k3"):
        own, total = sorted(r for r in rows if r[0] == key), 0
        for i, r in enumerate(own):
            assert totals[r] == total and following[r[:2]] == (own[i + 1][1] if i + 1 < len(own) else None)
            total += r[2]
