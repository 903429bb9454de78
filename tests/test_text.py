import datetime as dt
import json
from decimal import Decimal

from pyspark.sql import functions as F

from caselens.functions import bands
from caselens.functions.json_filter import metadata_contains
from caselens.functions.links import extract_links
from caselens.functions.logs import classify_log_lines
from caselens.functions.paths import with_archive_path
from caselens.functions.text import has_content, pretty_json, rows_as_json, strip
from caselens.operators import context, documents


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column).first()[0]


def test_blank_is_what_python_strips(spark):
    texts = ["", " ", "\t\r\n", "\u00a0\u2003", "\x1c", "\u200b", " a ", None, "\u3000x\u3000"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for row in rows.select("i", has_content("t").alias("full"), strip("t").alias("s")).collect():
        text = texts[row.i]
        assert row.full == bool(text and text.strip()), repr(text)
        assert row.s == (None if text is None else text.strip()), repr(text)


PATIENT = "patient_id string, first_name string, last_name string, gender string, date_of_birth date, " \
    "registration_date date, insurance_provider string"


def test_null_prints_as_none_and_stays_in_metadata(spark):
    rows = [("P1", "Ann", None, "F", None, dt.date(2023, 1, 2), None)]
    doc = documents.patient_documents(spark.createDataFrame(rows, PATIENT)).first()
    assert doc.content == "Patient Ann None, F, born None, registered on 2023-01-02, insured with None."
    assert doc.metadata == '{"gender":"F","patient_id":"P1","insurance_provider":null}'
    assert doc.source_table == "patients" and doc.source_id == "P1"


def test_null_date_in_metadata_is_text(spark):
    schema = "appointment_id string, patient_id string, doctor_id string, appointment_date date, " \
        "reason_for_visit string, status string"
    doc = documents.appointment_documents(spark.createDataFrame([("A1", "P1", "D1", None, "Checkup", "No-show")], schema))
    assert json.loads(doc.first().metadata) == {
        "date": "None", "status": "No-show", "doctor_id": "D1", "patient_id": "P1"
    }


def test_money_keeps_two_decimals(spark):
    schema = "bill_id string, patient_id string, amount decimal(10,2), payment_method string, " \
        "payment_status string, bill_date date"
    rows = [("B1", "P1", Decimal("3941.90"), "Cash", "Paid", dt.date(2023, 8, 9))]
    doc = documents.billing_documents(spark.createDataFrame(rows, schema)).first()
    assert doc.content == "Bill of $3941.90 via Cash, status: Paid, dated 2023-08-09."


def test_treatments_without_an_appointment_have_no_document(spark):
    treatments = spark.createDataFrame(
        [("T1", "A1", "MRI", "scan", Decimal("5.5"), dt.date(2023, 1, 1)),
         ("T2", "A9", "MRI", "scan", Decimal("5.5"), dt.date(2023, 1, 1))],
        "treatment_id string, appointment_id string, treatment_type string, description string, "
        "cost decimal(10,2), treatment_date date",
    )
    visits = spark.createDataFrame([("A1", "P1", "D1")], "appointment_id string, patient_id string, doctor_id string")
    docs = documents.treatment_documents(treatments, visits).collect()
    assert [d.source_id for d in docs] == ["T1"]
    assert docs[0].content == "Treatment type: MRI. Description: scan. Cost: $5.50. Date: 2023-01-01."


def test_blank_documents_are_left_out(spark):
    docs = spark.createDataFrame(
        [("a", "1", " \n", "{}"), ("a", "2", "x", "{}"), ("a", "3", None, "{}")],
        "source_table string, source_id string, content string, metadata string",
    )
    assert [d.source_id for d in documents.all_documents(docs).collect()] == ["2"]


def test_pretty_json(spark):
    cases = {
        '{"patient_id":"P012","date":"2024-05-01","n":3,"x":null}':
            '{\n  "n": 3,\n  "x": null,\n  "date": "2024-05-01",\n  "patient_id": "P012"\n}',
        "{}": "{}",
        "not json": '"not json"',
        '{"a":"say \\"hi\\""}': '{\n  "a": "say \\"hi\\""\n}',
    }
    for text, wanted in cases.items():
        assert one(spark, pretty_json("m"), m=text) == wanted
    assert spark.range(1).select(pretty_json(F.lit(None).cast("string"))).first()[0] == "null"


def test_context_chunk_layout(spark):
    retrieved = spark.createDataFrame(
        [("q", "billing", "B1", 0.123456, 1, "two\nlines", '{"date":"2023-01-01"}'),
         ("q", "billing", "B2", float("nan"), 2, None, None)],
        "question_id string, source_table string, source_id string, distance double, rank int, "
        "content string, metadata string",
    )
    first, second = [r.chunk for r in context.context_chunks(retrieved).orderBy("rank").collect()]
    pad = " " * 16
    assert first == (
        f"SOURCE TABLE: billing\n{pad}SOURCE ID: B1\n{pad}SIMILARITY DISTANCE: 0.1235\n\n"
        f"{pad}CONTENT:\n{pad}two\nlines\n\n{pad}METADATA:\n{pad}{{\n  \"date\": \"2023-01-01\"\n}}"
    )
    assert "DISTANCE: nan" in second and f"CONTENT:\n{pad}None" in second and second.endswith("null")
    joined = context.concat_context(context.context_chunks(retrieved)).first()
    assert joined.context == first + "\n\n---\n\n" + second and joined.n_chunks == 2


def test_prompt_of_a_question_without_context(spark):
    questions = spark.createDataFrame([("q1", "How many?"), ("q2", "Who?")], "question_id string, question string")
    contexts = spark.createDataFrame([("q1", "CTX")], "question_id string, context string")
    prompts = {r.question_id: r.prompt for r in context.build_prompts(questions, contexts).collect()}
    pad = " " * 12
    assert f"{pad}SEMANTIC RETRIEVAL CONTEXT:\n\n{pad}CTX\n\n{pad}USER QUESTION:\n\n{pad}How many?\n{pad}" in prompts["q1"]
    assert f"{pad}SEMANTIC RETRIEVAL CONTEXT:\n\n{pad}\n\n" in prompts["q2"]


def test_rows_as_json(spark):
    row = spark.createDataFrame(
        [(1, Decimal("2.50"), dt.date(2023, 1, 2), None)], "n int, amount decimal(10,2), day date, note string"
    )
    text = row.select(rows_as_json(row)).first()[0]
    assert json.loads(text) == {"n": 1, "amount": "2.50", "day": "2023-01-02", "note": None}


def test_metadata_contains(spark):
    docs = ['{"k":12,"who":"P1","deep":{"a":true}}', '{"k":"12"}', '{"k":12.0}', "broken", None, '{"who":null}', "[]"]
    df = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "i int, m string")

    def hits(wanted):
        return [r.i for r in df.where(metadata_contains("m", wanted)).orderBy("i").collect()]

    assert hits({"k": 12}) == [0, 2]
    assert hits({"k": "12"}) == [1]
    assert hits({"k": 12, "who": "P1"}) == [0]
    assert hits({"who": None}) == [5]
    assert hits({"deep": {"a": True}}) == [0]
    assert hits({}) == [0, 1, 2, 5]


def holds(found, wanted, top=True):
    """Containment in plain Python."""
    if isinstance(wanted, dict):
        return isinstance(found, dict) and all(k in found and holds(found[k], v, False) for k, v in wanted.items())
    if isinstance(wanted, list):
        return isinstance(found, list) and all(any(holds(f, w, False) for f in found) for w in wanted)
    if top and isinstance(found, list):
        return any(holds(f, wanted, False) for f in found)
    if wanted is None or isinstance(wanted, (bool, str)):
        return type(found) is type(wanted) and found == wanted
    return isinstance(found, (int, float)) and not isinstance(found, bool) and found == wanted


def test_lists_in_metadata(spark):
    docs = [
        {"a": [1, 2, [3, [4, "x"]], {"b": [None, True]}], "c": []},
        {"a": [[1], [2, []]], "c": [[]]},
        {"a": [], "c": {}},
        {"a": 1, "c": [1, 1]},
        [1, "x", [2], {"a": 1}, None, True],
        [[]],
        [],
        "x",
        1,
        None,
        {"a": [{"b": [1]}, {"b": [2], "d": 1.0}]},
        {"a": [1.5, "1", False]},
    ]
    wanted = [
        {"a": []}, {"a": [2, 1, 1]}, {"a": [[]]}, {"a": [[3, [4]]]}, {"a": [[[4]]]}, {"a": [{"b": [None]}]}, {"c": [[]]}, {"c": []},
        {"a": 1}, {"a": [1]}, {"c": {}}, {"c": [1]}, {"a": [{"b": []}]}, {"a": [{"b": [2], "d": 1}]}, {"a": [{"b": [1], "d": 1}]},
        [], [[]], [1], ["x", 1], [{"a": 1}], [None, True], "x", 1, None, True, {}, {"a": ["1"]}, {"a": [False, 1.5]}, [[2]], [2],
    ]
    rows = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "i int, m string")
    marked = rows.select("i", *[metadata_contains("m", w).alias(f"w{n}") for n, w in enumerate(wanted)])
    for row in marked.collect():
        for n, w in enumerate(wanted):
            assert row[f"w{n}"] == holds(docs[row.i], w), (docs[row.i], w)


def test_paths(spark):
    prefix = "chest_xray_60/NORMAL/"
    cases = {
        f"https://h.example/x/archive/{prefix}a b.jpeg?x=1#y": f"archive/{prefix}a%20b.jpeg",
        f"/data/archive/old/archive/{prefix}a.JPG": f"archive/{prefix}a.JPG",
        f"C:\\data\\archive\\{prefix}a.png".replace("/", "\\"): f"archive/{prefix}a.png",
        f"http://localhost:8000/{prefix}%C3%A9(1)!'*~+.webp": f"archive/{prefix}%C3%A9(1)!'*~%2B.webp",
        f"{prefix}x/../a.gif": f"archive/{prefix}a.gif",
        f"{prefix}x/%2e%2E/./a.gif": f"archive/{prefix}a.gif",
        f"archive/{prefix}50%/a.bmp": f"archive/{prefix}50%25/a.bmp",
        f"archive/{prefix}%FF.png": f"archive/{prefix}%25FF.png",
        f"file:///home/u/archive/{prefix}a.svg": f"archive/{prefix}a.svg",
        f"  /archive/{prefix}a.svg\n": f"archive/{prefix}a.svg",
        f"archive/{prefix}..": None,
        f"archive/{prefix}%2F%2Fa.png": None,
        f"archive/{prefix}a.pdf": None,
        "/archive/other/a.png": None,
        "/archive/other/chest_xray_60/a.png": None,
        "": None,
        "a.png": None,
        "javascript:alert(1)": None,
    }
    df = spark.createDataFrame(list(cases.items()), "source string, wanted string")
    for row in with_archive_path(df, "source").collect():
        assert row.path == row.wanted, row.source


def test_links(spark):
    html = (
        "<a class=x href='/one?a=1&amp;b=2'>First <b>link</b></a> <abbr href=no>x</abbr>"
        '<img alt="Scan" src="/i.png"><img src=/j.png/>'
        "<code>![lung](&lt;a b.png&gt;)</code><code>[t](c.png)</code><code> plain.png </code><a href=''>empty</a>"
    )
    df = spark.createDataFrame([(1, html)], "id int, html string")
    found = {tuple(r)[1:] for r in extract_links(df, "html", ["id"]).collect()}
    assert found == {
        ("a", "/one?a=1&b=2", "First link"),
        ("img", "/i.png", "Scan"),
        ("img", "/j.png/", "Hospital X-ray"),
        ("code", "a b.png", "lung"),
        ("code", "c.png", "t"),
        ("code", "plain.png", "Hospital X-ray"),
    }


def test_log_lines(spark):
    log = (
        "Question: how many\nTrying gemini-3.5-flash...\nsql query written by gemini ->  SELECT 1\n"
        "gemini-x quota hit, falling back...\n--- Answer ---\nSQL QUERY WRITTEN BY GEMINI->\n"
    )
    df = spark.createDataFrame([(1, log)], "id int, log string")
    rows = classify_log_lines(df, "log", ["id"]).orderBy("line_no").collect()
    assert [r.kind for r in rows] == ["plain", "model", "sql", "model", "plain", "sql", "plain"]
    assert [r.sql_text for r in rows if r.kind == "sql"] == ["SELECT 1", ""]


def test_bands(spark):
    df = spark.createDataFrame(
        [(36, 40, 95, 100), (102, 120, 100, 100), (40, 40, None, 5), (1, 0, 9, 5)],
        "occupied int, capacity int, stock int, reorder int",
    )
    rate = bands.occupancy(F.col("occupied"), F.col("capacity"))
    rows = df.select(rate.alias("r"), bands.occupancy_band(rate).alias("b"),
                     bands.stock_band(F.col("stock"), F.col("reorder")).alias("s")).collect()
    assert [tuple(r) for r in rows] == [
        (90.0, "Limited", "Reorder Triggered"),
        (85.0, "Available", "Adequate Stock"),
        (100.0, "Full", None),
        (None, None, "Adequate Stock"),
    ]
