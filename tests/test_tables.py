from decimal import Decimal

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F, types as T

from caselens.operators import analytics as A, documents, quality as Q
from caselens.operators.embed import TokenHashEmbedder
from caselens.plans import ingest as plan
from caselens.plans.registered_text import describe_by_size
from caselens.schemas import RECORD_TABLES
from caselens.sources import csv_tables, images, jdbc, vector_store

FILES = {
    "doctors": """doctor_id,first_name,last_name,specialization,phone_number,years_experience,hospital_branch,email,extra
D1,Ada,Gray,Oncology,0501,12,Central Hospital,a@x.org,1
D2,"Lee, Jr",Ng,Pediatrics,0502,3,Eastside Clinic,b@x.org,2
""",
    "patients": """patient_id,first_name,last_name,gender,date_of_birth,contact_number,address,registration_date,insurance_provider,insurance_number,email
P1,Ann,Li,F,1990-01-02,0123,1 Elm,2022-05-06,CareA,I1,p1@x.org
P2,Bob,,M,1985-11-30,0456,2 Oak,2022-05-07,CareB,I2,p2@x.org
P3,Cy,Fox,M,1985-13-30,0456,2 Oak,2022-05-07,CareB,I2,p2@x.org
""",
    "appointments": """appointment_id,patient_id,doctor_id,appointment_date,appointment_time,reason_for_visit,status
A1,P1,D1,2023-08-09,8:00:00,Therapy,Cancelled
A2,P1,D2,2023-08-10,15:15:00,Checkup,Completed
A3,P9,D2,2023-08-11,09:30:00,Checkup,Completed
""",
    "treatments": """treatment_id,appointment_id,treatment_type,description,cost,treatment_date
T1,A1,X-Ray,Basic screening,3941.90,2023-08-09
T2,A2,MRI,Advanced protocol,120,2023-08-10
T3,A2,MRI,Advanced protocol,12345678901.00,2023-08-10
""",
    "billing": """bill_id,patient_id,treatment_id,bill_date,amount,payment_method,payment_status
B1,P1,T1,2023-08-09,3941.90,Cash,Paid
B2,P1,T2,2023-08-10,120.00,Insurance,Pending
B3,P1
""",
    "xray": """xray_id,appointment_id,treatment_id,image_path,image_label
X1,A1,T1,chest_xray_60/NORMAL/one two.jpeg,NORMAL
X2,A1,T1,chest_xray_60/PNEUMONIA/gone.jpeg,PNEUMONIA
""",
}


@pytest.fixture(scope="module")
def csv_dir(tmp_path_factory):
    folder = tmp_path_factory.mktemp("archive")
    for name, text in FILES.items():
        (folder / f"{name}.csv").write_text(text)
    (folder / "chest_xray_60" / "NORMAL").mkdir(parents=True)
    (folder / "chest_xray_60" / "NORMAL" / "one two.jpeg").write_bytes(b"12345")
    return str(folder)


def test_typed_csv(spark, csv_dir):
    rows, rejects = csv_tables.read_record_table(spark, f"{csv_dir}/doctors.csv", "doctors")
    assert rows.schema == RECORD_TABLES["doctors"].schema and rejects.count() == 0
    first = {r.doctor_id: r for r in rows.collect()}
    assert first["D1"].phone_number == "0501" and first["D1"].years_experience == 12
    assert first["D2"].first_name == "Lee, Jr"


def test_times_and_money(spark, csv_dir):
    rows, _ = csv_tables.read_record_table(spark, f"{csv_dir}/appointments.csv", "appointments")
    assert {r.appointment_id: r.appointment_time for r in rows.collect()} == {
        "A1": "08:00:00", "A2": "15:15:00", "A3": "09:30:00"
    }
    rows, rejects = csv_tables.read_record_table(spark, f"{csv_dir}/treatments.csv", "treatments")
    assert {r.treatment_id: r.cost for r in rows.collect()} == {"T1": Decimal("3941.90"), "T2": Decimal("120.00")}
    assert [(r.reason, "12345678901" in r.record) for r in rejects.collect()] == [("cost", True)]


def test_rejects(spark, csv_dir):
    rows, rejects = csv_tables.read_record_table(spark, f"{csv_dir}/patients.csv", "patients")
    assert {r.patient_id: r.last_name for r in rows.collect()} == {"P1": "Li", "P2": None}
    assert [r.reason for r in rejects.collect()] == ["date_of_birth"]
    rows, rejects = csv_tables.read_record_table(spark, f"{csv_dir}/billing.csv", "billing")
    assert rows.count() == 2
    assert [tuple(r) for r in rejects.collect()] == [("B3,P1", "wrong number of cells")]


def test_renamed_and_missing_columns(spark, csv_dir):
    schema = RECORD_TABLES["doctors"].schema["doctor_id"], RECORD_TABLES["doctors"].schema["email"]
    rows, _ = csv_tables.read_csv(spark, f"{csv_dir}/doctors.csv", T.StructType(list(schema)), {"doctor_id": "email", "email": "doctor_id"})
    assert rows.first().doctor_id == "a@x.org"
    with pytest.raises(ValueError, match="no column"):
        csv_tables.read_record_table(spark, f"{csv_dir}/doctors.csv", "xray")


def test_ingest_and_ask(spark, csv_dir, tmp_path):
    target, embedder = str(tmp_path / "store"), TokenHashEmbedder(32)
    for _ in range(2):  # the second run adds nothing
        store, violations = plan.ingest(spark, csv_dir, target, embedder, describe_by_size, attempts=1)
        docs = {(r.source_table, r.source_id): r for r in store.collect()}
        # P3, T3, B3 were rejected; X2 has no image; A3 has no patient row but is a document
        assert sorted(docs) == [
            ("appointments", "A1"), ("appointments", "A2"), ("appointments", "A3"), ("billing", "B1"),
            ("billing", "B2"), ("doctors", "D1"), ("doctors", "D2"), ("patients", "P1"), ("patients", "P2"),
            ("treatments", "T1"), ("treatments", "T2"), ("xray", "X1"),
        ]
        assert store.count() == 12
    assert docs[("patients", "P2")].content == (
        "Patient Bob None, M, born 1985-11-30, registered on 2022-05-07, insured with CareB."
    )
    assert docs[("xray", "X1")].content == "Image chest_xray_60/NORMAL/one two.jpeg, 5 bytes."
    bad = {(r.table_name, r.column_name): (r.n_values, r.n_rows) for r in violations.where("n_rows > 0").collect()}
    assert bad == {("appointments", "patient_id"): (1, 1)}
    assert vector_store.read_vectors(spark, f"{target}/embeddings", "billing").count() == 2

    questions = spark.createDataFrame(
        [("q1", "Bill of $120.00 via Insurance, status: Pending, dated 2023-08-10.")], "question_id string, question string"
    )
    top = plan.retrieve(questions, store, embedder, width=32, k=3).orderBy("rank").collect()
    assert top[0].source_id == "B2" and abs(top[0].distance) < 1e-6 and len(top) == 3
    only = plan.retrieve(questions, store.where("source_table = 'doctors'"), embedder, width=32, k=3)
    assert {r.source_table for r in only.collect()} == {"doctors"}
    models = [("m", lambda prompt: "B2" if "SOURCE ID: B2" in prompt else "?")]
    answer = plan.answer(questions, store, embedder, models, width=32, k=3).first()
    assert (answer.answer, answer.model_used, answer.error) == ("B2", "m", None)

    def silent(texts):
        raise RuntimeError("no model")

    lost = plan.answer(questions, store, silent, models, width=32, attempts=1).collect()
    assert [(r.question_id, r.answer, r.error) for r in lost] == [("q1", None, "no model")]


def test_only_the_folder_of_a_source_is_read(spark, tmp_path):
    rows = [("a", "1", "x", [1.0]), ("b", "1", "y", [2.0])]
    df = spark.createDataFrame(rows, "source_table string, source_id string, content string, embedding array<float>")
    df = df.withColumns({"embedding_id": F.lit("i"), "metadata": F.lit("{}"), "created_at": F.current_timestamp()})
    vector_store.append_vectors(df, str(tmp_path / "v"))
    kept = vector_store.read_vectors(spark, str(tmp_path / "v"), "a")
    assert kept.count() == 1
    plan_text = kept._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(source_table" in plan_text


def test_counts_in_flight_equal_the_audit(spark, tmp_path):
    schema = "source_table string, source_id string, content string, metadata string"
    rows = [("a", str(i), None if i % 5 == 0 else " " if i % 7 == 0 else f"text {i}", "{}") for i in range(200)]
    rows += [("b", "1", "x", "{}"), ("b", None, "no key", "{}"), ("d", "1", "not counted", "{}")]
    docs = spark.createDataFrame(rows, schema).repartition(4)
    have = docs.where("source_table = 'a' AND cast(source_id AS int) % 3 = 0").select("source_table", "source_id")
    have = have.union(have)
    found = documents.append_audited(docs, have, str(tmp_path / "new"), ["a", "b", "c"])
    audit = documents.load_audit(docs, have).where("source_table <> 'd'")
    assert sorted(map(tuple, found.where("n_documents > 0").collect())) == sorted(map(tuple, audit.collect()))
    assert [tuple(r)[1:] for r in found.where("source_table = 'c'").collect()] == [(0, 0, 0, 0)]
    written = spark.read.parquet(str(tmp_path / "new"))
    assert written.count() == audit.agg(F.sum("n_to_embed")).first()[0] + 1 and written.columns == docs.columns


def test_images(spark, csv_dir):
    rows, _ = csv_tables.read_record_table(spark, f"{csv_dir}/xray.csv", "xray")
    files = images.read_images(spark, csv_dir)
    assert [r.xray_id for r in images.missing_images(rows, files).collect()] == ["X2"]
    (path,) = [r.image_path for r in rows.collect() if r.xray_id == "X1"]
    for limit in (None, 0):  # sent to the scan, or opened after the listing was joined
        with pytest.MonkeyPatch.context() as patched:
            if limit is not None:
                patched.setattr(images, "fits_broadcast", lambda keys: False)
            plans = []

            def describe(df):
                plans.append(df._jdf.queryExecution().executedPlan().toString())
                return df.withColumn("description", F.decode("content", "utf-8"))

            found = images.described_files(files, rows, describe)
            assert {r.image_path: r.description for r in found.collect()} == {path: "12345"}
        # no exchange carries the bytes
        assert all("content" not in line for line in plans[0].splitlines() if "Exchange" in line)


def test_many_files_are_opened_by_all_tasks(spark, tmp_path, monkeypatch):
    """Paths are few bytes, so adaptive execution would have one task open all files."""
    for i in range(300):
        (tmp_path / f"{i}.png").write_text(f"<{i}>")
    rows = spark.createDataFrame([(f"{i}.png",) for i in range(0, 300, 2)], "image_path string")
    monkeypatch.setattr(images, "fits_broadcast", lambda keys: False)
    sizes = []

    def describe(df):
        sizes.append(df.rdd.glom().map(len).collect())
        return df.withColumn("description", F.decode("content", "utf-8"))

    found = images.described_files(images.read_images(spark, str(tmp_path)), rows, describe)
    assert {r.image_path: r.description for r in found.collect()} == {f"{i}.png": f"<{i}>" for i in range(0, 300, 2)}
    assert len(sizes[0]) == images.TASKS_PER_CORE * spark.sparkContext.defaultParallelism and max(sizes[0]) < 75


def test_the_list_of_images_is_that_of_sparks_reader(spark, tmp_path):
    top = tmp_path / "a b"
    names = ["x.png", "A.PNG", "50%.png", "p+q.gif", "ü.svg", "{b}.bmp", "t.txt", ".h.png", "_h.png", "_a=1.png", "_metadata.png"]
    for name in [*names, "d/e/f.jpg", "d/.c/f.png", "_x/f.png", "_x=1/f.png", "_metadata/f.png", "k.png._COPYING_", "dir.png/i.webp"]:
        (top / name).parent.mkdir(parents=True, exist_ok=True)
        (top / name).write_text(f"<{name}>")
    (top / "empty.png").touch()
    (top / "gone.png").symlink_to(tmp_path / "nowhere")
    (top / "link.png").symlink_to(top / "x.png")
    (top / "linked").symlink_to(top / "d")
    for folder in (str(top), f"file://{top}/"):
        for glob in (images.IMAGE_GLOB, "*", "[xl]*.{png,txt}", "?.png"):
            reader = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True)
            wanted = reader.load(folder).withColumn("relative_path", images.relative_path(F.col("path"), folder))
            found = images.read_images(spark, folder, glob)
            assert found.dtypes == wanted.dtypes
            assert sorted(map(str, found.collect())) == sorted(map(str, wanted.collect()))
    with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
        images.read_images(spark, str(top / "none"))


def test_the_driver_holds_no_list_of_images(spark, tmp_path, monkeypatch):
    """Neither the files nor a task for every few of them."""
    monkeypatch.setattr(images, "LISTED_ROWS", 7, raising=False)
    for i in range(100):
        (tmp_path / f"{i % 3}").mkdir(exist_ok=True)
        (tmp_path / f"{i % 3}/{i}.png").write_text(f"<{i}>")
    files = images.read_images(spark, str(tmp_path))
    assert len(files.inputFiles()) < 100 and not any(f.endswith(".png") for f in files.inputFiles())
    assert "_content" not in files.drop("content")._jdf.queryExecution().executedPlan().toString()  # no file is opened
    rows = spark.createDataFrame([(f"{i % 3}/{i}.png",) for i in range(0, 100, 2)], "image_path string")
    tasks = []

    def describe(df):
        tasks.append(df.rdd.getNumPartitions())
        return df.withColumn("description", F.decode("content", "utf-8"))

    before = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", "1g")  # a file a task, by Spark's reader
    try:
        found = images.described_files(files, rows, describe)
        assert {r.image_path: r.description for r in found.collect()} == {f"{i % 3}/{i}.png": f"<{i}>" for i in range(0, 100, 2)}
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", before)
    assert tasks == [images.TASKS_PER_CORE * spark.sparkContext.defaultParallelism]


def test_files_are_handed_on_in_bounded_batches(tmp_path, monkeypatch):
    import pyarrow as pa

    for i in range(10):
        (tmp_path / f"{i}.png").write_text("x" * i)
    names = pa.RecordBatch.from_pydict({"n": [f"{i}" for i in range(10)], "p": [str(tmp_path / f"{i}.png") for i in range(10)]})
    monkeypatch.setattr(images, "OPENED_ROWS", 3)
    monkeypatch.setattr(images, "OPENED_BYTES", 9)
    batches = list(images._opened(iter([names])))
    assert [len(c) for b in batches for c in b.column(1).to_pylist()] == list(range(10))
    assert max(b.num_rows for b in batches) == 3


def test_jdbc_options():
    options = jdbc.jdbc_options("patients", {"DB_HOST": "db", "DB_PASSWORD": "s"}, split_on="n", bounds=(0, 9), partitions=3)
    assert options["url"].startswith("jdbc:postgresql://db:5432/") and options["password"] == "s"
    assert options["numPartitions"] == "3" and options["user"] == "postgres"


def test_primary_key(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", None), ("c", 2)], "k string, n int")
    assert [tuple(r) for r in Q.primary_key_violations(df, ["k"]).collect()] == [("a", 2)]
    assert {tuple(r) for r in Q.primary_key_violations(df, ["k", "n"]).collect()} == {("a", 1, 2), ("b", None, 1)}


def test_foreign_key(spark):
    child = spark.createDataFrame([("x",), ("x",), ("y",), (None,)], "fk string")
    parent = spark.createDataFrame([("y",), (None,)], "pk string")
    assert [tuple(r) for r in Q.foreign_key_violations(child, "fk", parent, "pk").collect()] == [("x", 2)]


def test_nulls_types_widths(spark):
    df = spark.createDataFrame([(1, "5.25", None), (2, "x", "2024-02-30"), (3, None, "2024-02-29")], "i int, n string, d string")
    assert {(r.column_name, r.n_nulls) for r in Q.null_counts(df, "t").collect()} == {("i", 0), ("n", 1), ("d", 1)}
    bad = Q.type_rejects(df, "i", {"n": "decimal(10,2)", "d": "date"}).collect()
    assert {(r.i, r.column_name, r.bad_value) for r in bad} == {(2, "n", "x"), (2, "d", "2024-02-30")}
    vectors = spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0]), (3, None)], "i int, v array<float>")
    assert [tuple(r) for r in Q.width_rejects(vectors, "i", "v", 1).collect()] == [(2, 2)]


def test_analytics(spark):
    rows = [("D1", "Cancelled", 5), ("D1", "Done", 9), ("D2", "Cancelled", 9), ("D2", "Done", None), ("D3", None, 5)]
    df = spark.createDataFrame(rows, "doctor string, status string, cost int").withColumn("id", F.monotonically_increasing_id())
    assert A.count_all(df).first().n == 5
    assert A.count_where(df, F.col("status") == "Cancelled").first().n == 2
    assert {(r.doctor, r.n) for r in A.argmax_groups(df, ["doctor"]).collect()} == {("D1", 2), ("D2", 2)}  # ties stay
    assert {r.doctor for r in A.having_more_than(df, ["doctor"], 1).collect()} == {"D1", "D2"}
    assert A.lookup(df, "status", "cardiology").count() == 0
    assert A.lookup(df, "status", "DONE").count() == 2
    found = A.extremes(df, "cost", ["doctor", "status"]).first()
    assert (found.lowest, found.lowest_doctor, found.highest, found.highest_doctor) == (5, "D1", 9, "D1")
    assert [r.cost for r in A.sort_records(df, "cost", ["doctor", "id"]).collect()] == [9, 9, 5, 5, None]
    counts = A.conditional_counts(df, ["doctor"], {"done": F.col("status") == "Done"}).collect()
    assert {(r.doctor, r.n, r.done) for r in counts} == {("D1", 2, 1), ("D2", 2, 1), ("D3", 1, 0)}


def test_each_file_is_read_by_its_own_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b,c\n1,x,p\n2,y\n")
    (tmp_path / "b b%.csv").write_text("b,c,a\nz,q,3\n")
    (tmp_path / "c.csv").write_text("a,b,c\n")
    schema = T.StructType().add("a", "integer").add("b", "string")
    rows, rejects = csv_tables.read_csv(spark, str(tmp_path), schema)
    assert sorted(map(tuple, rows.collect())) == [(1, "x"), (3, "z")]
    assert [tuple(r) for r in rejects.collect()] == [("2,y", "wrong number of cells")]
    (tmp_path / "d.csv").write_text("a,x\n1,2\n")
    with pytest.raises(ValueError, match="no column"):
        csv_tables.read_csv(spark, str(tmp_path), schema)


def test_lines_are_rows_or_rejects_whatever_is_wanted(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b,c\n1,2,3\n1,2\n1,2,3,4\nx,2,3\n")
    for names in (["a", "b", "c"], ["a", "b"], ["a"]):
        schema = T.StructType([T.StructField(n, T.IntegerType()) for n in names])
        rows, rejects = csv_tables.read_csv(spark, str(tmp_path), schema)
        assert (rows.count(), rejects.count(), len(rejects.collect())) == (1, 3, 3)
        assert sorted(r.reason for r in rejects.collect()) == ["a", "wrong number of cells", "wrong number of cells"]


def test_models_are_called_once_per_new_item(spark, tmp_path):
    folder, calls = tmp_path / "archive", tmp_path / "calls"
    folder.mkdir()
    calls.mkdir()
    for name, text in FILES.items():
        (folder / f"{name}.csv").write_text(text if name != "xray" else text.split("\n")[0] + "\n")
    with (folder / "xray.csv").open("a") as out:
        for i in range(8):
            (folder / f"{i}.png").write_bytes(b"x" * (i + 1))
            out.write(f"X{i},A1,T1,{i}.png,NORMAL\n")

    def count(kind):
        return sum(len(p.read_text()) for p in calls.glob(f"{kind}*"))

    def note(kind, what):
        with (calls / f"{kind}-{what}").open("a") as out:
            out.write(".")

    def describer(path, data):
        note("image", path.replace("/", "_"))
        return f"{path} {len(data)}"

    def model(prompt):
        note("answer", str(abs(hash(prompt))))
        return "yes"

    for wanted in (8, 8):  # none in the second run
        store, _ = plan.ingest(spark, str(folder), str(tmp_path / "store"), TokenHashEmbedder(8), describer, attempts=1)
        assert store.where("source_table = 'xray'").count() == 8 and count("image") == wanted
    questions = spark.createDataFrame([("q1", "cost of MRI"), ("q2", "Dr. Lee")], "question_id string, question string")
    answers = plan.answer(questions, store, TokenHashEmbedder(8), [("m", model)], width=8)
    assert answers.count() == 2 and answers.where("answer = 'yes'").count() == 2 and len(answers.collect()) == 2
    assert count("answer") == 2
