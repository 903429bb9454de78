import time

import pytest
from pyspark.sql import functions as F

from caselens.operators import embed
from caselens.operators.embed import ModelError, TokenHashEmbedder, answer_with_fallback, with_retries
from caselens.sources import vector_store

DOC = "source_table string, source_id string, content string, metadata string"


def test_retry_waits_longer_each_time():
    waits, calls = [], []

    def flaky(x):
        calls.append(x)
        if len(calls) < 4:
            raise RuntimeError("busy")
        return x

    assert with_retries(flaky, sleep=waits.append)("a") == "a"
    assert waits == [2, 4, 8]


def test_retry_gives_up():
    waits = []

    def broken():
        raise RuntimeError("busy")

    with pytest.raises(RuntimeError):
        with_retries(broken, sleep=waits.append)()
    assert waits == [2, 4, 8, 16, 32]


def test_missing_file_is_not_retried():
    def missing():
        raise FileNotFoundError("x")

    with pytest.raises(FileNotFoundError):
        with_retries(missing, sleep=lambda _: pytest.fail("waited"))()


def raising(error):
    def model(prompt):
        raise error

    return model


def test_fallback_rules():
    ok = ("ok", lambda p: "yes")
    quota = ("quota", raising(ModelError("used up", 429)))
    refused = ("refused", raising(ModelError("bad request", 400)))
    broken = ("broken", raising(RuntimeError("network")))
    assert answer_with_fallback("p", [quota, broken, ok]) == ("yes", "ok", None)
    assert answer_with_fallback("p", [quota, refused, ok]) == (None, "refused", "bad request")
    assert answer_with_fallback("p", [quota, broken]) == (None, "broken", "network")
    assert answer_with_fallback("p", [broken, quota]) == (None, None, None)
    assert answer_with_fallback("p", [quota, quota]) == (None, None, None)


def test_batches_keep_order_and_size(spark, tmp_path):
    class Counting:
        def __call__(self, texts):
            assert len(texts) <= 20
            return [[float(len(t)), float(len(texts))] for t in texts]

    df = spark.range(45).select(F.expr("repeat('x', cast(id as int))").alias("t")).coalesce(1)
    rows = embed.embed_texts(df, "t", Counting()).collect()
    assert [r.embedding[0] for r in rows] == [float(i) for i in range(45)]
    assert sorted({r.embedding[1] for r in rows}) == [5.0, 20.0]
    assert all(r.embed_error is None for r in rows)


def test_failed_batch_is_reported_per_row(spark):
    def broken(texts):
        if "bad" in texts:
            raise RuntimeError("no model")
        return [[1.0]] * len(texts)

    df = spark.createDataFrame([("bad",), ("x",), ("y",)], "t string").coalesce(1)
    rows = embed.embed_texts(df, "t", broken, batch_size=2, attempts=2, delay=0.0).collect()
    assert [r.embed_error for r in rows] == ["no model", "no model", None]
    assert rows[0].embedding is None and rows[2].embedding == [1.0]


def test_only_new_documents_are_embedded(spark):
    docs = spark.createDataFrame(
        [("a", "1", "one", "{}"), ("a", "2", " ", "{}"), ("b", "1", "two", "{}"), ("b", "1", "two", "{}")], DOC
    )
    existing = spark.createDataFrame([("a", "1")], "source_table string, source_id string")
    rows = embed.embed_documents(docs, TokenHashEmbedder(4), existing).collect()
    assert [(r.source_table, r.source_id) for r in rows] == [("b", "1")]
    again = embed.embed_documents(docs, TokenHashEmbedder(4)).select("embedding_id").collect()
    assert rows[0].embedding_id in {r.embedding_id for r in again} and len(again) == 2


@pytest.mark.parametrize("have", [None, [("a", "3"), ("b", "none")]])
def test_documents_are_embedded_in_parts(spark, tmp_path, monkeypatch, have):
    """The rows are those of one pass, keys that repeat or are missing too, and shuffle files of a part
    are gone when it is stored."""
    rows = [("a", str(i), f"text {i}", "{}") for i in range(60)] + [("a", str(i), f"older {i}", "{}") for i in range(0, 60, 7)]
    rows += [("b", None, "no key", "{}"), ("b", "1", " ", "{}"), (None, "2", "no table", "{}")]
    docs = spark.createDataFrame(rows, DOC).repartition(3)
    existing = None if have is None else spark.createDataFrame(have, "source_table string, source_id string")
    columns = ["embedding_id", "source_table", "source_id", "content", "embedding", "metadata"]
    wanted = embed.embed_documents(docs, TokenHashEmbedder(4), existing).select(columns).collect()
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        files = disk.getAllFiles()
        return {name for i in range(files.size()) if (name := files.apply(i).getName()).startswith("shuffle_")}

    before = shuffled()
    monkeypatch.setattr(embed, "PART_ROWS", 10)
    parts = 0
    for part in embed.embedded_parts(docs, TokenHashEmbedder(4), existing):
        vector_store.append_vectors(part, str(tmp_path / "v"))
        parts += 1
        until = time.time() + 10  # they are removed in the background
        while (left := shuffled() - before) and time.time() < until:
            time.sleep(0.1)
        assert not left
    found = vector_store.read_vectors(spark, str(tmp_path / "v")).select(columns).collect()
    assert parts > 4 and sorted(map(str, found)) == sorted(map(str, wanted))
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"
    none = docs.where("source_id = 'x'")
    assert [p.count() for p in embed.embedded_parts(none, TokenHashEmbedder(4))] == [0]


def test_ids_are_stored_packed(spark, tmp_path):
    docs = spark.range(20_000).selectExpr("'a' source_table", "cast(id AS string) source_id", "'x' content", "'{}' metadata")
    vector_store.append_vectors(embed.embed_documents(docs, TokenHashEmbedder(4)), str(tmp_path / "v"))
    size = sum(f.stat().st_size for f in (tmp_path / "v").rglob("*.parquet"))
    assert size < 50 * 20_000  # 64 hex digits an id


def test_a_filter_on_the_result_does_not_call_the_model_again(spark):
    docs = spark.createDataFrame([("a", "1", "one", "{}")], DOC)
    kept = embed.embed_documents(docs, TokenHashEmbedder(4)).where("embedding is not null")
    assert kept._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    asked = embed.batch_answer(docs, [("m", str.upper)], prompt="content").where("error is null")
    assert asked._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert asked.first().answer == "ONE"


def test_token_hash():
    a, b, empty = TokenHashEmbedder(16)(["x y x", "y\tx\nx", " "])
    assert a.tolist() == b.tolist() and abs(float((a * a).sum()) - 1) < 1e-6
    assert not empty.any()


def test_token_hash_of_many_texts_is_that_of_each():
    texts = ["a b a", "", "a\u00a0b  c", " ".join(f"w{i % 37}" for i in range(500))]
    embedder = TokenHashEmbedder(16)
    assert [v.tolist() for v in embedder(texts)] == [embedder([t])[0].tolist() for t in texts]
    assert embedder([]) == []


def test_descriptions(spark):
    calls = []

    def describe(path, content):
        if path == "empty":
            return "  "
        return f" {path}:{len(content)} "

    df = spark.createDataFrame(
        [("a", bytearray(b"123")), ("gone", None), ("empty", bytearray(b""))], "image_path string, content binary"
    )
    rows = {r.image_path: r for r in embed.describe_images(df, describe, attempts=2, delay=0.0).collect()}
    assert rows["a"].description == "a:3" and rows["a"].describe_error is None
    assert rows["gone"].describe_error == "image not found: gone"
    assert rows["empty"].describe_error == "empty description"


def test_batch_answer(spark):
    models = [("m", lambda p: p.upper())]
    df = spark.createDataFrame([("hi",), ("yo",)], "prompt string")
    assert {r.answer for r in embed.batch_answer(df, models).collect()} == {"HI", "YO"}
