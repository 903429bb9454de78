"""The key store and the embedding stream that asks it."""

import pathlib
import random

import pytest
from pyspark.sql import functions as F, types as T

from caselens.operators.embed import TokenHashEmbedder
from caselens.sources import vector_store
from caselens.sources.key_store import KeyStore
from caselens.streaming import embed as stream_embedding

KEY = T.StructType().add("a", "string").add("b", "string")
DOC = "source_table string, source_id string, content string, metadata string"


def keys(spark, pairs):
    return spark.createDataFrame(pairs, KEY)


def found(held):
    return set() if held is None else {tuple(r) for r in held.collect()}


def test_held_keys_are_exact(spark, tmp_path):
    store = KeyStore(str(tmp_path), KEY, blocks=2, buckets=4, compact_after=2)
    rng = random.Random(1)
    known = set()
    assert store.held(keys(spark, [("t", "1")])) is None
    for batch in range(5):
        new = {("t", str(rng.randrange(2000))) for _ in range(300)} | {("u", str(batch))}
        store.add(keys(spark, sorted(new)), f"run:{batch}")
        store.add(keys(spark, sorted(new)), f"run:{batch}")
        known |= new
    asked = [("t", str(i)) for i in range(2500)] + [("u", "3"), ("u", "x"), ("t", None), (None, None)]
    assert found(store.held(keys(spark, asked))) == known & set(asked)
    assert 0 < store.density(spark) < 0.4


def test_a_full_filter_grows(spark, tmp_path):
    store = KeyStore(str(tmp_path), KEY, blocks=1, buckets=2, check_every=1)
    for i in range(2):
        pairs = spark.range(4000 * i, 4000 * i + 4000).select(F.lit("t").alias("a"), F.col("id").cast("string").alias("b"))
        store.add(pairs, f"run:{i}")
    assert store._blocks(spark) == 4 and store.density(spark) < 0.4
    asked = spark.range(7990, 8010).select(F.lit("t").alias("a"), F.col("id").cast("string").alias("b"))
    assert found(store.held(asked)) == {("t", str(i)) for i in range(7990, 8000)}


def spoil(folder):
    """Make the data files below ``folder`` unreadable."""
    for file in pathlib.Path(folder).rglob("part-*.parquet"):
        file.write_bytes(b"no longer a table")
        file.with_name(f".{file.name}.crc").unlink(missing_ok=True)


def test_new_keys_open_no_key_file(spark, tmp_path):
    store = KeyStore(str(tmp_path), KEY)
    store.add(keys(spark, [("t", str(i)) for i in range(500)]), "run:0")
    for part in (tmp_path / "keys").glob("kind=*"):
        spoil(part)
    assert store.held(keys(spark, [("new", str(i)) for i in range(300)])) is None
    with pytest.raises(Exception, match="parquet|PARQUET"):
        store.held(keys(spark, [("t", "7")])).collect()


def put(spark, folder, rows):
    spark.createDataFrame(rows, DOC).coalesce(1).write.mode("append").parquet(str(folder))


def run(spark, tmp_path, embedder=None, checkpoint="checkpoint", **options):
    stream = spark.readStream.schema(DOC).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "docs"))
    target = str(tmp_path / "vectors")
    stream_embedding.stream_embed(
        stream, target, str(tmp_path / checkpoint), embedder or TokenHashEmbedder(8), store_options={"buckets": 4}, **options
    ).awaitTermination()
    return sorted(r.source_id for r in vector_store.read_vectors(spark, target).collect())


def test_batches_of_new_documents_read_neither_keys_nor_vectors(spark, tmp_path):
    put(spark, tmp_path / "docs", [("t", str(i), f"text {i}", "{}") for i in range(50)])
    assert len(run(spark, tmp_path)) == 50
    store = stream_embedding.keys_of(str(tmp_path / "vectors"), buckets=4)
    buckets = {p[2] for p in store.last(spark).parts}
    assert buckets == set(range(4))
    for part in (tmp_path / "vectors" / "_keys" / "keys").glob("kind=*"):
        spoil(part)
    spoil(tmp_path / "vectors" / "source_table=t")
    put(spark, tmp_path / "docs", [("t", str(i), f"text {i}", "{}") for i in range(50, 60)])
    stream = spark.readStream.schema(DOC).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "docs"))
    query = stream_embedding.stream_embed(
        stream, str(tmp_path / "vectors"), str(tmp_path / "checkpoint"), TokenHashEmbedder(8), store_options={"buckets": 4}
    )
    query.awaitTermination()
    assert query.exception() is None
    put(spark, tmp_path / "docs", [("t", "7", "again", "{}")])  # a known one has to look
    with pytest.raises(Exception, match="parquet|PARQUET"):
        run(spark, tmp_path)


def fails_on(word):
    known = TokenHashEmbedder(8)

    def embed(texts):
        if any(word in t for t in texts):
            raise RuntimeError("refused")
        return known(texts)

    return embed


def test_failed_documents_stay_new(spark, tmp_path):
    put(spark, tmp_path / "docs", [("t", "1", "good", "{}"), ("t", "2", "bad", "{}")])
    assert run(spark, tmp_path, fails_on("bad"), attempts=1, batch_size=1) == ["1"]
    put(spark, tmp_path / "docs", [("t", "2", "bad", "{}"), ("t", "1", "good", "{}")])
    assert run(spark, tmp_path) == ["1", "2"]


def test_a_batch_that_failed_after_its_vectors_adds_nothing_twice(spark, tmp_path, monkeypatch):
    put(spark, tmp_path / "docs", [("t", "1", "one", "{}"), ("t", "2", "two", "{}")])

    def lost(self, keys, tag):
        raise RuntimeError("lost")

    with monkeypatch.context() as patched, pytest.raises(Exception, match="lost"):
        patched.setattr(KeyStore, "add", lost)
        run(spark, tmp_path)
    assert run(spark, tmp_path) == ["1", "2"]
    assert run(spark, tmp_path, checkpoint="from the start") == ["1", "2"]


def test_a_table_without_a_key_store_is_taken_in(spark, tmp_path):
    put(spark, tmp_path / "docs", [("t", "1", "one", "{}"), ("t", "2", "two", "{}")])
    old = spark.createDataFrame([("t", "1", "one", "{}")], DOC)
    embedded = stream_embedding.embed_rows(old, TokenHashEmbedder(8))
    vector_store.append_vectors(embedded, str(tmp_path / "vectors"))
    assert run(spark, tmp_path) == ["1", "2"]


def test_files_of_a_long_stream_stay_few(spark, tmp_path):
    store = KeyStore(str(tmp_path), KEY, blocks=4, buckets=2, compact_after=3)
    for batch in range(12):
        store.add(keys(spark, [("t", str(batch))]), f"run:{batch}")
        assert len(store.last(spark).parts) <= 2 * 4
    assert len(list(pathlib.Path(tmp_path).rglob("manifest=*"))) <= 4
