"""Incremental embedding: a stream of documents appended to the vector table.

Each micro-batch embeds only documents the table does not hold. A key store beside the table
says which those are, so a batch costs what its own rows cost. A batch that runs again after a
failure asks the table itself, finds there what it had written, and nothing is added twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, functions as F
from pyspark.sql.streaming import StreamingQuery

from caselens.operators.embed import Embedder, embed_rows, new_documents
from caselens.operators.skew import fits_broadcast
from caselens.schemas import EMBEDDINGS_KEY, EMBEDDINGS_SCHEMA
from caselens.scratch import read_text, write_and_reread, write_text
from caselens.sources.key_store import KeyStore
from caselens.sources.vector_store import append_vectors, stored_vectors


def keys_of(target: str, **options) -> KeyStore:
    """The key store of the vector table at ``target``, in a folder that readers of the table skip."""
    key = EMBEDDINGS_SCHEMA[:0]
    for name in EMBEDDINGS_KEY:
        key = key.add(EMBEDDINGS_SCHEMA[name])
    return KeyStore(f"{target}/_keys", key, **options)


def add_new(batch: DataFrame, target: str, tag: str, embedder: Embedder, store: KeyStore, **options) -> None:
    """Embed and append the documents of one batch that the table does not hold."""
    spark = batch.sparkSession
    last = store.last(spark)
    if last.tag == tag:
        return
    vectors = stored_vectors(spark, target)
    if last.version < 0 and vectors is not None:  # a table from before, or from elsewhere
        store.add(vectors.select(*EMBEDDINGS_KEY).distinct(), "as found")
    begun = f"{target}/_keys/begun"
    if read_text(spark, begun) == tag:
        held = vectors.select(*EMBEDDINGS_KEY) if vectors is not None else None
    else:
        held = store.held
        write_text(spark, begun, tag)
    documents, keys = new_documents(batch, held)
    seen = Observation()
    embedded = embed_rows(documents, embedder, **options)
    failed = F.coalesce(F.count_if(F.col("embedding").isNull()), F.lit(0)).alias("failed")
    append_vectors(embedded.observe(seen, failed), target)
    if seen.get["failed"]:  # they stay new
        side = F.broadcast(keys) if fits_broadcast(keys) else keys
        stored = stored_vectors(spark, target)
        keys = write_and_reread(stored.select(*EMBEDDINGS_KEY).join(side, EMBEDDINGS_KEY, "left_semi"), "embedded-keys")
    store.add(keys, tag)


def stream_embed(
    documents: DataFrame,
    target: str,
    checkpoint: str,
    embedder: Embedder,
    *,
    available_now: bool = True,
    store_options: dict | None = None,
    **options,
) -> StreamingQuery:
    """``documents``: a stream of (source_table, source_id, content, metadata)."""
    store = keys_of(target, **(store_options or {}))

    def add(batch: DataFrame, batch_id: int) -> None:
        add_new(batch, target, f"{checkpoint}:{batch_id}", embedder, store, **options)

    writer = documents.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
