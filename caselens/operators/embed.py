"""Embedding, description and answering with pluggable Python callables.

A callable is called inside the tasks on small batches. Tasks may be retried, so a
callable must give the same result when called again. A call that keeps failing is
reported in an error column instead of ending the job.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from caselens.functions.text import has_content
from caselens.operators.skew import fits_broadcast, held_of, missing_from, without_keys
from caselens.schemas import DEFAULT_BATCH, EMBEDDINGS_KEY
from caselens.scratch import shuffles_dropped, write_and_reread

Embedder = Callable[[list[str]], Sequence[Sequence[float]]]

PART_ROWS = 1 << 26  # of documents whose texts are in shuffle files at once
MAX_ATTEMPTS = 6
FIRST_DELAY = 2.0


def with_retries(call, attempts: int = MAX_ATTEMPTS, delay: float = FIRST_DELAY, sleep=time.sleep):
    """``call`` that is tried again after 2, 4, 8, ... seconds; the last error is raised."""

    def tried(*args):
        for attempt in range(attempts):
            try:
                return call(*args)
            except FileNotFoundError:
                raise
            except Exception:
                if attempt == attempts - 1:
                    raise
                sleep(delay * 2**attempt)

    return tried


def once(function):
    """A function Spark must not call a second time for a filter on its result, which it
    would otherwise evaluate early on its own."""
    return function.asNondeterministic()


class _Buckets(dict):
    """token -> bucket, remembered while they are not too many."""

    MOST = 1 << 17

    def __init__(self, dimensions: int):
        super().__init__()
        self.dimensions = dimensions

    def __missing__(self, token: bytes) -> int:
        if len(self) >= self.MOST:
            self.clear()
        number = int.from_bytes(hashlib.md5(token).digest()[:4], "big")
        self[token] = bucket = number % self.dimensions
        return bucket


_KNOWN: dict[int, _Buckets] = {}  # kept from task to task


def _list_array(vectors: list[np.ndarray | None]) -> pa.Array:
    """The vectors as a list column, None as NULL."""
    sizes = [0 if v is None else len(v) for v in vectors]
    flat = np.concatenate([np.zeros(0, "float32"), *[v for v in vectors if v is not None]])
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype("int32"))
    missing = pa.array([v is None for v in vectors], pa.bool_())
    return pa.ListArray.from_arrays(offsets, pa.array(flat, pa.float32()), mask=missing)


class TokenHashEmbedder:
    """The offline default: counts of md5-hashed tokens, scaled to length one.

    Tokens are runs of characters other than ASCII white space. A text without tokens
    gives a zero vector.
    """

    def __init__(self, dimensions: int = 64):
        self.dimensions = dimensions

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        known = _KNOWN.setdefault(self.dimensions, _Buckets(self.dimensions))
        tokens = [text.encode().split() for text in texts]
        sizes = np.array([len(t) for t in tokens], "int64")
        buckets = np.fromiter((known[t] for text in tokens for t in text), "int64", sizes.sum())
        places = np.repeat(np.arange(len(texts)) * self.dimensions, sizes) + buckets
        counts = np.bincount(places, minlength=len(texts) * self.dimensions).reshape(-1, self.dimensions).astype("float64")
        lengths = np.sqrt(np.einsum("ij,ij->i", counts, counts))
        return list((counts / np.where(lengths > 0, lengths, 1.0)[:, None]).astype("float32"))


def embed_texts(
    df: DataFrame,
    text: str,
    embedder: Embedder,
    *,
    batch_size: int = DEFAULT_BATCH,
    attempts: int = MAX_ATTEMPTS,
    delay: float = FIRST_DELAY,
) -> DataFrame:
    """Add ``embedding`` and ``embed_error``. Concurrency is the number of partitions."""
    call = with_retries(embedder, attempts, delay)
    added = T.StructType().add("embedding", T.ArrayType(T.FloatType())).add("embed_error", "string")

    def one_call(texts: list[str]) -> tuple[list, list]:
        try:
            vectors = [np.asarray(v, "float32") for v in call(texts)]
            if len(vectors) != len(texts):
                raise ValueError(f"{len(texts)} texts gave {len(vectors)} vectors")
            return vectors, [None] * len(texts)
        except Exception as error:  # reported per row
            return [None] * len(texts), [str(error)] * len(texts)

    @F.arrow_udf(added)
    def embed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            vectors, errors = [], []
            for at in range(0, len(batch), batch_size):
                found, failed = one_call(batch.slice(at, batch_size).to_pylist())
                vectors += found
                errors += failed
            yield pa.StructArray.from_arrays(
                [_list_array(vectors), pa.array(errors, pa.string())],
                names=["embedding", "embed_error"],
            )

    return df.withColumn("_e", once(embed)(F.col(text))).select(
        *df.columns, "_e.embedding", "_e.embed_error"
    )


def embedding_id() -> Column:
    """A key that is the same on every run."""
    return F.sha2(F.concat_ws("\u0001", "source_table", "source_id"), 256)


def unembedded(documents: DataFrame, existing: DataFrame) -> DataFrame:
    """Documents with content whose (source_table, source_id) has no vector yet."""
    return missing_from(documents.where(has_content("content")), existing, EMBEDDINGS_KEY)


def new_documents(
    documents: DataFrame, held: DataFrame | Callable[[DataFrame], DataFrame | None] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Documents with content whose (source_table, source_id) is not held yet, each key once (of
    several rows the least by their values); and their keys, stored.

    The keys are counted and stored first; all that is asked of them is asked of that table.
    ``held`` is a table of keys or a function from asked keys to those of them that are held.
    Texts are read once after that, and combined before any shuffle only for keys that
    repeat, so a key that repeats very often costs no more than another.
    """
    todo = documents.where(has_content("content"))
    keys = write_and_reread(todo.groupBy(*EMBEDDINGS_KEY).agg(F.count(F.lit(1)).alias("_n")), "asked-keys")
    if callable(held):
        known = held(keys.select(*EMBEDDINGS_KEY))
    else:
        known = held if held is None else held_of(keys, held, EMBEDDINGS_KEY).distinct()
    if known is not None:
        known = write_and_reread(known, "held-keys")
        side = F.broadcast(known) if fits_broadcast(known) else known
        keys = write_and_reread(without_keys(keys, side, EMBEDDINGS_KEY), "new-keys")
        todo = without_keys(todo, side, EMBEDDINGS_KEY)
    repeated = keys.where("_n > 1").select(*EMBEDDINGS_KEY)
    if not repeated.isEmpty():
        todo = _least_of(todo, repeated)
    return todo, keys.select(*EMBEDDINGS_KEY).dropna()


def _least_of(documents: DataFrame, repeated: DataFrame) -> DataFrame:
    rest = [c for c in documents.columns if c not in EMBEDDINGS_KEY]

    def least(rows: DataFrame) -> DataFrame:
        kept = rows.groupBy(*EMBEDDINGS_KEY).agg(F.min(F.struct(*rest)).alias("_row"))
        return kept.select(*EMBEDDINGS_KEY, *[F.col(f"_row.{c}").alias(c) for c in rest])

    if not fits_broadcast(repeated):
        return least(documents)
    repeated = F.broadcast(repeated)
    single = documents.join(repeated, EMBEDDINGS_KEY, "left_anti")
    return single.unionByName(least(documents.join(repeated, EMBEDDINGS_KEY, "left_semi")))


def embed_rows(documents: DataFrame, embedder: Embedder, **options) -> DataFrame:
    """Rows for the vector table. Embedding costs far more than moving the texts, so they are
    spread evenly over the tasks by their key, which no two of them share."""
    tasks = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return embed_texts(documents.repartition(tasks, *EMBEDDINGS_KEY), "content", embedder, **options).select(
        embedding_id().alias("embedding_id"),
        "source_table",
        "source_id",
        "content",
        "embedding",
        "metadata",
        F.current_timestamp().alias("created_at"),
        "embed_error",
    )


def embed_documents(
    documents: DataFrame,
    embedder: Embedder,
    existing: DataFrame | None = None,
    **options,
) -> DataFrame:
    """Rows for the vector table: new documents only, each (source_table, source_id) once."""
    return embed_rows(new_documents(documents, existing)[0], embedder, **options)


def embedded_parts(
    documents: DataFrame,
    embedder: Embedder,
    existing: DataFrame | None = None,
    **options,
) -> Iterator[DataFrame]:
    """:func:`embed_documents` in parts, each to be stored before the next is asked for. A part holds
    the keys of one range of their hashes, about ``PART_ROWS`` documents, and its shuffle files go
    when it is stored, so that those on disk do not grow with the table. A table of several parts is
    read once a part; what models gave for it should be stored before.
    """
    with shuffles_dropped(documents.sparkSession):
        new, keys = new_documents(documents, existing)
        parts = max(1, -(-keys.count() // PART_ROWS))
        for part in range(parts):
            own = F.pmod(F.xxhash64(*EMBEDDINGS_KEY), F.lit(parts)) == part
            yield embed_rows(new.where(own) if parts > 1 else new, embedder, **options)


def describe_images(
    images: DataFrame,
    describer: Callable[[str, bytes], str],
    *,
    path: str = "image_path",
    content: str = "content",
    attempts: int = MAX_ATTEMPTS,
    delay: float = FIRST_DELAY,
) -> DataFrame:
    """Add ``description`` and ``describe_error``. A missing image (NULL content) is an
    error at once; an empty description is one that is tried again."""

    def checked(name: str, data: bytes) -> str:
        words = describer(name, data).strip()
        if not words:
            raise ValueError("empty description")
        return words

    call = with_retries(checked, attempts, delay)

    def one(name: str, data: bytes | None) -> tuple[str | None, str | None]:
        if data is None:
            return None, f"image not found: {name}"
        try:
            return call(name, data), None
        except Exception as error:  # reported per row
            return None, str(error)

    @F.pandas_udf("description string, describe_error string")
    def describe(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for names, contents in batches:
            rows = [one(n, c) for n, c in zip(names, contents)]
            yield pd.DataFrame(rows, columns=["description", "describe_error"])

    return images.withColumn("_d", once(describe)(F.col(path), F.col(content))).select(
        *images.columns, "_d.description", "_d.describe_error"
    )


def call_each(
    df: DataFrame,
    text: str,
    make_call: Callable[[], Callable[[str], str]],
    *,
    attempts: int = MAX_ATTEMPTS,
    delay: float = FIRST_DELAY,
) -> DataFrame:
    """Add ``result``, ``attempts`` (the calls it took) and ``error`` (the last one's, or NULL).
    Each text has a callable of its own from ``make_call``."""

    def one(value: str) -> tuple[str | None, int, str | None]:
        made, call = 0, make_call()

        def counted(x: str) -> str:
            nonlocal made
            made += 1
            return call(x)

        try:
            return with_retries(counted, attempts, delay)(value), made, None
        except Exception as error:  # reported per row
            return None, made, str(error)

    @F.pandas_udf("result string, attempts int, error string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([one(v) for v in batch], columns=["result", "attempts", "error"])

    return df.withColumn("_r", once(run)(F.col(text))).select(*df.columns, "_r.result", "_r.attempts", "_r.error")


class ModelError(Exception):
    """A request the model refused; ``code`` 429 means its quota is used up."""

    def __init__(self, message: str, code: int | None = None):
        super().__init__(message)
        self.code = code


def answer_with_fallback(prompt: str, models: list[tuple[str, Callable[[str], str]]]):
    """(answer, model, error): the first model that answers.

    A used-up quota goes on to the next model, any other refusal ends the row, any other
    error goes on but counts as the row's error when it came from the last model. All
    quotas used up means no answer and no error.
    """
    for number, (name, model) in enumerate(models):
        try:
            return model(prompt), name, None
        except ModelError as refused:
            if refused.code != 429:
                return None, name, str(refused)
        except Exception as error:
            if number == len(models) - 1:
                return None, name, str(error)
    return None, None, None


def batch_answer(
    prompts: DataFrame, models: list[tuple[str, Callable[[str], str]]], prompt: str = "prompt"
) -> DataFrame:
    """Add ``answer``, ``model_used`` and ``error``."""
    schema = T.StructType.fromDDL("answer string, model_used string, error string")

    @F.pandas_udf(schema)
    def ask(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [answer_with_fallback(text, models) for text in batch]
            yield pd.DataFrame(rows, columns=schema.names, dtype=object)

    return prompts.withColumn("_a", once(ask)(F.col(prompt))).select(
        *prompts.columns, "_a.answer", "_a.model_used", "_a.error"
    )
