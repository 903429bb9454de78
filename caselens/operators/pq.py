"""Approximate nearest records by product quantisation with exact rescoring.

Unit vectors are cut into parts, and each part is replaced by the nearest of up to 256 entries
of that part's codebook, so a vector becomes a few bytes. A search reads the codes only: a
question's product with a record is the sum over the parts of its products with their
entries. Of what looks nearest a shortlist per question is kept, and only its vectors are
read and compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from caselens.functions.vectors import cosine_distance
from caselens.operators.skew import fits_broadcast as keys_fit_broadcast
from caselens.operators.topk import (
    MAX_BROADCAST_BYTES,
    MAX_CELLS,
    _NAN,
    _NULL,
    TASKS_PER_CORE,
    BestPerQuestion,
    blocks_of,
    finish,
    fits_broadcast,
    in_groups,
    keep_best,
    matrix_of,
    result_schema,
    small_tables,
    unit_rows,
)
from caselens.schemas import DEFAULT_TOP_K
from caselens.scratch import write_and_reread

PARTS, ENTRIES, ITERATIONS, TOLERANCE = 16, 256, 8, 1e-3
SHORTLIST = 8  # times k


@dataclass(frozen=True)
class Codes:
    """Where the records are stored with their codes, and the codebooks (parts, entries, width)."""

    path: str
    books: np.ndarray
    schema: T.StructType
    id_columns: list[str]
    vector: str

    def read(self, spark) -> DataFrame:
        return spark.read.schema(self.schema).parquet(self.path)


def _parts(units: np.ndarray, parts: int) -> np.ndarray:
    """parts x rows x width of a part"""
    return units.reshape(len(units), parts, -1).transpose(1, 0, 2)


def _nearest_entries(units: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, float]:
    """The nearest entry of each part (rows x parts), and the sum of the squared distances."""
    codes, error = np.empty((len(units), len(books)), np.uint8), 0.0
    for p, (part, book) in enumerate(zip(_parts(units, len(books)), books)):
        distance = (book * book).sum(1) - 2 * (part @ book.T)
        codes[:, p] = distance.argmin(1)
        error += float((part * part).sum() + distance.min(1).sum())
    return codes, error


def _known(table: pa.Table, vector: str, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit rows, which of them have a direction, which are not NULL."""
    matrix, present = matrix_of(table[vector], width)
    units = unit_rows(matrix)
    return units, present & ~np.isnan(units).any(1), present


def _block(width: int) -> int:
    return max(1, MAX_CELLS // max(width, ENTRIES))


def fit_books(
    vectors: DataFrame,
    *,
    width: int,
    id_columns: list[str],
    vector: str = "embedding",
    parts: int = PARTS,
    entries: int = ENTRIES,
    iterations: int = ITERATIONS,
    tolerance: float = TOLERANCE,
) -> np.ndarray:
    """Codebooks by k-means over all vectors, all parts in one pass per iteration, until the error
    falls by less than ``tolerance`` of itself. They begin with vectors chosen by a hash
    of their ids. An iteration brings one row per part and entry to the driver."""
    if width % parts or not 1 <= entries <= ENTRIES:
        raise ValueError(f"{parts} parts of equal width and {ENTRIES} entries at most")
    w = width // parts
    known = vectors.where(F.col(vector).isNotNull() & F.exists(vector, lambda x: x != 0))
    start = known.select(vector, F.xxhash64(*id_columns).alias("h")).orderBy("h").limit(entries).select(vector).toArrow()
    if not len(start):
        return np.zeros((parts, 1, w))
    books = _parts(unit_rows(matrix_of(start[vector], width)[0]), parts).copy()
    before = np.inf
    for _ in range(iterations):
        now = vectors.sparkSession.sparkContext.broadcast(books)

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            books = now.value
            total, count, error = np.zeros_like(books), np.zeros(books.shape[:2], np.int64), 0.0
            for table in small_tables(batches, max(width, ENTRIES)):
                units, good, _ = _known(table, vector, width)
                codes, part_error = _nearest_entries(units[good], books)
                error += part_error
                for p, part in enumerate(_parts(units[good], parts)):
                    np.add.at(total[p], codes[:, p], part)
                    count[p] += np.bincount(codes[:, p], minlength=books.shape[1])
            p, e = np.nonzero(count)
            columns = [
                pa.array([*p.tolist(), -1], pa.int32()),
                pa.array([*e.tolist(), 0], pa.int32()),
                pa.array([*count[p, e].tolist(), 0], pa.int64()),
                pa.array([*total[p, e].tolist(), [error, *[0.0] * (w - 1)]], pa.list_(pa.float64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["part", "entry", "n", "total"])

        partial = vectors.select(vector).mapInArrow(sums, "part int, entry int, n bigint, total array<double>")
        added = partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("total")[i]).alias(f"s{i}") for i in range(w)])
        books, error = books.copy(), 0.0
        for row in added.collect():
            if row["part"] < 0:
                error = row["s0"]
            else:
                books[row["part"], row["entry"]] = [row[f"s{i}"] / row["n"] for i in range(w)]
        if before - error <= tolerance * error:
            break
        before = error
    return books


def build_codes(
    vectors: DataFrame,
    path: str,
    *,
    width: int,
    id_columns: list[str] | None = None,
    vector: str = "embedding",
    books: np.ndarray | None = None,
    **options,
) -> Codes:
    """Store all records with their codes. A vector without a direction has an empty code, NULL none."""
    id_columns = id_columns or ["source_table", "source_id"]
    if books is None:
        books = fit_books(vectors, width=width, id_columns=id_columns, vector=vector, **options)
    shared = vectors.sparkSession.sparkContext.broadcast(books)
    schema = T.StructType([vectors.schema[c] for c in [*id_columns, vector]]).add("code", "binary")
    arrow_schema = to_arrow_schema(schema)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in small_tables(batches, max(width, ENTRIES)):
            units, good, present = _known(table, vector, width)
            codes, _ = _nearest_entries(np.where(good[:, None], units, 0), shared.value)
            rows = [code.tobytes() if g else b"" if p else None for code, g, p in zip(codes, good, present)]
            yield from table.append_column("code", pa.array(rows, pa.binary())).cast(arrow_schema).to_batches()

    vectors.select(*id_columns, vector).mapInArrow(encode, schema).write.mode("overwrite").parquet(path)
    return Codes(path, books, schema, id_columns, vector)


def _rebuilt(column: pa.ChunkedArray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What the codes stand for (NaN for empty ones), and which are not NULL."""
    codes, present = column.to_pylist(), np.asarray(column.combine_chunks().is_valid())
    out = np.full((len(codes), books.shape[0] * books.shape[2]), np.nan)
    good = np.array([bool(c) for c in codes], bool)
    if good.any():
        entries = np.frombuffer(b"".join(c for c in codes if c), np.uint8).reshape(-1, len(books))
        out[good] = books[np.arange(len(books)), entries].reshape(len(entries), -1)
    return out, present


def nearest_by_codes(
    codes: Codes,
    questions: DataFrame,
    k: int = DEFAULT_TOP_K,
    shortlist: int = SHORTLIST,
    *,
    question_id: str = "question_id",
    question_vector: str = "embedding",
    limit_bytes: int = MAX_BROADCAST_BYTES,
) -> DataFrame:
    """About the k nearest records of each question, with exact distances, ranked among the
    ``shortlist x k`` whose codes are nearest. A question without a vector finds nothing.

    Questions within ``limit_bytes`` are sent to every executor. More than that are dealt to tasks in
    bounded groups, past which the codes are read, and then the vectors.
    """
    spark = questions.sparkSession
    ids, books = codes.id_columns, codes.books
    width = books.shape[0] * books.shape[2]
    stored = codes.read(spark)
    schema = result_schema(stored, questions, question_id, ids)
    arrow_schema = to_arrow_schema(schema)
    questions = questions.select(question_id, question_vector).where(F.col(question_vector).isNotNull())
    local = fits_broadcast(questions, width, limit_bytes)
    if local is None:
        found = _in_groups(codes, stored, questions, question_id, question_vector, k, shortlist, schema)
        return keep_best(found, question_id, ids, k)
    units = unit_rows(matrix_of(local[question_vector], width)[0])
    shared = spark.sparkContext.broadcast((units, local[question_id].combine_chunks(), books))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, names, books = shared.value
        best = BestPerQuestion(len(units), ids, shortlist * k)
        for table in small_tables(batches, width):
            table = table.sort_by([(c, "ascending") for c in ids])
            rebuilt, present = _rebuilt(table["code"], books)
            best.offer_vectors(table.select(ids), rebuilt, present, units, np.arange(len(units)))
        found = best.result()
        if found is not None:
            yield from finish(found, names, arrow_schema)

    cores = spark.sparkContext.defaultParallelism
    near = stored.select(*ids, "code").coalesce(TASKS_PER_CORE * cores).mapInArrow(scan, schema)
    listed = write_and_reread(keep_best(near, question_id, ids, shortlist * k).select(question_id, *ids), "shortlist")
    asked = questions.select(question_id, F.col(question_vector).alias("_asked"))
    side = F.broadcast(listed) if keys_fit_broadcast(listed) else listed
    pairs = stored.select(*ids, F.col(codes.vector).alias("_vector")).join(side, ids).join(F.broadcast(asked), question_id)
    distance = F.round(cosine_distance(F.col("_vector"), F.col("_asked")), 9)
    return keep_best(pairs.select(question_id, *ids, distance.alias("distance")), question_id, ids, k)


def _in_groups(codes: Codes, stored: DataFrame, questions, question_id, question_vector, k, shortlist, schema) -> DataFrame:
    """The k best of each question in groups of questions. A record is known by its place in the files."""
    ids, books, vector = codes.id_columns, codes.books, codes.vector
    width, arrow_schema = books.shape[0] * books.shape[2], to_arrow_schema(schema)
    blocks = blocks_of(stored, width)
    shared = stored.sparkSession.sparkContext.broadcast(books)

    def search(units: np.ndarray, names: pa.Array) -> Iterator[pa.RecordBatch]:
        best, start = BestPerQuestion(len(units), [*ids, "_at"], shortlist * k), 0
        for table in blocks.read([*ids, "code"]):
            table = table.append_column("_at", pa.array(np.arange(start, start + len(table))))
            start += len(table)
            table = table.sort_by([(c, "ascending") for c in ids])
            rebuilt, present = _rebuilt(table["code"], shared.value)
            best.offer_vectors(table.select([*ids, "_at"]), rebuilt, present, units, np.arange(len(units)))
        listed = best.result()
        if listed is None:
            return
        listed = listed.sort_by("_at")
        at, question = listed["_at"].to_numpy(), listed["_q"].to_numpy()
        distance, start = np.empty(len(at)), 0
        for table in blocks.read([vector]):
            low, high = np.searchsorted(at, [start, start + len(table)])
            if low < high:
                rows, present = matrix_of(table[vector], width)
                rows = unit_rows(rows)
                step = max(1, MAX_CELLS // width)
                for a in range(low, high, step):
                    part = slice(a, min(high, a + step))
                    own = at[part] - start
                    found = np.round(1.0 - np.einsum("ij,ij->i", rows[own], units[question[part]]), 9)
                    found[np.isnan(found)] = _NAN
                    distance[part] = np.where(present[own], found, _NULL)
            start += len(table)
        nearest = BestPerQuestion(len(units), ids, k)
        nearest.tables = [listed.drop_columns(["_at", "_d"]).append_column("_d", pa.array(distance))]
        yield from finish(nearest.result(), names, arrow_schema)

    return in_groups(questions, question_id, question_vector, width, shortlist * k, search, schema)
