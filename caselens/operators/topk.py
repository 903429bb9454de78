"""Exact nearest records by cosine distance, for one question or for many.

Every task scores its own vectors against the questions and keeps only the k best per
question, so what leaves a task is ``questions x k`` rows however many vectors it read.
No pair is ever a row. Distances are compared after rounding to nine decimals: two sums
of the same products in another order differ beyond that, and such ties fall to the id.
NaN distances (zero vectors) come after all others and NULL vectors after those.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as parquet
from pyspark.sql import DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from caselens.operators.skew import fits_broadcast as keys_fit_broadcast, skew_join
from caselens.schemas import DEFAULT_TOP_K
from caselens.scratch import write_and_reread
from caselens.sources.files import open_file

MAX_BROADCAST_BYTES = 128 << 20  # the question matrix sent to every executor
MAX_QUESTIONS = 50_000  # questions whose k best a task keeps
MAX_CELLS = 4 << 20  # numbers of a matrix held at once in a task
TILE_CELLS, TILE_QUESTIONS = 1 << 18, 512  # products in 32 bits at a time
FIRST_ROWS = 1024  # that give a question its first limit
MAX_COMPARED = 1 << 16  # pairs compared exactly at a time
GROUP_QUESTIONS = 4096  # that a task holds while all vectors pass it
GROUP_BEST = 1 << 19  # rows of their results
BLOCK_ROWS = 4096  # vectors that pass at a time
SAMPLE_ROWS = 4 << 20  # vectors that give a first bound
SAMPLE_TASKS = 64
TASKS_PER_CORE = 2  # tasks that scan all vectors; each emits questions x k rows at most

_NAN, _NULL = 3.0, 4.0  # sort positions beyond any distance


def matrix_of(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows x width doubles, which rows are not NULL); another width is an error."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    present = np.asarray(column.is_valid())
    lengths = pc.list_value_length(column).drop_null()
    if len(lengths) and not pc.all(pc.equal(lengths, width)).as_py():
        raise ValueError(f"expected {width} dimensions, found {pc.unique(lengths).to_pylist()}")
    out = np.zeros((len(column), width))
    values = np.asarray(column.drop_null().flatten().to_numpy(zero_copy_only=False), dtype="float64")
    out[present] = values.reshape(-1, width)
    return out, present


def unit_rows(matrix: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; zero rows become NaN."""
    with np.errstate(invalid="ignore", divide="ignore"):
        return matrix / np.linalg.norm(matrix, axis=1, keepdims=True)


class BestPerQuestion:
    """The k best (question, distance, ids) seen so far, as one small Arrow table."""

    def __init__(self, n_questions: int, id_columns: list[str], k: int, limit: np.ndarray | None = None):
        """``limit``: distances beyond which nothing of a question is wanted."""
        self.k, self.ids = k, id_columns
        self.limit = np.full(n_questions, np.inf) if limit is None else limit.copy()
        self.tables: list[pa.Table] = []
        self.rows = self.blocks = 0

    def offer(self, ids: pa.Table, scores: np.ndarray, questions: np.ndarray) -> None:
        """``scores`` is rows x questions; ``ids`` must be sorted, so that among equal
        scores the first rows win."""
        if not len(scores):
            return
        k = min(self.k, len(scores))
        cut = np.minimum(np.partition(scores, k - 1, axis=0)[k - 1], self.limit[questions])
        ties = scores == cut
        keep = (scores < cut) | (ties & (np.cumsum(ties, axis=0) <= self.k))
        row, column = np.nonzero(keep)
        if not len(row):
            return
        self._add(ids, row, questions[column], scores[row, column])

    def offer_vectors(self, ids: pa.Table, units: np.ndarray, present: np.ndarray, question_units: np.ndarray, questions: np.ndarray) -> None:
        """The same by the vectors of the rows and of the questions. Products in 32 bits leave out
        what is surely beyond a question's limit; only the others are compared exactly."""
        if not len(units) or not len(questions):
            return
        if len(units) > FIRST_ROWS and np.isinf(self.limit[questions]).any():
            self._offer_block(ids.slice(0, FIRST_ROWS), units[:FIRST_ROWS], present[:FIRST_ROWS], question_units, questions)
            self.compact()
            ids, units, present = ids.slice(FIRST_ROWS), units[FIRST_ROWS:], present[FIRST_ROWS:]
        self._offer_block(ids, units, present, question_units, questions)
        self.blocks += 1
        if not self.blocks & (self.blocks - 1) and np.isinf(self.limit).any():
            self.compact()

    def _offer_block(self, ids: pa.Table, units: np.ndarray, present: np.ndarray, question_units: np.ndarray, questions: np.ndarray) -> None:
        known = self.limit[questions] <= 2.5
        own = np.flatnonzero(known)
        exact = [np.flatnonzero(~known)]
        if len(own):
            exact += self._offer_near(ids, units, question_units, questions, own)
        for rest in exact:
            step = max(1, MAX_CELLS // max(len(units), units.shape[1]))
            for at in range(0, len(rest), step):
                some = rest[at : at + step]
                self.offer(ids, score_block(units, present, question_units[some]), questions[some])

    def _offer_near(self, ids: pa.Table, units: np.ndarray, question_units: np.ndarray, questions: np.ndarray, own: np.ndarray) -> list[np.ndarray]:
        """Offer what is within the limits of the questions at ``own``, except for those, which are
        returned, that too many rows are near to: copies without end, of which only k are taken. Products
        are taken in tiles that stay in a core's cache."""
        width = units.shape[1]
        longest = max(1.0, float(np.sqrt(np.nanmax(np.einsum("ij,ij->i", units, units), initial=0.0))))
        margin = (1e-6 + 2e-7 * width) * longest
        limit = self.limit[questions[own]]
        least = (1 - limit - margin).astype("float32")
        near, asked = units.astype("float32"), np.ascontiguousarray(question_units[own].astype("float32").T)
        products, hits = np.empty(TILE_CELLS, "float32"), np.empty(TILE_CELLS + 8, bool)
        crowded, rows, columns, held = [], [], [], 0

        def compare() -> None:
            nonlocal held
            if held:
                row, column = np.concatenate(rows), np.concatenate(columns)
                rows.clear()
                columns.clear()
                held = 0
                distance = np.round(1.0 - np.einsum("ij,ij->i", units[row], question_units[own[column]]), 9)
                keep = distance <= limit[column]
                self._add(ids, row[keep], questions[own[column[keep]]], distance[keep])

        for q in range(0, len(own), TILE_QUESTIONS):
            block, bound = asked[:, q : q + TILE_QUESTIONS], least[q : q + TILE_QUESTIONS]
            wide = len(bound)
            found, n, most = [], 0, len(units) * wide // 16
            for r in range(0, len(near), TILE_CELLS // wide):
                some = near[r : r + TILE_CELLS // wide]
                size = len(some) * wide
                product, hit = products[:size].reshape(-1, wide), hits[:size].reshape(-1, wide)
                np.greater_equal(np.matmul(some, block, out=product), bound, out=hit)
                here = np.count_nonzero(hit)
                if here:
                    n += here
                    if n > most:
                        break
                    hits[size : size + 8] = False
                    eights = np.flatnonzero(hits[: -(-size // 8) * 8].view(np.uint64))
                    cells = (eights[:, None] * 8 + np.arange(8)).ravel()
                    found.append(cells[hits[cells]] + r * wide)
            if n > most:
                crowded.append(own[q : q + wide])
            elif n:
                row, column = np.divmod(np.concatenate(found), wide)
                rows.append(row)
                columns.append(column + q)
                held += n
                if held > MAX_COMPARED:
                    compare()
        compare()
        return crowded

    def _add(self, ids: pa.Table, row: np.ndarray, questions: np.ndarray, distances: np.ndarray) -> None:
        if not len(row):
            return
        taken = ids.take(pa.array(row))
        taken = taken.append_column("_q", pa.array(questions.astype("int32")))
        taken = taken.append_column("_d", pa.array(distances))
        self.tables.append(taken)
        self.rows += len(row)
        if self.rows > 4 * len(self.limit) * self.k + 100_000:
            self.compact()

    def compact(self) -> None:
        if not self.tables:
            return
        order = [("_q", "ascending"), ("_d", "ascending"), *[(c, "ascending") for c in self.ids]]
        table = pa.concat_tables(self.tables).sort_by(order)
        question = table["_q"].to_numpy()
        rank = np.arange(len(question)) - np.searchsorted(question, question)
        table = table.filter(pa.array(rank < self.k))
        kth = np.flatnonzero(rank[rank < self.k] == self.k - 1)
        self.limit[table["_q"].to_numpy()[kth]] = table["_d"].to_numpy()[kth]
        self.tables, self.rows = [table], len(table)

    def result(self) -> pa.Table | None:
        self.compact()
        return self.tables[0] if self.tables else None


def score_block(units: np.ndarray, present: np.ndarray, question_units: np.ndarray) -> np.ndarray:
    scores = np.round(1.0 - units @ question_units.T, 9)
    scores[np.isnan(scores)] = _NAN
    scores[~present] = _NULL
    return scores


def finish(table: pa.Table, question_ids: pa.Array, schema: pa.Schema) -> list[pa.RecordBatch]:
    """Sort positions back to NaN and NULL, question numbers back to question ids."""
    scores = table["_d"].to_numpy()
    distance = pa.array(np.where(scores == _NAN, np.nan, scores), mask=scores == _NULL)
    columns = [question_ids.take(table["_q"].combine_chunks())]
    columns += [table[c].combine_chunks() for c in schema.names[1:-1]]
    out = pa.table([*columns, distance], names=schema.names).cast(schema)
    return out.to_batches(max_chunksize=10_000)


def small_tables(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.Table]:
    """The batches cut so that a matrix of their vectors stays small however wide."""
    rows = max(1, MAX_CELLS // width)
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield pa.Table.from_batches([batch.slice(at, rows)])


def scan_batches(
    batches: Iterator[pa.RecordBatch],
    question_units: np.ndarray,
    question_ids: pa.Array,
    id_columns: list[str],
    vector: str,
    k: int,
    schema: pa.Schema,
    limit: np.ndarray | None = None,
) -> Iterator[pa.RecordBatch]:
    width = question_units.shape[1]
    yield from scan_tables(small_tables(batches, width), question_units, question_ids, id_columns, vector, k, schema, limit)


def scan_tables(tables, question_units, question_ids, id_columns, vector, k, schema, limit=None) -> Iterator[pa.RecordBatch]:
    best = BestPerQuestion(len(question_units), id_columns, k, limit)
    width, everyone = question_units.shape[1], np.arange(len(question_units))
    for table in tables:
        table = table.sort_by([(c, "ascending") for c in id_columns])
        matrix, present = matrix_of(table[vector], width)
        best.offer_vectors(table.select(id_columns), unit_rows(matrix), present, question_units, everyone)
    found = best.result()
    if found is not None:
        yield from finish(found, question_ids, schema)


@dataclass(frozen=True)
class Blocks:
    """The files of a stored table, which tasks read in blocks of ``rows`` rows."""

    paths: list[str]
    rows: int

    def read(self, columns: list[str], paths: list[str] | None = None) -> Iterator[pa.Table]:
        for path in self.paths if paths is None else paths:
            with open_file(unquote(path)) as file:
                for batch in parquet.ParquetFile(file).iter_batches(self.rows, columns=columns):
                    yield pa.Table.from_batches([batch])


def blocks_of(stored: DataFrame, width: int, rows: int | None = None) -> Blocks:
    return Blocks(sorted(stored.inputFiles()), max(1, min(rows or BLOCK_ROWS, MAX_CELLS // width)))


Search = Callable[[np.ndarray, pa.Array], Iterator[pa.RecordBatch]]


def in_groups(questions: DataFrame, question_id: str, question_vector: str, width: int, k: int, search: Search, schema: T.StructType, cells: int = 1) -> DataFrame:
    """What ``search`` finds for (unit vectors, ids) of groups of questions. A task holds one group at a
    time, bounded in questions, in their results of ``k`` rows and in numbers for ``cells`` of each, and
    reads what it compares them with from storage: no vector and no question is ever repeated."""
    most = max(1, min(GROUP_QUESTIONS, GROUP_BEST // k, 2 * MAX_CELLS // max(cells, width)))
    n, cores = questions.count(), questions.sparkSession.sparkContext.defaultParallelism
    tasks = max(1, -(-n // most), min(TASKS_PER_CORE * cores, n // 256))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def asked():
            table = pa.Table.from_batches(held)
            held.clear()
            return unit_rows(matrix_of(table[question_vector], width)[0]), table[question_id].combine_chunks()

        for batch in batches:
            for at in range(0, batch.num_rows, most):
                held.append(batch.slice(at, most))
                if sum(b.num_rows for b in held) >= most:
                    yield from search(*asked())
        if held:
            yield from search(*asked())

    return questions.select(question_id, question_vector).repartition(tasks).mapInArrow(run, schema)


def result_schema(vectors: DataFrame, questions: DataFrame, question_id: str, id_columns: list[str]):
    return T.StructType(
        [
            T.StructField(question_id, questions.schema[question_id].dataType),
            *[T.StructField(c, vectors.schema[c].dataType) for c in id_columns],
            T.StructField("distance", T.DoubleType()),
        ]
    )


def keep_best(candidates: DataFrame, question_id: str, id_columns: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(question_id).orderBy(F.col("distance").asc_nulls_last(), *id_columns)
    return candidates.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def fits_broadcast(questions: DataFrame, width: int, limit_bytes: int) -> pa.Table | None:
    """The questions as an Arrow table if their number fits the limits, else None."""
    most = min(MAX_QUESTIONS, limit_bytes // (8 * width))
    return questions.toArrow() if questions.count() <= most else None


def nearest(
    vectors: DataFrame,
    questions: DataFrame,
    k: int = DEFAULT_TOP_K,
    *,
    width: int,
    question_id: str = "question_id",
    question_vector: str = "embedding",
    id_columns: list[str] | None = None,
    vector: str = "embedding",
    limit_bytes: int = MAX_BROADCAST_BYTES,
    grid_rows: int | None = None,
) -> DataFrame:
    """(question id, record ids, distance, rank): the k nearest records of each question. A
    question without a vector finds nothing.

    Questions within ``limit_bytes`` are sent to every executor and the vectors are
    read in place, by a number of tasks that follows the cores and not the files: each
    hands on no more than k rows per question. More questions than that are dealt to tasks in
    bounded groups; the vectors are stored once and pass each group in blocks of ``grid_rows``.
    """
    id_columns = id_columns or ["source_table", "source_id"]
    schema = result_schema(vectors, questions, question_id, id_columns)
    arrow_schema = to_arrow_schema(schema)
    vectors = vectors.select(*id_columns, vector)
    questions = questions.select(question_id, question_vector).where(F.col(question_vector).isNotNull())

    local = fits_broadcast(questions, width, limit_bytes)
    if local is not None:
        matrix, _ = matrix_of(local[question_vector], width)
        shared = vectors.sparkSession.sparkContext.broadcast(
            (unit_rows(matrix), local[question_id].combine_chunks())
        )

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            units, names = shared.value
            yield from scan_batches(batches, units, names, id_columns, vector, k, arrow_schema)

        cores = vectors.sparkSession.sparkContext.defaultParallelism
        candidates = vectors.coalesce(TASKS_PER_CORE * cores).mapInArrow(scan, schema)
    else:
        blocks = blocks_of(write_and_reread(vectors, "vectors"), width, grid_rows)

        def search(units: np.ndarray, names: pa.Array) -> Iterator[pa.RecordBatch]:
            yield from scan_tables(blocks.read([*id_columns, vector]), units, names, id_columns, vector, k, arrow_schema)

        candidates = in_groups(questions, question_id, question_vector, width, k, search, schema)
    return keep_best(candidates, question_id, id_columns, k)


def nearest_bounded(
    vectors: DataFrame,
    questions: DataFrame,
    k: int = DEFAULT_TOP_K,
    *,
    width: int,
    question_id: str = "question_id",
    question_vector: str = "embedding",
    id_columns: list[str] | None = None,
    vector: str = "embedding",
    sample_rows: int = SAMPLE_ROWS,
    limit_bytes: int = MAX_BROADCAST_BYTES,
) -> DataFrame:
    """The result of :func:`nearest` in two passes over the vectors, in tasks of the files' own size.

    The first pass compares the questions with about ``sample_rows`` vectors, chosen by a hash of
    their ids, in a fixed number of tasks: the k-th distance found bounds the true one from
    above. The second pass hands on only what is within that bound, so about
    ``k x vectors / sample_rows`` rows of a question in all, however many tasks read them;
    these are cut to k in the tasks and again when they meet. Questions beyond the limit are taken in
    the groups of :func:`nearest`.
    """
    id_columns = id_columns or ["source_table", "source_id"]
    schema = result_schema(vectors, questions, question_id, id_columns)
    arrow_schema = to_arrow_schema(schema)
    vectors = vectors.select(*id_columns, vector)
    questions = questions.select(question_id, question_vector).where(F.col(question_vector).isNotNull())
    options = {"width": width, "question_id": question_id, "question_vector": question_vector}
    options |= {"id_columns": id_columns, "vector": vector}
    local = fits_broadcast(questions, width, limit_bytes)
    if local is None:
        return nearest(vectors, questions, k, limit_bytes=limit_bytes, **options)
    units = unit_rows(matrix_of(local[question_vector], width)[0])
    names = local[question_id].combine_chunks()
    shared = vectors.sparkSession.sparkContext.broadcast((units, names, np.full(len(units), np.inf)))

    def scan(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            units, names, limit = shared.value
            yield from scan_batches(batches, units, names, id_columns, vector, k, arrow_schema, limit)

        return run

    share = max(1, vectors.count() // sample_rows)
    sample = vectors.where(F.pmod(F.xxhash64(*id_columns), F.lit(share)) == 0).repartition(SAMPLE_TASKS, *id_columns)
    first = keep_best(sample.mapInArrow(scan(shared), schema), question_id, id_columns, k)
    # one row per question, and the questions fit the driver
    bounds = first.where(F.col("rank") == k).select(question_id, F.coalesce("distance", F.lit(_NULL)).alias("bound")).toArrow()
    bound = dict(zip(bounds[question_id].to_pylist(), bounds["bound"].to_numpy()))
    limit = np.array([bound.get(name, np.inf) for name in names.to_pylist()], dtype="float64")
    limit[np.isnan(limit)] = _NAN
    bounded = vectors.sparkSession.sparkContext.broadcast((units, names, limit))
    return keep_best(vectors.mapInArrow(scan(bounded), schema), question_id, id_columns, k)


def nearest_to(
    vectors: DataFrame,
    question: list[float],
    k: int = DEFAULT_TOP_K,
    *,
    id_columns: list[str] | None = None,
    vector: str = "embedding",
) -> DataFrame:
    """(record ids, distance): the k nearest records of one question vector, in order.

    Any filter put on ``vectors`` comes first, so k rows come back whenever k match.
    """
    id_columns = id_columns or ["source_table", "source_id"]
    units = unit_rows(np.asarray([question], dtype="float32").astype("float64"))
    schema = T.StructType([vectors.schema[c] for c in id_columns]).add("distance", "double")
    asked = T.StructType().add("_question", "integer")
    arrow_schema = to_arrow_schema(T.StructType([*asked.fields, *schema.fields]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array([0], pa.int32())
        for batch in scan_batches(batches, units, names, id_columns, vector, k, arrow_schema):
            yield batch.select(schema.names)

    best = vectors.select(*id_columns, vector).mapInArrow(scan, schema)
    return best.orderBy(F.col("distance").asc_nulls_last(), *id_columns).limit(k)


def fetch(
    best: DataFrame,
    records: DataFrame,
    keys: list[str],
    question_id: str = "question_id",
) -> DataFrame:
    """Bring the contents of the found records. What was found is stored, as the search is the
    dear part. Up to a checked size it is broadcast and the records are read in place; beyond
    it, one record may be the answer to very many questions, so its rows are spread."""
    best = write_and_reread(best, "found")
    if keys_fit_broadcast(best):
        return records.join(F.broadcast(best), keys)
    return skew_join(best, records, keys, salt_on=[question_id])
