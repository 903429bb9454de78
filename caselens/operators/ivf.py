"""Approximate nearest records.

``build_cells`` groups unit vectors around k-means centres and stores each cell in its
own folder; a question reads only the cells whose centres are nearest to it. Probing all
cells gives the exact result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import BucketedRandomProjectionLSH, Normalizer
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from caselens.operators.topk import (
    MAX_BROADCAST_BYTES,
    MAX_CELLS,
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


@dataclass(frozen=True)
class Cells:
    """Where the cells are stored, and their centres (n_cells x width)."""

    path: str
    centres: np.ndarray
    schema: T.StructType
    id_columns: list[str]
    vector: str

    def read(self, spark) -> DataFrame:
        return spark.read.schema(self.schema).parquet(self.path)


def _nearest_cells(units: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    """The numbers of the n nearest centres of each row, nearest first; blocks of rows keep the
    matrix of scores small."""
    centre_units = unit_rows(centres)
    step = max(1, MAX_CELLS // len(centres))
    out = np.empty((len(units), n), "int64")
    for at in range(0, len(units), step):
        scores = np.nan_to_num(units[at : at + step] @ centre_units.T, nan=-2.0)
        if n == 1:
            out[at : at + step, 0] = scores.argmax(axis=1)
        else:
            out[at : at + step] = np.argsort(-scores, axis=1, kind="stable")[:, :n]
    return out


def default_cells(n_vectors: int, width: int) -> int:
    """About the root of the number of vectors, as far as the centres can be sent to all tasks."""
    return int(max(1, min(math.isqrt(max(1, n_vectors)), MAX_BROADCAST_BYTES // (8 * width))))


def fit_centres(
    vectors: DataFrame, n_cells: int, seed: int = 0, max_iter: int = 10, vector: str = "embedding"
) -> np.ndarray:
    """k-means centres of all unit vectors, fitted by Spark's distributed k-means."""
    known = vectors.where(F.col(vector).isNotNull())
    units = Normalizer(inputCol="_raw", outputCol="_unit", p=2.0).transform(
        known.select(array_to_vector(vector).alias("_raw"))
    )
    fitted = KMeans(k=n_cells, seed=seed, maxIter=max_iter, featuresCol="_unit").fit(units.select("_unit"))
    return np.array(fitted.clusterCenters())


def build_cells(
    vectors: DataFrame,
    path: str,
    *,
    width: int,
    n_cells: int | None = None,
    seed: int = 0,
    max_iter: int = 10,
    id_columns: list[str] | None = None,
    vector: str = "embedding",
    centres: np.ndarray | None = None,
) -> Cells:
    """Store all vectors by the nearest of the ``centres``, which are fitted if not given, by
    default as many as the root of the number of vectors.

    Spark splits a cell that holds most vectors over several writers and lets small cells
    share one.
    """
    id_columns = id_columns or ["source_table", "source_id"]
    if centres is None:
        n_cells = n_cells or default_cells(vectors.count(), width)
        centres = fit_centres(vectors, n_cells, seed, max_iter, vector)
    if centres.shape[1] != width or centres.nbytes > MAX_BROADCAST_BYTES:
        raise ValueError("the centres have another width, or are too many to hold")
    shared = vectors.sparkSession.sparkContext.broadcast(centres)
    schema = T.StructType(
        [*[vectors.schema[c] for c in [*id_columns, vector]], T.StructField("cell", T.IntegerType())]
    )
    arrow_schema = to_arrow_schema(schema)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in small_tables(batches, width):
            matrix, _ = matrix_of(table[vector], width)
            cell = _nearest_cells(unit_rows(matrix), shared.value, 1)[:, 0]
            table = table.append_column("cell", pa.array(cell.astype("int32"))).cast(arrow_schema)
            yield from table.to_batches()

    assigned = vectors.select(*id_columns, vector).mapInArrow(assign, schema)
    assigned.hint("rebalance", "cell").write.mode("overwrite").partitionBy("cell").parquet(path)
    return Cells(path, centres, schema, id_columns, vector)


def nearest_in_cells(
    cells: Cells,
    questions: DataFrame,
    k: int = DEFAULT_TOP_K,
    n_probe: int = 4,
    *,
    question_id: str = "question_id",
    question_vector: str = "embedding",
    limit_bytes: int = MAX_BROADCAST_BYTES,
    grid_rows: int | None = None,
) -> DataFrame:
    """The k nearest records of each question among its ``n_probe`` nearest cells. A question
    without a vector finds nothing.

    Cells no question asks for are not read; within a cell only the questions that probe
    it are scored. Questions beyond ``limit_bytes``, or that probe more cells in all than ``MAX_CELLS``,
    are dealt to tasks in bounded groups; a cell passes a group in blocks of ``grid_rows``.
    """
    spark = questions.sparkSession
    width = cells.centres.shape[1]
    n_probe = min(n_probe, len(cells.centres))
    ids = cells.id_columns
    stored = cells.read(spark)
    schema = result_schema(stored, questions, question_id, ids)
    questions = questions.select(question_id, question_vector).where(F.col(question_vector).isNotNull())
    local = fits_broadcast(questions, width, min(limit_bytes, MAX_CELLS // n_probe * 8 * width))
    if local is None:

        def probed(units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            asks = np.zeros((len(cells.centres), len(units)), bool)
            asks[_nearest_cells(units, cells.centres, n_probe).T, np.arange(len(units))] = True
            return np.flatnonzero(asks.any(axis=1)), asks

        def asked(place: np.ndarray, cell: int, limit: np.ndarray) -> np.ndarray:
            return place[cell]

        candidates = search_cells(cells, stored, questions, question_id, question_vector, k, schema, probed, asked, grid_rows=grid_rows)
        return keep_best(candidates, question_id, ids, k)
    units = unit_rows(matrix_of(local[question_vector], width)[0])
    # (cell, question) in order of the cells: who asks a cell is a slice of the second
    pairs = _nearest_cells(units, cells.centres, n_probe)
    order = np.argsort(pairs, axis=None, kind="stable")
    cell_of, who = pairs.ravel()[order], order // n_probe
    found = scan_pairs(cells, stored, units, local[question_id].combine_chunks(), cell_of, who, k, schema)
    return keep_best(found, question_id, ids, k)


def scan_pairs(
    cells: Cells,
    stored: DataFrame,
    units: np.ndarray,
    names: pa.Array,
    cell_of: np.ndarray,
    who: np.ndarray,
    k: int,
    schema: T.StructType,
    limit: np.ndarray | None = None,
) -> DataFrame:
    """The k best of each question in the tasks that read the cells it asks: question ``who[i]``
    asks ``cell_of[i]``, in order of the cells. Nothing beyond a question's ``limit`` is handed on."""
    spark, ids, vector = stored.sparkSession, cells.id_columns, cells.vector
    width, arrow_schema = cells.centres.shape[1], to_arrow_schema(schema)
    shared = spark.sparkContext.broadcast((units, names, cell_of, who, limit))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        question_units, names, cell_of, who, limit = shared.value
        best = BestPerQuestion(len(question_units), ids, k, limit)
        for table in small_tables(batches, width):
            table = table.sort_by([(c, "ascending") for c in ids])
            rows, valid = matrix_of(table[vector], width)
            rows, cell = unit_rows(rows), table["cell"].to_numpy()
            for number in np.unique(cell):
                inside = np.flatnonzero(cell == number)
                own = table.select(ids).take(pa.array(inside))
                asked = who[np.searchsorted(cell_of, number) : np.searchsorted(cell_of, number, side="right")]
                best.offer_vectors(own, rows[inside], valid[inside], question_units[asked], asked)
        found = best.result()
        if found is not None:
            yield from finish(found, names, arrow_schema)

    probed = stored.where(F.col("cell").isin(np.unique(cell_of).tolist()))
    return probed.coalesce(TASKS_PER_CORE * spark.sparkContext.defaultParallelism).mapInArrow(scan, schema)


def search_cells(cells: Cells, stored: DataFrame, questions, question_id, question_vector, k, schema, plan, asked, wanted=None, grid_rows=None) -> DataFrame:
    """The k best of each question, in groups of questions that read the stored cells. ``plan`` gives of a
    group's unit vectors the cells to read, in order, and what ``asked`` needs to tell which of the questions
    want a cell, given their limits so far. Rows without a ``wanted`` value of a column are left out."""
    width, ids, vector = cells.centres.shape[1], cells.id_columns, cells.vector
    blocks, arrow_schema = blocks_of(stored, width, grid_rows), to_arrow_schema(schema)
    files: dict[int, list[str]] = {}
    for path in blocks.paths:
        files.setdefault(int(re.search(r"/cell=(\d+)/", path).group(1)), []).append(path)
    allowed = {c: [v for v in values if v is not None] for c, values in (wanted or {}).items()}

    def search(units: np.ndarray, names: pa.Array) -> Iterator[pa.RecordBatch]:
        best = BestPerQuestion(len(units), ids, k)
        order, state = plan(units)
        for cell in order.tolist():
            who = np.flatnonzero(asked(state, cell, best.limit))
            if cell not in files or not len(who):
                continue
            asking = units if len(who) == len(units) else units[who]
            for table in blocks.read([*ids, vector], files[cell]):
                for c, values in allowed.items():
                    table = table.filter(pc.is_in(table[c], value_set=pa.array(values, table[c].type)))
                table = table.sort_by([(c, "ascending") for c in ids])
                rows, present = matrix_of(table[vector], width)
                best.offer_vectors(table.select(ids), unit_rows(rows), present, asking, who)
        found = best.result()
        if found is not None:
            yield from finish(found, names, arrow_schema)

    return in_groups(questions, question_id, question_vector, width, k, search, schema, 2 * len(cells.centres))


def nearest_by_hashing(
    vectors: DataFrame,
    question: list[float],
    k: int = DEFAULT_TOP_K,
    *,
    id_columns: list[str] | None = None,
    vector: str = "embedding",
    bucket_length: float = 0.5,
    n_tables: int = 5,
    seed: int = 0,
) -> DataFrame:
    """About k nearest records of one question, by random-projection hashing on unit
    vectors; the distance is the cosine distance."""
    id_columns = id_columns or ["source_table", "source_id"]
    rows = vectors.where(F.col(vector).isNotNull()).select(*id_columns, array_to_vector(vector).alias("_raw"))
    units = Normalizer(inputCol="_raw", outputCol="_unit", p=2.0).transform(rows)
    hashing = BucketedRandomProjectionLSH(
        inputCol="_unit", outputCol="_hashes", bucketLength=bucket_length, numHashTables=n_tables, seed=seed
    )
    asked = np.asarray(question, dtype="float64")
    asked = Vectors.dense(asked / np.linalg.norm(asked))
    found = hashing.fit(units).approxNearestNeighbors(units, asked, k, distCol="_euclidean")
    # for unit vectors, squared Euclidean distance is twice the cosine distance
    return found.select(
        *id_columns, F.round(F.col("_euclidean") * F.col("_euclidean") / 2, 9).alias("distance")
    )
