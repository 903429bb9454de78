"""Exact nearest records that leave out cells by their bounds.

Each cell has a centre and a radius, the largest distance of its unit vectors to the centre, and for
each filter column the values found in it, as long as they are few. By the triangle inequality no record of
a cell is nearer to a question than ``distance to the centre - radius``. A question reads its
cells in order of that bound, in waves that double, and stops once its k-th distance is
below the next bound. Cells without a wanted value are not read at all.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from caselens.operators.ivf import Cells, build_cells, scan_pairs, search_cells
from caselens.operators.topk import (
    MAX_BROADCAST_BYTES,
    MAX_CELLS,
    fits_broadcast,
    keep_best,
    matrix_of,
    result_schema,
    small_tables,
    unit_rows,
)
from caselens.schemas import DEFAULT_TOP_K
from caselens.scratch import write_and_reread

MAX_VALUES = 64  # of a filter column that are kept per cell
ROUNDING = 1e-8  # distances are rounded to nine decimals


@dataclass(frozen=True)
class BoundedCells:
    """Cells, their radii (-1 where no vector has a direction), and per filter column the values of each cell
    (None where they are too many). ``cells.id_columns`` are the ids and the filter columns."""

    cells: Cells
    id_columns: list[str]
    radii: np.ndarray
    present: np.ndarray
    values: dict[str, list[set | None]]


def build_bounded_cells(
    vectors: DataFrame,
    path: str,
    *,
    width: int,
    id_columns: list[str] | None = None,
    filters: list[str] | None = None,
    vector: str = "embedding",
    **options,
) -> BoundedCells:
    """Store the records by cell and take the bounds in one pass over what was stored: a row per
    cell comes to the driver, of as many cells as there are centres."""
    id_columns, filters = id_columns or ["source_table", "source_id"], filters or []
    cells = build_cells(vectors, path, width=width, id_columns=[*id_columns, *filters], vector=vector, **options)
    stored = cells.read(vectors.sparkSession)
    shared = vectors.sparkSession.sparkContext.broadcast(unit_rows(cells.centres))

    def farthest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        radii = np.full(len(shared.value), -1.0)
        for table in small_tables(batches, width):
            units = unit_rows(matrix_of(table[vector], width)[0])
            cell = table["cell"].to_numpy()
            distance = np.linalg.norm(units - shared.value[cell], axis=1)
            np.maximum.at(radii, cell, np.where(np.isnan(distance), -1.0, distance))
        number = np.flatnonzero(radii >= 0)
        yield pa.RecordBatch.from_arrays([pa.array(number.astype("int32")), pa.array(radii[number])], ["cell", "radius"])

    radii = np.full(len(cells.centres), -1.0)
    found = stored.select(vector, "cell").mapInArrow(farthest, "cell int, radius double")
    for row in found.groupBy("cell").agg(F.max("radius").alias("radius")).collect():
        radii[row["cell"]] = row["radius"]
    present = np.zeros(len(radii), bool)
    present[[r["cell"] for r in stored.select("cell").distinct().collect()]] = True
    values = {name: [set() for _ in radii] for name in filters}
    for name in filters:
        # the first values of each cell, one more than are kept: no list grows with the cell
        order = Window.partitionBy("cell").orderBy(name)
        few = stored.select("cell", name).distinct().withColumn("n", F.row_number().over(order)).where(F.col("n") <= MAX_VALUES + 1)
        for row in few.groupBy("cell").agg(F.collect_list(F.struct(name)).alias("v")).collect():
            found = {v[0] for v in row["v"]}
            values[name][row["cell"]] = found if len(found) <= MAX_VALUES else None
    return BoundedCells(cells, id_columns, radii, present, values)


def _open_cells(bounded: BoundedCells, wanted: dict[str, list]) -> np.ndarray:
    """Which cells may hold a record with the wanted values."""
    open_ = bounded.present.copy()
    for name, allowed in wanted.items():
        if name not in bounded.values:
            raise ValueError(f"the cells keep no values of {name}")
        known = bounded.values[name]
        open_ &= np.array([v is None or any(a in v for a in allowed) for v in known])
    return open_


def nearest_by_bounds(
    bounded: BoundedCells,
    questions: DataFrame,
    k: int = DEFAULT_TOP_K,
    wanted: dict[str, list] | None = None,
    *,
    question_id: str = "question_id",
    question_vector: str = "embedding",
    first_cells: int = 2,
    limit_bytes: int = MAX_BROADCAST_BYTES,
) -> DataFrame:
    """The exact k nearest records of each question, among those with one of the ``wanted`` values of
    each filter column. The columns of :func:`caselens.operators.topk.nearest`. A question without
    a vector finds nothing.

    Questions within ``limit_bytes`` are sent to every executor, and after each wave their k-th
    distances come to the driver. More than that, or than have ``MAX_CELLS`` bounds in all, are dealt
    to tasks in bounded groups, which read the cells in order of their mean bounds.
    """
    spark, cells, wanted = questions.sparkSession, bounded.cells, wanted or {}
    width, ids = cells.centres.shape[1], bounded.id_columns
    stored = cells.read(spark)
    for name, allowed in wanted.items():
        stored = stored.where(F.col(name).isin(list(allowed)))
    schema = result_schema(stored, questions, question_id, cells.id_columns)
    questions = questions.select(question_id, question_vector).where(F.col(question_vector).isNotNull())
    numbers = np.flatnonzero(_open_cells(bounded, wanted))
    centres, radii = unit_rows(cells.centres[numbers]), bounded.radii[numbers]

    def bounds_of(units: np.ndarray) -> np.ndarray:
        """The least cosine distances (questions x cells): half the square; a question or cell without
        a direction has no near side."""
        away = np.sqrt(np.maximum(2 - 2 * (units @ centres.T), 0)) - radii
        return np.where(radii >= 0, np.nan_to_num(np.maximum(away, 0) ** 2 / 2, nan=0.0), 2.0)

    local = fits_broadcast(questions, width, min(limit_bytes, MAX_CELLS // max(1, len(numbers)) * 8 * width))
    if local is None:
        at = np.zeros(len(cells.centres), np.int64)
        at[numbers] = np.arange(len(numbers))

        def plan(units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            least = bounds_of(units)
            return numbers[np.argsort(least.mean(axis=0), kind="stable")], least

        def asked(least: np.ndarray, cell: int, limit: np.ndarray) -> np.ndarray:
            # a distance that is NaN or NULL comes after all others: then every cell may still do better
            return (least[:, at[cell]] - ROUNDING <= limit) | (limit > 2.5)

        found = search_cells(cells, cells.read(spark), questions, question_id, question_vector, k, schema, plan, asked, wanted)
        return keep_best(found, question_id, ids, k).select(question_id, *ids, "distance", "rank")
    units, names = unit_rows(matrix_of(local[question_vector], width)[0]), local[question_id].combine_chunks()
    least = bounds_of(units)
    order = np.argsort(least, axis=1, kind="stable")
    sorted_least = np.take_along_axis(least, order, 1)

    best = spark.createDataFrame([], schema)
    limit, done, wave = np.full(len(units), np.inf), 0, first_cells
    while done < len(numbers) and len(units):
        part = slice(done, done + wave)
        asks = sorted_least[:, part] - ROUNDING <= limit[:, None]
        if not asks.any():
            break  # bounds only grow, so no later cell is asked for
        who, place = np.nonzero(asks)
        cell = numbers[order[:, part][who, place]]
        by = np.argsort(cell, kind="stable")
        found = scan_pairs(cells, stored, units, names, cell[by], who[by], k, schema, limit)
        best = write_and_reread(keep_best(best.unionByName(found), question_id, ids, k).drop("rank"), "nearest")
        kth = best.groupBy(question_id).agg(F.count(F.lit(1)).alias("n"), F.max(F.coalesce("distance", F.lit(4.0))).alias("d"))
        kth = kth.where(F.col("n") >= k).toArrow()  # a row per question
        known = dict(zip(kth[question_id].to_pylist(), kth["d"].to_numpy()))
        # a distance that is NaN or NULL comes after all others: then every cell may still do better
        limit = np.array([known.get(n, np.inf) for n in names.to_pylist()], dtype="float64")
        limit = np.where(np.isnan(limit) | (limit > 2.5), np.inf, limit)
        done, wave = done + wave, 2 * wave
    return keep_best(best, question_id, ids, k).select(question_id, *ids, "distance", "rank")
