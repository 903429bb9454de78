"""Vector codes: product codebooks fitted by k-means over all rows with adaptive distance bounds.

Components become integers, ``floor(1024 * x)``, and a vector is cut into equal consecutive
parts, each with a codebook. A round assigns every part to the nearest entry and replaces the
entries by the floored means. What a round learns of a part is written beside it: its ``b``
closest entries in order of distance, a lower bound of the distance to each of them and one
outer bound for all other entries, and an upper bound of the distance to its own entry. The
next round widens the bounds by how far the entries moved. Where the upper bound stays below
the first lower bound the part keeps its entry without a look at the codebook; else the
leading entries of the list that the bounds cannot rule out are compared, and only where the
outer bound fails as well, all of them. Comparisons are of whole numbers, bounds are rounded
outwards, so the result is that of comparing everything. ``b`` shrinks to what the parts of
the round before needed.

The driver holds the codebooks (parts x entries x width numbers) and the sums that make the
next ones, added up by Spark from one row per task, part and entry. Rows stay in written
tables; a table is removed once the next one stands.

Defined results: a null or empty vector and one with a null or non-finite component is dropped.
Null ids come after all others; rows with the same id are ordered by their components, and each
is a row of its own. With fewer rows than entries the codebooks are that much shorter. Vectors
of different widths, a width that the parts do not divide, and components so large that a
squared distance and an entry's number no longer fit 64 bits (above 23,000 for parts of 16
components) are errors. Equal labels share their error sum, nulls
count as one label. Other columns are not read. No rows give an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

from caselens.operators.skew import fits_broadcast
from caselens.scratch import remove, scratch_path, write_and_reread

ENTRIES, PARTS, ROUNDS, SCALE = 256, 4, 4, 1024
BOUNDS, LEAST_BOUNDS = 16, 4  # closest entries kept per part, at first and at least
ENOUGH = 0.98  # share of the open parts whose need the next list covers
EXACT = float(1 << 53)
SLACK = 1e-9  # for rounding in the comparison of bounds
BLOCK = 4096  # rows of a batch that are compared at once


def kept_vectors(vectors: DataFrame, id_column: str, vector_column: str, *others: str) -> DataFrame:
    """(vec_id, v, others) of the rows whose vector is there, not empty and finite."""
    v = F.col(vector_column).cast("array<double>")
    rows = vectors.select(F.col(id_column).alias("vec_id"), v.alias("v"), *others)
    finite = F.forall("v", lambda x: F.coalesce((x > float("-inf")) & (x < float("inf")), F.lit(False)))
    return rows.where(F.col("v").isNotNull() & (F.size("v") > 0) & finite)


@dataclass
class Bounds:
    """Of n parts: list of closest entries, lower bounds of places 1.. and of all others, upper bound."""

    near: np.ndarray  # n x b
    lower: np.ndarray  # n x b: of list places 1 to b - 1, then of what is not listed
    upper: np.ndarray  # n


def largest(w: int) -> int:
    """Integer components of parts of ``w`` stay below, so distance * ENTRIES + entry fits 64 bits."""
    return math.isqrt((1 << 63) // (4 * ENTRIES * w)) - 1


def _integer_parts(v: np.ndarray, w: int) -> np.ndarray:
    x = np.floor(v * SCALE)
    if np.abs(x).max(initial=0) >= largest(w):
        raise ValueError(f"components of {largest(w) // SCALE} or more: distances would leave 64 bits")
    return x.astype(np.int64)


def squared(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances of all rows to all entries, as whole numbers."""
    top = float(max(np.abs(x).max(initial=0), np.abs(book).max(initial=0)))
    if 4 * top * top * x.shape[1] < EXACT:  # every step below is exact in doubles
        a, b = x.astype(np.float64), book.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    return np.stack([((x - entry) ** 2).sum(1) for entry in book], 1)


def listed(x: np.ndarray, book: np.ndarray, length: int) -> tuple[Bounds, np.ndarray]:
    """Compare with all entries: the bounds, and the squared distance to the nearest one."""
    keys = squared(x, book) * ENTRIES + np.arange(len(book))
    length = min(length, len(book))
    if length < len(book):
        keys = np.partition(keys, length, 1)[:, : length + 1]
    keys = np.sort(keys, 1)
    distances = np.sqrt((keys // ENTRIES).astype(np.float64))
    outer = distances[:, length:] if length < len(book) else np.full((len(x), 1), np.inf)
    near = (keys[:, :length] % ENTRIES).astype(np.uint8)
    return Bounds(near, np.hstack([distances[:, 1:length], outer]), distances[:, 0]), keys[:, 0] // ENTRIES


def _need(upper: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """How many leading entries of its list a part has to be compared with: 1 if its own stays,
    one more than the list is long if all entries are possible."""
    ruled_out = upper[:, None] * (1 + SLACK) + SLACK < lower
    return np.where(ruled_out.any(1), ruled_out.argmax(1) + 1, lower.shape[1] + 1)


def moved(state: Bounds, drift: np.ndarray) -> Bounds:
    """The bounds after the entries moved by at most ``drift``."""
    lower = state.lower.copy()
    lower[:, :-1] -= drift[state.near[:, 1:]]
    lower[:, -1] -= drift.max()
    lower = np.minimum.accumulate(lower[:, ::-1], 1)[:, ::-1]  # place z now bounds all from z on
    return Bounds(state.near, lower * (1 - SLACK), (state.upper + drift[state.near[:, 0]]) * (1 + SLACK))


def reassigned(x: np.ndarray, book: np.ndarray, state: Bounds, drift: np.ndarray) -> tuple[Bounds, np.ndarray]:
    """The bounds for the entries as they are now, and how many entries each part needed."""
    state = moved(state, drift)
    near, lower, upper = state.near.copy(), state.lower.copy(), state.upper.copy()
    length = near.shape[1]
    need = _need(upper, lower)
    open_ = np.flatnonzero(need > 1)
    if len(open_):
        own = ((x[open_] - book[near[open_, 0]]) ** 2).sum(1)
        upper[open_] = np.sqrt(own.astype(np.float64))
        need[open_] = _need(upper[open_], lower[open_])
    some = np.flatnonzero((need > 1) & (need <= length))
    if len(some):
        reach = int(need[some].max())
        entries = near[some, :reach]
        places = np.arange(reach)
        distances = ((x[some][:, None] - book[entries]) ** 2).sum(2)
        compared = places < need[some][:, None]
        keys = np.where(compared, distances * ENTRIES + entries, np.iinfo(np.int64).max - reach + places)
        order = np.argsort(keys, 1, kind="stable")
        near[some, :reach] = np.take_along_axis(entries, order, 1)
        exact = np.sqrt(np.take_along_axis(distances, order, 1).astype(np.float64))
        upper[some] = exact[:, 0]
        bounds = np.where(compared[:, 1:], exact[:, 1:], lower[some, : reach - 1])
        lower[some, : reach - 1] = bounds
    every = np.flatnonzero(need > length)
    if len(every):
        fresh, _ = listed(x[every], book, length)
        near[every], lower[every], upper[every] = fresh.near, fresh.lower, fresh.upper
    return Bounds(near, lower, upper), need


def shortened(state: Bounds, length: int) -> Bounds:
    if length >= state.near.shape[1]:
        return state
    lower = state.lower[:, :length].copy()
    lower[:, -1] = state.lower[:, length - 1 :].min(1)
    return Bounds(state.near[:, :length], lower, state.upper)


def _matrix(batch: pa.RecordBatch, name: str, width: int) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index(name))
    flat = column.flatten().to_numpy(zero_copy_only=False)
    sizes = np.diff(column.offsets.to_numpy())
    if (sizes != width).any():
        raise ValueError(f"vectors of {sorted({*sizes.tolist(), width})} components in one table")
    return flat.reshape(len(column), width)


def _binary(rows: np.ndarray) -> pa.Array:
    rows = np.ascontiguousarray(rows)
    step = rows.itemsize * rows.shape[1]
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * step
    return pa.BinaryArray.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(rows)])


def _of_binary(batch: pa.RecordBatch, name: str, kind: type, shape: tuple[int, ...]) -> np.ndarray:
    values = batch.column(batch.schema.get_field_index(name)).to_pylist()
    return np.frombuffer(b"".join(values), kind).reshape(len(values), *shape)


def _down(values: np.ndarray) -> np.ndarray:
    """Halves not above ``values``; a bound below 0 or beyond all halves is as good."""
    clipped = np.clip(values, 0, 65504)
    halves = clipped.astype(np.float16)
    above = halves.astype(np.float64) > clipped
    return np.where(above, np.nextafter(halves, np.float16(-1)), halves).astype(np.float16)


def _up(values: np.ndarray) -> np.ndarray:
    return np.nextafter(values.astype(np.float32), np.float32(np.inf))


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for begin in range(0, batch.num_rows, BLOCK):
            yield batch.slice(begin, BLOCK)


def _state_columns(states: list[Bounds], needs: list[np.ndarray]) -> list[pa.Array]:
    return [
        _binary(np.hstack([s.near for s in states])),
        _binary(np.hstack([_down(s.lower) for s in states])),
        _binary(np.stack([_up(s.upper) for s in states], 1)),
        _binary(np.stack([n.astype(np.uint16) for n in needs], 1)),
    ]


STATE = "near binary, lower binary, upper binary, need binary"


def _part(x: np.ndarray, p: int, parts: int) -> np.ndarray:
    w = x.shape[1] // parts
    return x[:, p * w : (p + 1) * w]


def _first(books: np.ndarray, length: int):
    """Integers and first bounds of the kept rows."""
    parts, _, w = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sliced(batches):
            x = _integer_parts(_matrix(batch, "v", parts * w), w)
            states = [listed(_part(x, p, parts), books[p], length)[0] for p in range(parts)]
            needs = [np.full(len(x), books.shape[1])] * parts
            xs = pa.ListArray.from_arrays(
                pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel().astype(np.int32))
            )
            named = [batch.column(batch.schema.get_field_index(c)) for c in ("vec_id", "label")]
            yield pa.RecordBatch.from_arrays([*named, xs, *_state_columns(states, needs)], ["vec_id", "label", "x", *_names()])

    return run


def _names() -> list[str]:
    return [c.split()[0] for c in STATE.split(", ")]


def _read_states(batch: pa.RecordBatch, parts: int, length: int) -> list[Bounds]:
    near = _of_binary(batch, "near", np.uint8, (parts, length))
    lower = _of_binary(batch, "lower", np.float16, (parts, length)).astype(np.float64)
    upper = _of_binary(batch, "upper", np.float32, (parts,)).astype(np.float64)
    return [Bounds(near[:, p], lower[:, p], upper[:, p]) for p in range(parts)]


def _next(books: np.ndarray, drift: np.ndarray, length: int, new_length: int):
    """The bounds of the next round."""
    parts, _, w = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sliced(batches):
            x = _matrix(batch, "x", parts * w).astype(np.int64)
            states, needs = [], []
            for p, state in enumerate(_read_states(batch, parts, length)):
                state, need = reassigned(_part(x, p, parts), books[p], state, drift[p])
                states.append(shortened(state, new_length))
                needs.append(need)
            named = [batch.column(batch.schema.get_field_index(c)) for c in ("vec_id", "label", "x")]
            yield pa.RecordBatch.from_arrays([*named, *_state_columns(states, needs)], ["vec_id", "label", "x", *_names()])

    return run


def _last(books: np.ndarray, drift: np.ndarray, length: int):
    """Codes and errors for the final entries."""
    parts, _, w = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sliced(batches):
            x = _matrix(batch, "x", parts * w).astype(np.int64)
            codes, error = [], np.zeros(len(x), np.int64)
            for p, state in enumerate(_read_states(batch, parts, length)):
                part = _part(x, p, parts)
                own = reassigned(part, books[p], state, drift[p])[0].near[:, 0]
                codes.append(own)
                error += ((part - books[p][own]) ** 2).sum(1)
            code = [row.tobytes().hex() for row in np.stack(codes, 1).astype(np.uint8)]
            named = [batch.column(batch.schema.get_field_index(c)) for c in ("vec_id", "label")]
            columns = [*named, pa.array(code, pa.string()), pa.array(error)]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "code", "error"])

    return run


def _sums(parts: int, entries: int, w: int, length: int):
    """Per task, one row for each part and entry in use: number and sum of its parts, and one
    with a histogram of the needs (part -1, entry = need)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((parts, entries, w), np.int64), np.zeros((parts, entries), np.int64)
        needs = np.zeros(ENTRIES + 2, np.int64)
        for batch in _sliced(batches):
            x = _matrix(batch, "x", parts * w).astype(np.int64)
            own = _of_binary(batch, "near", np.uint8, (parts, length))[:, :, 0]
            needs += np.bincount(_of_binary(batch, "need", np.uint16, (parts,)).ravel(), minlength=len(needs))
            for p in range(parts):
                np.add.at(total[p], own[:, p], _part(x, p, parts))
                count[p] += np.bincount(own[:, p], minlength=entries)
        p, e = np.nonzero(count)
        n = np.flatnonzero(needs)
        sums = [*total[p, e].tolist(), *[[0] * w] * len(n)]
        columns = [
            pa.array([*p.tolist(), *[-1] * len(n)], pa.int32()),
            pa.array([*e.tolist(), *n.tolist()], pa.int32()),
            pa.array([*count[p, e].tolist(), *needs[n].tolist()], pa.int64()),
            pa.array(sums, pa.list_(pa.int64())),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["part", "entry", "n", "total"])

    return run


def next_books(books: np.ndarray, state: DataFrame, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The entries after a round, and the histogram of needs. At most parts x entries rows and
    the histogram come to the driver."""
    parts, entries, w = books.shape
    partial = state.select("x", "near", "need").mapInArrow(
        _sums(parts, entries, w, length), "part int, entry int, n bigint, total array<bigint>"
    )
    added = partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("total")[i]).alias(f"s{i}") for i in range(w)])
    out, needs = books.copy(), np.zeros(ENTRIES + 2, np.int64)
    for row in added.collect():
        if row["part"] < 0:
            needs[row["entry"]] = row["n"]
        else:
            out[row["part"], row["entry"]] = [row[f"s{i}"] // row["n"] for i in range(w)]
    return out, needs


def adapted(length: int, needs: np.ndarray) -> int:
    """The list length that covers nearly all parts that needed more than their own entry."""
    open_ = needs[2:]
    if not open_.sum():
        return min(length, LEAST_BOUNDS)
    covered = int(np.searchsorted(np.cumsum(open_), ENOUGH * open_.sum())) + 2
    return min(length, max(LEAST_BOUNDS, covered))


def _drift(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    return np.sqrt(((new - old) ** 2).sum(-1).astype(np.float64)) * (1 + SLACK)


def fit_and_encode(
    vectors: DataFrame,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    label_column: str = "label",
    *,
    entries: int = ENTRIES,
    parts: int = PARTS,
    rounds: int = ROUNDS,
    bounds: int = BOUNDS,
) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error) per kept row, stored, and the codebooks (parts, entries, width)."""
    if not 1 <= entries <= ENTRIES:
        raise ValueError(f"between 1 and {ENTRIES} entries fit a byte")
    spark = vectors.sparkSession
    kept = kept_vectors(vectors, id_column, vector_column, F.col(label_column).alias("label"))
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    named = StructType([kept.schema["vec_id"], kept.schema["label"]])
    result_schema = StructType(list(named.fields)).add("code", "string").add("error", "long")
    if not first:
        return spark.createDataFrame([], result_schema), np.zeros((parts, 0, 0), np.int64)
    width = len(first[0][0])
    if width % parts or any(len(r[0]) != width for r in first):
        raise ValueError(f"vectors need one width that {parts} divides")
    start = _integer_parts(np.array([r[0] for r in first]), width // parts)
    books = start.reshape(len(first), parts, width // parts).transpose(1, 0, 2).copy()
    length = min(bounds, len(first))

    schema = StructType(list(named.fields)).add("x", ArrayType(IntegerType()))
    for column in STATE.split(", "):
        schema = schema.add(column.split()[0], "binary")

    def stored(state: DataFrame) -> tuple[DataFrame, str]:
        path = scratch_path(spark, "vector-codes")
        state.write.mode("overwrite").parquet(path)
        return spark.read.schema(schema).parquet(path), path

    state, path = stored(kept.select("vec_id", "label", "v").mapInArrow(_first(books, length), schema))
    for i in range(rounds):
        renewed, needs = next_books(books, state, length)
        drift, books = _drift(books, renewed), renewed
        if i == rounds - 1:
            break
        shorter = adapted(length, needs) if i else length  # the first round compares everything
        after, new_path = stored(state.mapInArrow(_next(books, drift, length, shorter), schema))
        remove(spark, path)
        state, path, length = after, new_path, shorter
    if not rounds:
        drift = np.zeros(books.shape[:2])
    return write_and_reread(state.mapInArrow(_last(books, drift, length), result_schema), "codes"), books


def books_text(books: np.ndarray) -> str:
    return ",".join(map(str, books.ravel().tolist()))


def digest(codes: DataFrame, books: np.ndarray) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of :func:`fit_and_encode`."""
    by_label = write_and_reread(codes.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "label-errors")
    side = F.broadcast(by_label) if fits_broadcast(by_label) else by_label
    hashed = hashlib.sha256(books_text(books).encode()).hexdigest()
    return codes.join(side, F.col("label").eqNullSafe(F.col("of")), "left").select(
        "vec_id", "code", "error", "label_error", F.lit(hashed).alias("codebooks_sha256")
    )
