"""Vectors as ``array<float>`` columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F, types as T


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0),
        lambda total, x: total + x,
    )


def check_width(vector: Column, width: int) -> Column:
    """The vector itself; a vector of any other width is an error, NULL stays NULL."""
    return F.when(vector.isNull() | (F.size(vector) == width), vector).otherwise(
        F.raise_error(F.format_string("expected %d dimensions, not %d", F.lit(width), F.size(vector)))
    )


def cosine_distance(a: Column, b: Column) -> Column:
    """``1 - cos(a, b)`` in double; NaN for a zero vector, NULL for a NULL one."""
    norms = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    distance = F.lit(1.0) - F.try_divide(_dot(a, b), norms)
    return F.when(a.isNotNull() & b.isNotNull(), F.coalesce(distance, F.lit(float("nan"))))


def vector_literal(vector: Column | str) -> Column:
    """``[0.1,-0.2]``"""
    vector = F.col(vector) if isinstance(vector, str) else vector
    parts = F.transform(vector, lambda x: x.cast("string"))
    return F.concat(F.lit("["), F.array_join(parts, ","), F.lit("]"))


def parse_vector(text: Column | str) -> Column:
    return F.from_json(text, "array<float>")


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a list column one after another, and the offsets of its rows."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    values = column.drop_null().flatten().to_numpy(zero_copy_only=False)
    return values, np.concatenate([[0], np.cumsum(sizes)]).astype("int32")


def _nulls(column: pa.Array) -> pa.Buffer:
    return pc.is_valid(column).buffers()[1] if column.null_count else None


@F.arrow_udf(T.BinaryType())
def to_half(vectors: pa.Array) -> pa.Array:
    """Two bytes per component, little endian."""
    values, offsets = _flat(vectors)
    halves = pa.py_buffer(values.astype("<f2"))
    return pa.Array.from_buffers(pa.binary(), len(vectors), [_nulls(vectors), pa.py_buffer(2 * offsets), halves])


@F.arrow_udf(T.ArrayType(T.FloatType()))
def from_half(packed: pa.Array) -> pa.Array:
    sizes = pc.fill_null(pc.binary_length(packed), 0).to_numpy(zero_copy_only=False)
    values = np.frombuffer(b"".join(packed.drop_null().to_pylist()), "<f2").astype("float32")
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype("int32") // 2
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values), mask=packed.is_null() if packed.null_count else None)
