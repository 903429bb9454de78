"""Texts of Arrow batches as arrays: blocks of bounded size, words, hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

BLOCK_BYTES = 2 << 20


def blocks(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches into runs of rows with about ``size`` bytes of text; a longer text is a run
    of its own. Null texts become empty ones."""
    for batch in batches:
        if not batch.num_rows:
            continue
        at = batch.schema.get_field_index(text)
        column = pc.fill_null(batch.column(at).cast(pa.large_string()), "")
        batch = batch.set_column(at, text, column)
        ends = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64))
        begin = 0
        while begin < batch.num_rows:
            done = ends[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, done + size, side="right")))
            yield batch.slice(begin, end - begin)
            begin = end


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a large_string column without nulls, and the n + 1 offsets of its rows."""
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    body = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return body[offsets[0] : offsets[-1]], offsets - offsets[0]


class Words:
    """The words of a block: ``codes`` into ``vocabulary``, ``offsets`` of the documents."""

    def __init__(self, codes: np.ndarray, vocabulary: list[bytes], offsets: np.ndarray):
        self.codes, self.vocabulary, self.offsets = codes, vocabulary, offsets

    @property
    def documents(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.offsets))


def _kept_bytes() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32  # A-Z
    for lo, hi in ((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)):
        inside = (table >= lo) & (table <= hi)
        table[inside] = 0x20
    return table


_ALPHANUMERIC = _kept_bytes()


def split_words(column: pa.Array, alphanumeric: bool = False, lower: bool = True) -> Words:
    """Words between white space (0x20, 0x09-0x0D) with A-Z in lower case; with
    ``alphanumeric``, runs of 0-9, a-z and all beyond ASCII instead."""
    if alphanumeric:
        body, offsets = raw(column)
        body = _ALPHANUMERIC[body]
        column = pa.LargeStringArray.from_buffers(len(column), pa.py_buffer(offsets), pa.py_buffer(body))
    elif lower:
        column = pc.ascii_lower(column)
    parts = pc.ascii_split_whitespace(column)
    flat = parts.flatten()
    counts = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum(counts)])
    full = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0  # white space at an end gives empty parts
    if not full.all():
        offsets = np.concatenate([[0], np.cumsum(full)])[offsets]
        flat = flat.filter(pa.array(full))
    encoded = flat.dictionary_encode()
    codes = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return Words(codes, encoded.dictionary.cast(pa.large_binary()).to_pylist(), offsets)


def word_hashes(vocabulary: list[bytes], seed: int = 0) -> np.ndarray:
    hashed = xxhash.xxh3_64_intdigest
    return np.fromiter((hashed(w, seed) for w in vocabulary), np.uint64, len(vocabulary))


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers: two rounds of multiply and shift."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0x9E6C63D0676A9A99)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(32))


def windows(hashes: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``length`` words inside documents, and where each begins."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = np.zeros(n, np.uint64)
    for i in range(length):
        out = mix(out + hashes[i : i + n] + np.uint64(i + 1))
    ends = np.repeat(offsets[1:], np.diff(offsets))  # of the document that holds each word
    begins = np.flatnonzero(np.arange(n) + length <= ends[:n])
    return out[begins], begins


def ids_of(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """An integer column as numbers and the mask of its nulls."""
    column = batch.column(batch.schema.get_field_index(name))
    nulls = column.is_null().to_numpy(zero_copy_only=False)
    return pc.fill_null(column, 0).to_numpy(zero_copy_only=False), nulls


def nullable(values: np.ndarray, nulls: np.ndarray, kind: pa.DataType = pa.int64()) -> pa.Array:
    return pa.array(values, kind, mask=np.asarray(nulls, bool))
