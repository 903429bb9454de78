"""Token ids in Arrow stream files of equal-length sequences and masks.

Documents in id order are dealt by ranges, each range is one file. A file is an Arrow stream
whose batches hold fixed-size lists: ``ids`` and ``mask`` (true where there is a token), so
sequence i of a mapped file is a view of its bytes and nothing is copied. Ids take 16 bits
where the vocabulary allows, else 32. Documents follow one another across sequences; beside
each sequence stand the documents that end in it and where. Only the last sequence of a file
is padded.

A task writes its file under a name of its own and reports it in a row; the rows that Spark
commits are the manifest, so a task that runs again leaves at most a file that no one reads.

Defined results: a null text is an empty one and gives only the end id; null ids come first;
rows that repeat an id are ordered by a hash of their text; other columns are not read; an
empty table gives an empty manifest.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, Window, functions as F

from caselens.llm import texts
from caselens.scratch import scratch_path, write_and_reread

LENGTH = 2048
END = 2
MANIFEST = "file string, first_doc bigint, n_docs bigint, n_tokens bigint"
MOST_CACHED = 100_000  # of each of two generations; with both a worker holds about 30 MB

#: ASCII punctuation apart from the apostrophe, which the tokenizer may cut differently.
_MARKS = "".join(map(chr, [*range(0x21, 0x27), *range(0x28, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]))
#: A run of ASCII or of Latin-1 letters too, and the usual word: such a run, then punctuation.
_LETTERS = "^(?:[A-Za-z]|[\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff])+"
_PLAIN = _LETTERS + "[" + re.escape(_MARKS) + "]*$"


def _byte_letters() -> dict[int, int]:
    """The printable characters that stand for bytes in a byte-level vocabulary: a byte that is
    no visible Latin-1 character gets the next one from 256 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in visible]
    return {b: 256 + i for i, b in enumerate(hidden)}


class _Kept(dict):
    """What was computed of the keys, as long as they are not too many; then what has not been
    asked for since the last such time is forgotten."""

    def __init__(self, compute):
        super().__init__()
        self.compute, self.older = compute, {}

    def __missing__(self, key):
        if len(self) >= MOST_CACHED:
            self.older = dict(self)
            self.clear()
        value = self.older.get(key)
        self[key] = value = self.compute(key) if value is None else value
        return value


def _gathered(flat: np.ndarray, counts: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of ``flat`` that ``codes`` name, one after another, and their lengths."""
    firsts = np.cumsum(counts) - counts
    lengths = counts[codes]
    ends = np.cumsum(lengths)
    at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(firsts[codes] - ends + lengths, lengths)
    return flat[at], lengths


class Encoder:
    """Whole texts to ids. Words between white space are encoded on their own, which gives
    the same ids. The usual word, letters and then punctuation, is cut in two: the letters
    in lower case go to the model and are kept for the next time, whatever follows
    them; the punctuation and any other word go through the whole tokenizer."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.letters = _byte_letters()
        self.bodies, self.marks = _Kept(self._body), _Kept(lambda marks: self._whole([marks])[0])
        self.others: dict[str, bytes] = {}
        self.plain = True
        words = ["Señor", "Ça.", "größer", "thouinan,"]
        self.plain = all(self._words(pa.array([w]))[0].tobytes() == self._whole([w])[0] for w in words)

    def _whole(self, words: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch(words, add_special_tokens=False)
        return [np.array(e.ids, self.kind).tobytes() for e in found]

    def _body(self, lower: str) -> bytes:
        if not lower.isascii():
            lower = lower.encode().decode("latin-1").translate(self.letters)
        return np.array([t.id for t in self.tokenizer.model.tokenize(lower)], self.kind).tobytes()

    def _other(self, words: list[str]) -> list[bytes]:
        known = self.others
        if len(known) > MOST_CACHED:
            known.clear()
        new = [w for w in words if w not in known]
        for begin in range(0, len(new), 1024):
            part = new[begin : begin + 1024]
            known.update(zip(part, self._whole(part)))
        found = [known[w] for w in words]
        for w in new:
            if len(w) >= 64:
                del known[w]
        return found

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of different words one after another, and how many each has."""
        plain = np.zeros(len(words), bool)
        if self.plain:
            short = pc.less(pc.binary_length(words), 64)
            plain = pc.and_(short, pc.match_substring_regex(words, _PLAIN)).to_numpy(zero_copy_only=False)
        usual = words.filter(pa.array(plain))
        body = pc.utf8_lower(pc.utf8_rtrim(usual, characters=_MARKS)).dictionary_encode()
        marks = pc.replace_substring_regex(usual, pattern=_LETTERS, replacement="").dictionary_encode()
        pieces = [self.bodies[w] for w in body.dictionary.to_pylist()]
        n_bodies = len(pieces)
        pieces += [self.marks[m] if m else b"" for m in marks.dictionary.to_pylist()]
        n_usual = len(pieces)
        pieces += self._other(words.filter(pa.array(~plain)).to_pylist())
        pieces.append(b"")
        two = np.full((len(words), 2), len(pieces) - 1)
        two[plain, 0] = body.indices.to_numpy(zero_copy_only=False)
        two[plain, 1] = n_bodies + marks.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        two[~plain, 0] = n_usual + np.arange(len(words) - int(plain.sum()))
        flat = np.frombuffer(b"".join(pieces), self.kind)
        counts = np.fromiter(map(len, pieces), np.int64, len(pieces)) // self.kind.itemsize
        ids, lengths = _gathered(flat, counts, two.ravel())
        return ids, lengths.reshape(-1, 2).sum(1)

    def encode(self, column: pa.Array, end: int = END) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows one after another, and where the ids of each row end."""
        words = texts.split_words(column, lower=False)
        ids, counts = self._words(pa.array(words.vocabulary, pa.large_binary()).cast(pa.large_string()))
        ids, counts = np.append(ids, np.array([end], self.kind)), np.append(counts, 1)
        codes = np.insert(words.codes, words.offsets[1:], len(counts) - 1)
        flat, lengths = _gathered(ids, counts, codes)
        return flat, np.cumsum(lengths)[words.offsets[1:] + np.arange(len(words.offsets) - 1)]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def schema(kind: np.dtype, length: int) -> pa.Schema:
    return pa.schema(
        [
            ("ids", pa.list_(pa.from_numpy_dtype(kind), length)),
            ("mask", pa.list_(pa.bool_(), length)),
            ("doc_ids", pa.list_(pa.int64())),
            ("doc_ends", pa.list_(pa.int32())),
        ]
    )


class _Writer:
    """Cuts a stream of documents into sequences and writes them in batches."""

    def __init__(self, sink, kind: np.dtype, length: int, rows: int = 256):
        self.length, self.rows, self.kind = length, rows, kind
        self.schema = schema(kind, length)
        self.stream = pa.ipc.new_stream(sink, self.schema)
        self.open = np.zeros(0, kind)
        self.docs: list[int | None] = []
        self.ends = np.zeros(0, np.int64)  # of self.docs, from the start of self.open
        self.n_docs = self.n_tokens = 0

    def add(self, ids: np.ndarray, docs: list[int | None], ends: np.ndarray) -> None:
        self.n_docs += len(docs)
        self.n_tokens += len(ids)
        self.ends = np.concatenate([self.ends, ends + len(self.open)])
        self.docs += docs
        self.open = np.concatenate([self.open, ids])
        whole = len(self.open) // self.length // self.rows * self.rows
        if whole:
            self._write(whole)

    def _write(self, sequences: int) -> None:
        taken = sequences * self.length
        ids, n = self.open[:taken], min(taken, len(self.open))
        mask = np.arange(taken) < n
        if n < taken:
            ids = np.concatenate([ids, np.zeros(taken - n, self.kind)])
        done = int(np.searchsorted(self.ends, taken, side="right"))
        # an end is in the sequence that holds the document's last id
        of = (self.ends[:done] - 1) // self.length
        offsets = pa.array(np.searchsorted(of, np.arange(sequences + 1)), pa.int32())
        for a in range(0, sequences, self.rows):
            b = min(sequences, a + self.rows)
            cut = slice(a * self.length, b * self.length)
            part = offsets.slice(a, b - a + 1)
            self.stream.write_batch(
                pa.RecordBatch.from_arrays(
                    [
                        pa.FixedSizeListArray.from_arrays(pa.array(ids[cut]), self.length),
                        pa.FixedSizeListArray.from_arrays(pa.array(mask[cut]), self.length),
                        pa.ListArray.from_arrays(part, pa.array(self.docs[:done], pa.int64())),
                        pa.ListArray.from_arrays(part, pa.array(self.ends[:done] - of * self.length, pa.int32())),
                    ],
                    schema=self.schema,
                )
            )
        self.open, self.docs, self.ends = self.open[taken:], self.docs[done:], self.ends[done:] - taken

    def close(self) -> None:
        if len(self.open):
            self._write(-(-len(self.open) // self.length))
        self.stream.close()


class TokenFile:
    """A mapped file: sequence i as views of its ids and the packed bits of its mask."""

    def __init__(self, path: str):
        store, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(use_mmap=True), path.removeprefix("file:"))
        if isinstance(store, fs.LocalFileSystem):
            store = fs.LocalFileSystem(use_mmap=True)
        self.batches = list(pa.ipc.open_stream(store.open_input_file(inner)))
        self.firsts = np.cumsum([0, *(b.num_rows for b in self.batches)])

    def __len__(self) -> int:
        return int(self.firsts[-1])

    def _at(self, i: int) -> tuple[pa.RecordBatch, int]:
        k = int(np.searchsorted(self.firsts, i, side="right")) - 1
        return self.batches[k], i - int(self.firsts[k])

    def ids(self, i: int) -> np.ndarray:
        batch, row = self._at(i)
        return batch.column(0)[row].values.to_numpy()

    def mask(self, i: int) -> np.ndarray:
        batch, row = self._at(i)
        return batch.column(1)[row].values.to_numpy(zero_copy_only=False)


def _store(path: str) -> tuple[fs.FileSystem, str]:
    """The shared folder, by its own file system: nothing is kept on the executor."""
    return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))


def _write(folder: str, tokenizer: str, length: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer)
        store, inner = _store(folder)
        file, writer, first = f"part-{uuid.uuid4().hex}.arrows", None, None
        sink = None
        for block in texts.blocks(batches):
            docs = block.column(0).to_pylist()
            if writer is None:
                sink = store.open_output_stream(f"{inner}/{file}")
                writer, first = _Writer(sink, own.kind, length), docs[0]
            ids, ends = own.encode(block.column(1), end)
            writer.add(ids, docs, ends)
        if writer is not None:
            writer.close()
            sink.close()
            yield pa.RecordBatch.from_arrays(
                [pa.array([file]), pa.array([first], pa.int64()), pa.array([writer.n_docs]), pa.array([writer.n_tokens])],
                names=["file", "first_doc", "n_docs", "n_tokens"],
            )

    return run


def write_token_files(
    docs: DataFrame, folder: str, tokenizer: str, length: int = LENGTH, end: int = END,
    id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """Write the files and return the manifest with ``start``, the ids in all files before."""
    store, inner = _store(folder)
    store.create_dir(inner, recursive=True)
    pairs = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).alias("text"))
    dealt = pairs.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    manifest = write_and_reread(dealt.mapInArrow(_write(folder, tokenizer, length, end), MANIFEST), "token-manifest")
    before = Window.orderBy(F.col("first_doc").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def _read(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, inner = _store(folder)
        for batch in batches:
            for file, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with store.open_input_file(f"{inner}/{file}") as source:
                    yield from _documents(pa.ipc.open_stream(source), start)

    return run


def _documents(stream, start: int) -> Iterator[pa.RecordBatch]:
    crc, n = 0, 0  # of the document that is open at the end of a batch
    for batch in stream:
        length = batch.schema.field(0).type.list_size
        mask = batch.column(1).flatten().to_numpy(zero_copy_only=False)
        ids = batch.column(0).flatten().to_numpy()[mask].astype("<u4")
        ends = batch.column(3).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        ends = ends + np.repeat(np.arange(batch.num_rows) * length, np.diff(batch.column(3).offsets.to_numpy()))
        starts, counts, sums, at = [], [], [], 0
        for e in ends:
            crc, n = zlib.crc32(ids[at:e], crc), n + int(e) - at
            starts.append(start)
            counts.append(n)
            sums.append(crc)
            start, at, crc, n = start + n, int(e), 0, 0
        crc, n = zlib.crc32(ids[at:], crc), n + len(ids) - at
        if starts:
            yield pa.RecordBatch.from_arrays(
                [batch.column(2).flatten(), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(sums, pa.int64())],
                names=["doc_id", "start", "n_tokens", "ids_crc32"],
            )


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """From the files: ``doc_id``, ``start``, ``n_tokens``, ``ids_crc32`` of every document."""
    files = manifest.count()
    dealt = manifest.select("file", "start").repartition(max(1, files))
    return dealt.mapInArrow(_read(folder), "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    folder = scratch_path(docs.sparkSession, "tokens")
    return read_token_files(write_token_files(docs, folder, tokenizer), folder)
