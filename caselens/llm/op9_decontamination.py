"""Benchmark decontamination: a set of normalised test n-grams is sent to all tasks, which
scan the word windows of the documents, compare hits word by word, and report spans.

Words: A-Z in lower case, runs of 0-9, a-z and everything beyond ASCII. A window is ``width``
words of an item; an item with fewer, but not none, is one window. The windows are
broadcast in parts of at most ``PART_BYTES`` of item text: a larger benchmark takes several
scans of the documents, which are then written once with a number per row, by which the hits
are merged. No text is shuffled.

Defined results: null texts and texts without words hit nothing; items without words have no
window; a null item id is reported as ``null``; repeated items and windows count once per
item id; empty tables give no rows or no hits; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from caselens.llm import texts
from caselens.scratch import write_and_reread

WIDTH = 10
PART_BYTES = 64 << 20


class WindowSet:
    """Windows of benchmark items by length: sorted hashes, the words, the items."""

    def __init__(self, items: list[tuple[object, str | None]], width: int = WIDTH):
        column = pa.array([t or "" for _, t in items], pa.large_string())
        words = texts.split_words(column, alphanumeric=True)
        found: dict[int, dict[bytes, set[str]]] = {}
        for (item, _), begin, end in zip(items, words.offsets[:-1], words.offsets[1:]):
            own = [words.vocabulary[c] for c in words.codes[begin:end]]
            length = min(width, len(own))
            for i in range(len(own) - length + 1) if own else ():
                name = "null" if item is None else str(item)
                found.setdefault(length, {}).setdefault(b" ".join(own[i : i + length]), set()).add(name)
        self.by_length = {}
        for length, entries in found.items():
            parts = [w.split(b" ") for w in entries]
            flat = texts.word_hashes([x for p in parts for x in p])
            hashes, _ = texts.windows(flat, np.arange(0, len(flat) + 1, length), length)
            order = np.argsort(hashes, kind="stable")
            names = list(entries)
            self.by_length[length] = (hashes[order], [names[i] for i in order], [entries[names[i]] for i in order])

    def hits(self, words: texts.Words) -> Iterator[tuple[int, int, set[str]]]:
        """(position of the first word, length, items) of every window that occurs."""
        hashes = texts.word_hashes(words.vocabulary)[words.codes]
        for length, (known, names, items) in self.by_length.items():
            own, begins = texts.windows(hashes, words.offsets, length)
            at = np.searchsorted(known, own)
            same = np.flatnonzero(known[np.minimum(at, len(known) - 1)] == own)
            for i in same:
                begin = int(begins[i])
                own_words = b" ".join(words.vocabulary[c] for c in words.codes[begin : begin + length])
                j = int(at[i])
                while j < len(known) and known[j] == own[i]:  # several windows only if hashes collide
                    if names[j] == own_words:
                        yield begin, length, items[j]
                    j += 1


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return [(int(a), int(b)) for a, b in zip(edges[::2], edges[1::2])]


FOUND = "n_words bigint, spans array<struct<first:bigint,last:bigint>>, items array<string>"


def _scan(known):
    """The hits of each row, after its columns but the text, which is the last."""
    kind = pa.struct([("first", pa.int64()), ("last", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in texts.blocks(batches):
            words = texts.split_words(block.column(block.num_columns - 1), alphanumeric=True)
            flags = np.zeros(len(words.codes), bool)
            items: dict[int, set[str]] = {}
            for begin, length, names in known.value.hits(words):
                flags[begin : begin + length] = True
                row = int(np.searchsorted(words.offsets, begin, side="right")) - 1
                items.setdefault(row, set()).update(names)
            spans, named = [], []
            for row in range(block.num_rows):
                a, b = int(words.offsets[row]), int(words.offsets[row + 1])
                hit = row in items
                spans.append([{"first": x, "last": y} for x, y in _runs(flags[a:b])] if hit else [])
                named.append(sorted(items[row]) if hit else [])
            yield pa.RecordBatch.from_arrays(
                [*block.columns[:-1], pa.array(np.diff(words.offsets)), pa.array(spans, pa.list_(kind)), pa.array(named, pa.list_(pa.string()))],
                names=[*block.schema.names[:-1], "n_words", "spans", "items"],
            )

    return run


def benchmark_parts(benchmark: DataFrame, id_column: str = "item_id", text_column: str = "text", part_bytes: int = PART_BYTES):
    """The items in lists of at most ``part_bytes`` of text, fetched one after another; an item
    larger than that is a part of its own."""
    part, size = [], 0
    rows = benchmark.select(id_column, text_column).toLocalIterator()
    for item, text in rows:
        own = len((text or "").encode())
        if part and size + own > part_bytes:
            yield part
            part, size = [], 0
        part.append((item, text))
        size += own
    if part:
        yield part


def contamination(
    docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, id_column: str = "doc_id",
    text_column: str = "text", part_bytes: int = PART_BYTES,
) -> DataFrame:
    """Per row: ``doc_id``, ``n_words``, hit word ``spans`` [first, last) and the ``items`` of the
    windows that occur."""
    spark = docs.sparkSession
    pairs = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).alias("text"))
    parts = [spark.sparkContext.broadcast(WindowSet(part, width)) for part in benchmark_parts(benchmark, part_bytes=part_bytes)]
    if len(parts) < 2:
        known = parts[0] if parts else spark.sparkContext.broadcast(WindowSet([], width))
        return pairs.mapInArrow(_scan(known), f"doc_id bigint, {FOUND}")
    # written, so that all scans see the same numbers
    rows = write_and_reread(pairs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text"), "numbered")
    scans = [rows.mapInArrow(_scan(known), f"rid bigint, doc_id bigint, {FOUND}") for known in parts]
    merged = reduce(DataFrame.unionByName, scans).groupBy("rid").agg(
        F.max("doc_id").alias("doc_id"),
        F.max("n_words").alias("n_words"),
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),  # one short list per part
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    joined = F.expr(
        """aggregate(spans, cast(array() as array<struct<first:bigint,last:bigint>>), (acc, s) ->
             if(size(acc) > 0 and s.first <= element_at(acc, -1).last,
                concat(slice(acc, 1, size(acc) - 1),
                       array(named_struct('first', element_at(acc, -1).first, 'last', greatest(element_at(acc, -1).last, s.last)))),
                concat(acc, array(s))))"""
    )
    return merged.drop("rid").withColumn("spans", joined)


def digest(found: DataFrame) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_hit``, ``n_items``, ``items_sha256``, ``contaminated``."""
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["last"] - s["first"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def without_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the words of the spans and what lies between them."""
    data = text.encode()
    table = texts._ALPHANUMERIC[np.frombuffer(data, np.uint8)] != 0x20
    edges = np.flatnonzero(np.diff(np.concatenate([[0], table.astype(np.int8), [0]])))
    begins, ends = edges[::2], edges[1::2]
    out, at = [], 0
    for first, last in spans:
        out.append(data[at : begins[first]])
        at = int(ends[last - 1])
    return b"".join([*out, data[at:]]).decode()


def clean_spans(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``doc_id``, ``text`` with the spans of ``found`` (of ``contamination``) taken out; texts
    without hits stay as they are."""
    hit = found.where(F.size("spans") > 0).select("doc_id", "spans")

    def run(batches):
        for batch in batches:
            spans = batch.column(2).to_pylist()
            cleaned = [
                without_spans(t, [(s["first"], s["last"]) for s in own]) if own else t
                for t, own in zip(batch.column(1).to_pylist(), spans)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cleaned, pa.string())], names=["doc_id", "text"])

    joined = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(hit, "doc_id", "left")
    return joined.select("doc_id", "text", "spans").mapInArrow(run, "doc_id bigint, text string")


def without_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """The documents no window of the benchmark occurs in, with all their columns."""
    parts = list(benchmark_parts(benchmark)) or [[]]
    kept = docs
    for part in parts:
        kept = kept.mapInArrow(_keep_clean(docs.sparkSession.sparkContext.broadcast(WindowSet(part, width))), docs.schema)
    return kept


def _keep_clean(known):
    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index("text")
            clean = np.ones(batch.num_rows, bool)
            done = 0
            for block in texts.blocks(iter([batch])):
                words = texts.split_words(block.column(at), alphanumeric=True)
                for begin, _, _ in known.value.hits(words):
                    clean[done + int(np.searchsorted(words.offsets, begin, side="right")) - 1] = False
                done += block.num_rows
            yield batch.filter(pa.array(clean))

    return run
