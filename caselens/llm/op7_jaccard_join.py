"""Jaccard join of shingle sets, size-aware: subsets of light sets, inverted lists of heavy ones.

A document's set is its distinct shingles of ``SHINGLE`` words. Two sets link when
100 * intersection >= 85 * union; callers may ask for another length and share. The work is split at a size boundary:

* Two light sets of sizes s and t link only if they share a subset of the least overlap these
  sizes need, so all subsets of that fixed size are enumerated as keys. For small sets these
  are few, and unrelated sets share none.
* A pair with a heavy set is found in inverted lists. Shingles are ordered from rare to
  common, by a counting sketch of fixed size; two sets that link share one of their first
  s - ceil(0.85 s) + 1 shingles in any common order. Lists are scanned by size.

The boundary is where enumerating a size becomes dearer than indexing and scanning it, from
the sizes' histogram and the mean length of a list.

Equal sets are one class, represented by its smallest id. In a list each set meets only a
pivot of a similar size first; once the confirmed links have joined most of a list into
components, only pairs across components are left (``_across``), in blocks of bounded size.
Candidates pass a bit signature whose distance bounds the difference of the sets, and then are
checked on the sets themselves. So no list emits all its pairs, and no link is lost.

Sets are compared by 64-bit hashes of shingles.

Defined results: null texts and texts without words have an empty set and no link; fewer
words than a shingle are one shingle; rows with a null id are linked with nothing and keep a null
component; rows that repeat an id are one document with the links of all of them; an empty
table gives an empty result; columns beside the two named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations
from math import ceil, comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from caselens.llm import texts
from caselens.llm.components import components
from caselens.scratch import write_and_reread

SHINGLE = 4
PERCENT = 85
CELLS = 1 << 22
CHUNK = 1 << 12
BLOCK = 4096
MOST_LIGHT = 40
SIGNATURE = 512
MOST_BROADCAST = 1 << 20


def least_overlap(s: int, t: int, percent: int = PERCENT) -> int:
    """The smallest intersection with which sets of these sizes link."""
    return -(-percent * (s + t) // (100 + percent))


def prefix_length(s: int, percent: int = PERCENT) -> int:
    return s - -(-percent * s // 100) + 1


def subset_sizes(s: int, boundary: int, percent: int = PERCENT) -> list[int]:
    """The overlaps that a light set of size s needs with light sets."""
    low, high = -(-percent * s // 100), min(boundary, s * 100 // percent)
    return sorted({least_overlap(s, t, percent) for t in range(max(1, low), high + 1)})


def subset_count(s: int, boundary: int, percent: int = PERCENT) -> int:
    return sum(comb(s, k) for k in subset_sizes(s, boundary, percent) if k <= s)


def choose_boundary(list_length: float, percent: int = PERCENT) -> int:
    """The largest size up to which enumerating subsets costs no more than a prefix and the
    scan of its lists, a compared set counted as one key."""
    boundary = 0
    for s in range(1, MOST_LIGHT + 1):
        if subset_count(s, s * 100 // percent, percent) > prefix_length(s, percent) * (1 + list_length):
            break
        boundary = s
    return boundary


def shingle_sets(column: pa.Array, length: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all rows, and the offsets of the rows."""
    words = texts.split_words(column)
    hashes = texts.word_hashes(words.vocabulary)[words.codes]
    counts = np.diff(words.offsets)
    found, begins = texts.windows(hashes, words.offsets, length)
    rows = np.searchsorted(words.offsets, begins, side="right") - 1
    for n in range(1, length):
        few = np.flatnonzero(counts == n)
        if len(few):
            at = words.offsets[few]
            own = np.zeros(len(few), np.uint64)
            for i in range(n):
                own = texts.mix(own + hashes[at + i] + np.uint64(i + 1))
            found, rows = np.concatenate([found, own]), np.concatenate([rows, few])
    order = np.lexsort((found, rows))
    found, rows = found[order], rows[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (rows[1:] != rows[:-1])
    found, rows = found[new], rows[new]
    return found, np.searchsorted(rows, np.arange(len(column) + 1))


def _signatures(found: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """Per row the parity of its shingles by bit: two sets differ in at least as many shingles
    as their signatures differ in bits."""
    rows = len(offsets) - 1
    row = np.repeat(np.arange(rows), np.diff(offsets))
    bits = np.bincount(row * SIGNATURE + (found >> np.uint64(50)).astype(np.int64) % SIGNATURE, minlength=rows * SIGNATURE) & 1
    packed = np.packbits(bits.reshape(rows, SIGNATURE).astype(np.uint8), axis=1)
    return [p.tobytes() for p in packed]


PROFILE = "doc_id bigint, n_shingles bigint, high bigint, low bigint, chunk int, body binary"


def _profile(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    """A row per document (size, digest, signature) and, at the end, the task's sketch in chunks."""
    sketch = np.zeros(CELLS, np.uint32)
    kind = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
    names = ["doc_id", "n_shingles", "high", "low", "chunk", "body"]
    for block in texts.blocks(batches):
        found, offsets = shingle_sets(block.column(1), shingle)
        cells, times = np.unique(found & np.uint64(CELLS - 1), return_counts=True)
        sketch[cells.astype(np.int64)] += times.astype(np.uint32)
        digests = [xxhash.xxh3_128_intdigest(found[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:])]
        high = np.array([d >> 64 for d in digests], np.uint64).view(np.int64)
        low = np.array([d & ((1 << 64) - 1) for d in digests], np.uint64).view(np.int64)
        columns = [block.column(0), np.diff(offsets), high, low, pa.nulls(block.num_rows, pa.int32()), _signatures(found, offsets)]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kind)], names=names)
    if sketch.any():
        chunks = sketch.reshape(-1, CHUNK)
        used = np.flatnonzero(chunks.any(axis=1))
        for a in range(0, len(used), 64):
            part = used[a : a + 64]
            empty = [pa.nulls(len(part), k) for k in kind[:4]]
            yield pa.RecordBatch.from_arrays([*empty, pa.array(part, kind[4]), pa.array([chunks[i].tobytes() for i in part], kind[5])], names=names)


def _add_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            own = np.frombuffer(body, np.uint32).astype(np.uint64)
            sums[chunk] = sums[chunk] + own if chunk in sums else own
    for chunk, total in sums.items():
        body = np.minimum(total, (1 << 32) - 1).astype(np.uint32).tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([body])], names=["chunk", "body"])


def whole_sketch(profiles: DataFrame) -> np.ndarray:
    """The sum of all tasks' sketches: ``CELLS`` counters whatever the input."""
    parts = profiles.where("chunk IS NOT NULL").select("chunk", "body")
    sketch = np.zeros((CELLS // CHUNK, CHUNK), np.uint32)
    for r in parts.repartition(16, "chunk").mapInArrow(_add_chunks, "chunk int, body binary").collect():
        sketch[r["chunk"]] = np.frombuffer(r["body"], np.uint32)
    return sketch.reshape(-1)


def mean_list(sketch: np.ndarray) -> float:
    """The mean length of the list a shingle of a document is in, without the counts that
    other shingles of its cell bring along."""
    counts = sketch.astype(float)
    total = counts.sum()
    return max(1.0, (counts**2).sum() / total - total / CELLS) if total else 1.0


def _keys(sketch, boundary: int, percent: int, shingle: int):
    """(key, doc_id, size) rows: subsets of light sets, prefixes of the sets that may meet a heavy one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = sketch.value
        given: set[bytes] = set()  # equal sets of one task give their keys once
        prefixes = np.zeros(1, np.int64)
        for block in texts.blocks(batches):
            docs, nulls = texts.ids_of(block, "doc_id")
            found, offsets = shingle_sets(block.column(1), shingle)
            sizes = np.diff(offsets)
            fresh = np.zeros(len(sizes), bool)
            for i in np.flatnonzero((sizes > 0) & ~nulls):
                digest = xxhash.xxh3_128_digest(found[offsets[i] : offsets[i + 1]].tobytes())
                if digest not in given:
                    given.add(digest)
                    fresh[i] = True
            if len(prefixes) <= sizes.max(initial=0):
                prefixes = np.array([prefix_length(s, percent) if s else 0 for s in range(sizes.max() + 1)])
            # rare to common within each row; the first ones of rows that may meet a heavy set
            row = np.repeat(np.arange(len(sizes)), sizes)
            order = np.lexsort((found, counts[(found & np.uint64(CELLS - 1)).astype(np.int64)], row))
            place = np.arange(len(found)) - np.repeat(offsets[:-1], sizes)
            indexed = fresh & (sizes * 100 >= percent * (boundary + 1))
            first = (place < prefixes[sizes][row]) & indexed[row]
            keys, rows = [found[order][first].view(np.int64)], [row[first]]
            for i in np.flatnonzero(fresh & (sizes <= boundary)):
                own = texts.mix(found[offsets[i] : offsets[i + 1]])
                for k in subset_sizes(len(own), boundary, percent):
                    if k <= len(own):
                        left_out = list(combinations(range(len(own)), len(own) - k))
                        gone = own[np.array(left_out, np.int64).reshape(len(left_out), -1)].sum(axis=1, dtype=np.uint64)
                        keys.append(texts.mix(own.sum(dtype=np.uint64) - gone + np.uint64(k)).view(np.int64))
                        rows.append(np.full(len(left_out), i))
            rows = np.concatenate(rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(keys)), pa.array(docs[rows], pa.int64()), pa.array(sizes[rows], pa.int32())],
                names=["key", "doc_id", "size"],
            )

    return run


LISTED = "key bigint, a bigint, b bigint, s int, t int"


def _compatible(s: int, t: int, percent: int) -> bool:
    return s * percent <= t * 100 and t * percent <= s * 100


def _list_pairs(docs: list[int], sizes: list[int], percent: int) -> Iterator[tuple[int, int, int, int]]:
    """Each set of a list with the first earlier one of a similar size that is a pivot; a set without
    one is a pivot itself. Documents come in the order of their ids, so the lists of a group
    tend to have the same pivots."""
    pivots: list[tuple[int, int]] = []
    for doc, size in zip(docs, sizes):
        pivot = next((p for p in pivots if _compatible(p[1], size, percent)), None)
        if pivot is None:
            pivots.append((doc, size))
        elif pivot[0] != doc:
            yield pivot[0], doc, pivot[1], size


def _scan_lists(percent: int):
    """Rows sorted by (key, doc_id, size): pairs (key null), and the lists of more than two sets
    (b null), whose other pairs may be wanted later."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in LISTED.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
        seen: set[tuple[int, int]] = set()

        def flush(key, doc, size) -> pa.RecordBatch:
            out: list[tuple] = []
            heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            ends = np.append(heads[1:], len(key))
            for a, b in zip(heads[ends - heads > 1], ends[ends - heads > 1]):
                d, s = doc[a:b].tolist(), size[a:b].tolist()
                for x, y, m, n in _list_pairs(d, s, percent):
                    if (x, y) not in seen:
                        if len(seen) > 500_000:
                            seen.clear()
                        seen.add((x, y))
                        out.append((None, x, y, m, n))
                if b - a > 2:  # named by its documents: lists of the same ones are one
                    name = int(np.uint64(xxhash.xxh3_64_intdigest(doc[a:b].tobytes())).view(np.int64))
                    out += [(name, x, None, n, None) for x, n in zip(d, s)]
            columns = list(zip(*out)) or [()] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

        carry = [np.zeros(0, np.int64)] * 3
        for batch in batches:
            own = [c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]
            carry = [np.concatenate([c, o]) for c, o in zip(carry, own)]
            last = int(np.searchsorted(carry[0], carry[0][-1])) if len(carry[0]) else 0  # the last list may go on
            if last:
                yield flush(*(c[:last] for c in carry))
                carry = [c[last:] for c in carry]
        if len(carry[0]):
            yield flush(*carry)

    return run


def _near_signatures(percent: int):
    ones = np.array([bin(i).count("1") for i in range(256)], np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(2).to_numpy() + batch.column(3).to_numpy()
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for i in (4, 5))
            near = ones[x ^ y].sum(axis=1, dtype=np.int64) <= _most_apart(sizes, percent)
            yield batch.select(["a", "b"]).filter(pa.array(near))

    return run


def _most_apart(sizes, percent: int):
    """The most shingles in one only of two sets that link, from the sum of their sizes."""
    return sizes - 2 * (-(-percent * sizes // (100 + percent)))


def hopeful(pairs: DataFrame, nodes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose signatures leave the link possible."""
    about = nodes.where("n_shingles > 0 AND doc_id IS NOT NULL").select("doc_id", "n_shingles", "body")
    one = about.select(F.col("doc_id").alias("a"), F.col("n_shingles").alias("s"), F.col("body").alias("x"))
    two = about.select(F.col("doc_id").alias("b"), F.col("n_shingles").alias("t"), F.col("body").alias("y"))
    both = pairs.select("a", "b").distinct().join(one, "a").join(two, "b")
    return both.select("a", "b", "s", "t", "x", "y").mapInArrow(_near_signatures(percent), "a bigint, b bigint")


def _long_signature(own: np.ndarray) -> bytes:
    """As in ``_signatures``, with four to eight bits a shingle: a power of two of them."""
    bits = 1 << max(9, (4 * len(own) - 1).bit_length())
    parity = np.bincount((own >> np.uint64(20)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(parity.astype(np.uint8), bitorder="little").tobytes()


def _folded(signature: np.ndarray, size: int) -> np.ndarray:
    """The shorter signature of the same set: bits meet by their parity."""
    return np.bitwise_xor.reduce(signature.reshape(-1, size), axis=0)


def _sets(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for block in texts.blocks(batches):
        found, offsets = shingle_sets(block.column(1), shingle)
        rows = [found[a:b] for a, b in zip(offsets[:-1], offsets[1:])]
        columns = [pa.array([r.tobytes() for r in rows], pa.binary()), pa.array([_long_signature(r) for r in rows], pa.binary())]
        yield pa.RecordBatch.from_arrays([block.column(0), pa.array(np.diff(offsets)), *columns], names=["doc_id", "n", "body", "signature"])


def _near_long_signatures(percent: int):
    ones = np.array([bin(i).count("1") for i in range(256)], np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for s, t, x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4), batch.column(5)):
                x, y = np.frombuffer(x.as_buffer(), np.uint8), np.frombuffer(y.as_buffer(), np.uint8)
                size = min(len(x), len(y))
                apart = int(ones[_folded(x, size) ^ _folded(y, size)].sum(dtype=np.int64))
                keep.append(apart <= _most_apart(s + t, percent))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _linked(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                s, t = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(s, t, assume_unique=True))
                keep.append(100 * both >= percent * (len(s) + len(t) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def confirmed(docs: DataFrame, pairs: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE) -> DataFrame:
    """The pairs (a, b) whose sets link, checked on the sets. Only documents that are in a pair are
    shingled; their ids are broadcast up to ``MOST_BROADCAST`` of them and joined beyond."""
    pairs = write_and_reread(pairs.select("a", "b").distinct(), "pairs")
    ends = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    if pairs.count() <= MOST_BROADCAST // 2:
        ends = F.broadcast(ends)
    sets = docs.join(ends, "doc_id", "left_semi").select("doc_id", "text")
    sets = write_and_reread(sets.mapInArrow(partial(_sets, shingle=shingle), "doc_id bigint, n bigint, body binary, signature binary"), "sets")
    # long signatures first: the sets themselves only go where a link is likely
    marks = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("n").alias("s"), F.col("signature").alias("x")), "a")
    marks = marks.join(sets.select(F.col("doc_id").alias("b"), F.col("n").alias("t"), F.col("signature").alias("y")), "b")
    marks = marks.select("a", "b", "s", "t", "x", "y").mapInArrow(_near_long_signatures(percent), "a bigint, b bigint")
    small = pairs.count() <= MOST_BROADCAST // 2
    pairs = write_and_reread(marks.distinct(), "likely-pairs")
    ends = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    sets = sets.join(F.broadcast(ends) if small else ends, "doc_id", "left_semi")
    beside = pairs.join(sets.select(F.col("doc_id").alias("b"), F.col("body").alias("body_b")), "b")
    beside = beside.join(sets.select(F.col("doc_id").alias("a"), F.col("body").alias("body_a")), "a")
    linked = beside.select("a", "b", "body_a", "body_b").mapInArrow(_linked(percent), "a bigint, b bigint")
    return write_and_reread(linked, "linked")


def _across(percent: int):
    """Rows sorted by cell (key, i, j). Pairs of one cell, between its sides i and j, with different
    components, similar sizes and near signatures; a cell holds two blocks at most."""
    ones = np.array([bin(i).count("1") for i in range(256)], np.uint8)

    def pairs(side, doc, label, size, bits, i, j) -> Iterator[np.ndarray]:
        left, right = np.flatnonzero(side == i), np.flatnonzero(side == j)
        step = max(1, (1 << 20) // max(1, len(right)))
        for at in range(0, len(left), step):
            some = left[at : at + step]
            near = label[some][:, None] != label[right]
            s, t = size[some][:, None], size[right]
            near &= (s * percent <= t * 100) & (t * percent <= s * 100)
            x, y = np.nonzero(near)
            x, y = some[x], right[y]
            for cut in range(0, len(x), 1 << 16):
                u, v = x[cut : cut + (1 << 16)], y[cut : cut + (1 << 16)]
                apart = ones[bits[u] ^ bits[v]].sum(axis=1, dtype=np.int64)
                good = apart <= _most_apart(size[u] + size[v], percent)
                u, v = doc[u[good]], doc[v[good]]
                yield np.unique(np.stack([np.minimum(u, v), np.maximum(u, v)], axis=1), axis=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry: pa.Table | None = None
        seen: set[tuple[int, int]] = set()

        def flush(table: pa.Table) -> Iterator[pa.RecordBatch]:
            key, i, j, side, doc, label, size = (table[c].to_numpy() for c in range(7))
            bits = np.frombuffer(b"".join(table[7].to_pylist()), np.uint8).reshape(len(key), -1)
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
            heads = np.flatnonzero(new)
            for a, b in zip(heads, np.append(heads[1:], len(key))):
                for found in pairs(side[a:b], doc[a:b], label[a:b], size[a:b], bits[a:b], i[a], j[a]):
                    fresh = [p for p in map(tuple, found.tolist()) if p not in seen]
                    if len(seen) > 500_000:
                        seen.clear()
                    seen.update(fresh)
                    if fresh:
                        x, y = zip(*fresh)
                        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], names=["a", "b"])

        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if carry is None else pa.concat_tables([carry, table]).combine_chunks()
            key, i, j = (table[c].to_numpy() for c in range(3))
            same = (key == key[-1]) & (i == i[-1]) & (j == j[-1]) if len(key) else np.ones(0, bool)
            whole = int(len(key) - same.sum())  # the last cell may go on
            if whole:
                yield from flush(table.slice(0, whole))
            carry = table.slice(whole)
        if carry is not None and carry.num_rows:
            yield from flush(carry)

    return run


def across_components(lists: DataFrame, nodes: DataFrame, labels: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Candidate pairs of long lists between components. Lists within one component end here; the
    others are cut into blocks, and each pair of blocks is a group of bounded size."""
    known = lists.select("key", F.col("a").alias("doc_id"), F.col("s").cast("bigint").alias("size")).distinct()
    named = nodes.where("n_shingles > 0 AND doc_id IS NOT NULL").join(labels, "rep", "left")
    named = named.select("doc_id", F.coalesce("component", "rep").alias("label"), "body").dropDuplicates(["doc_id"])
    labelled = known.join(named.select("doc_id", "label"), "doc_id")
    mixed = labelled.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("x"), F.max("label").alias("y"))
    mixed = mixed.where("x != y").select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    rows = known.join(mixed, "key").join(named, "doc_id")
    block = F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")
    split = rows.withColumn("side", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = split.select(
        "key", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"),
        "side", "doc_id", "label", "size", "body",
    )
    return cells.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_across(percent), "a bigint, b bigint")


def near_groups(
    docs: DataFrame, percent: int = PERCENT, id_column: str = "doc_id", text_column: str = "text", shingle: int = SHINGLE
) -> DataFrame:
    """Per document ``doc_id``, ``n_shingles``, ``component_id``: the smallest id linked with it
    directly or through others, over shingles of ``shingle`` words."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).alias("text"))
    profiles = write_and_reread(docs.mapInArrow(partial(_profile, shingle=shingle), PROFILE), "profiles")
    counts = whole_sketch(profiles)
    boundary = choose_boundary(mean_list(counts), percent)
    nodes = profiles.where("chunk IS NULL").select("doc_id", "n_shingles", "high", "low", "body")
    classes = nodes.where("n_shingles > 0").groupBy("high", "low").agg(F.min("doc_id").alias("rep"))
    nodes = write_and_reread(nodes.join(classes, ["high", "low"], "left"), "nodes")

    keys = docs.mapInArrow(_keys(spark.sparkContext.broadcast(counts), boundary, percent, shingle), "key bigint, doc_id bigint, size int")
    dealt = keys.repartition("key").sortWithinPartitions("key", "doc_id", "size")
    listed = write_and_reread(dealt.mapInArrow(_scan_lists(percent), LISTED), "lists")
    links = confirmed(docs, hopeful(listed.where("key IS NULL"), nodes, percent), percent, shingle)
    labels = components(_by_class(links, nodes))
    rest = across_components(listed.where("key IS NOT NULL"), nodes, labels.withColumnRenamed("node", "rep"), percent)
    more = confirmed(docs, rest, percent, shingle)
    if not more.isEmpty():
        labels = components(_by_class(links.union(more), nodes))
    labels = labels.select(F.col("node").alias("rep"), "component")
    found = nodes.join(labels, "rep", "left")
    own = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("component", "rep", "doc_id"))
    return found.select("doc_id", "n_shingles", own.alias("component_id"))


def _by_class(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links between the representatives of the classes of their ends."""
    reps = nodes.where("doc_id IS NOT NULL AND rep IS NOT NULL").select("doc_id", "rep").distinct()
    a = links.join(reps.select(F.col("doc_id").alias("a"), F.col("rep").alias("x")), "a")
    ends = a.join(reps.select(F.col("doc_id").alias("b"), F.col("rep").alias("y")), "b")
    several = reps.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a != b")
    repeated = reps.join(several.select("doc_id", "a"), "doc_id")  # rows that repeat an id are one document
    return ends.select(F.col("x").alias("a"), F.col("y").alias("b")).unionByName(repeated.select("a", F.col("rep").alias("b")))
