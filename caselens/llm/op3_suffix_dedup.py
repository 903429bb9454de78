"""Repeated byte strings across documents by a common-prefix interval tree.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts earlier. Every such
string holds an anchor, the run of ``GRAM`` bytes with the smallest hash in it, wherever the
string occurs, so only anchors (about one in 35 bytes) have to meet:

1. Anchors carry a hash of themselves and one of their surroundings, all the bytes a string
   of ``LENGTH`` around them can reach. Equal anchors with equal surroundings form a class;
   all but the first of a class repeat it. Tasks do this for what they read before anything is
   shuffled, so a passage in a third of all documents reaches the reducers once per task.
2. Where an anchor has several classes, their first members are looked up and form an enhanced
   suffix array: suffixes from the anchor on, sorted, with the lengths of common prefixes. A
   scan with a stack yields the intervals of suffixes with a common prefix; within an
   interval the suffixes are split by what stands to their left, and each subset that cannot
   be extended to the left as a whole, and is long enough with both sides, is a maximal
   repeat: all its members are occurrences, the earliest is the original.
3. An anchor with more than ``HOT`` classes is not gathered: its strings of ``LENGTH`` bytes are
   compared as classes by themselves, as in 1.

``repeats`` gives the occurrences with their originals, ``removed`` what is left of each
document. Anchors and classes are told apart by 128 bits together.

Defined results: null texts are empty; texts shorter than ``LENGTH`` keep all bytes; rows
that repeat an id, or have none, are separate documents, ordered by id (nulls first) and a hash
of the text; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from caselens.llm import texts
from caselens.scratch import write_and_reread

LENGTH = 100
GRAM = 32
LEFT = LENGTH - GRAM
GAP = 192
PIECE = 1 << 20
HOT = 100_000
FLUSH = 2_000_000

ANCHORS = "h bigint, ctx bigint, rid bigint, pos bigint, left int, right int, first_rid bigint, first_pos bigint"
FOUND = "rid bigint, start bigint, stop bigint, first_rid bigint, first_start bigint, h bigint, classes bigint"


def _doubled(x: np.ndarray, by: int) -> np.ndarray:
    y = x[:-by] * np.uint64(0xD6E8FEB86659FD93) + x[by:]
    return y ^ (y >> np.uint64(32))


def _smallest(v: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each window of ``width`` values, by running minima from both sides of blocks."""
    n = len(v) - width + 1
    blocks = np.full(-(-len(v) // width) * width, np.iinfo(v.dtype).max, v.dtype)
    blocks[: len(v)] = v
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def _anchors_of(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, pos, h, ctx, left, right) of the anchors of a block's rows."""
    pieces = []  # row, first window, end of windows, first byte, end of bytes, size of the row
    for row in np.flatnonzero(np.diff(offsets) >= LENGTH):
        n = int(offsets[row + 1] - offsets[row])
        for a in range(0, n - LENGTH + 1, PIECE):
            b = min(n - LENGTH + 1, a + PIECE)
            pieces.append((row, a, b, max(0, a - LEFT), min(n, b + LEFT + LENGTH), n))
    found = [[] for _ in range(6)]
    begin = 0
    while begin < len(pieces):
        end, size = begin, 0
        while end < len(pieces) and (end == begin or size < 2 * PIECE):
            size += pieces[end][4] - pieces[end][3] + GAP
            end += 1
        for out, own in zip(found, _anchors_of_pieces(body, offsets, pieces[begin:end], size + GAP)):
            out.append(own)
        begin = end
    kinds = (np.int64, np.int64, np.uint64, np.uint64, np.int64, np.int64)
    row, pos, *rest = (np.concatenate(f) if f else np.zeros(0, k) for f, k in zip(found, kinds))
    new = np.ones(len(row), bool)  # neighbouring pieces of a long row may share an anchor
    new[1:] = (row[1:] != row[:-1]) | (pos[1:] > pos[:-1])
    return tuple(x[new] for x in (row, pos, *rest))


def _anchors_of_pieces(body: np.ndarray, offsets: np.ndarray, pieces: list[tuple], size: int) -> tuple[np.ndarray, ...]:
    buffer = np.zeros(size, np.uint8)
    valid = np.zeros(size, bool)
    places, at = [], GAP
    for row, a, b, lo, hi, _ in pieces:
        buffer[at : at + hi - lo] = body[offsets[row] + lo : offsets[row] + hi]
        valid[at + a - lo : at + b - lo] = True
        places.append(at)
        at += hi - lo + GAP
    h = (buffer.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h = h ^ (h >> np.uint64(29))
    for by in (1, 2):
        h = _doubled(h, by)
    four = h
    for by in (4, 8, 16):
        h = _doubled(h, by)
    scrambled = texts.mix(h)
    low = np.uint64((1 << 28) - 1)
    v = (scrambled & ~low) | np.arange(len(h), dtype=np.uint64)
    least = _smallest(v, LEFT + 1)
    p = least[valid[: len(least)]] & low
    p = p[np.concatenate([[True], p[1:] != p[:-1]])].astype(np.int64) if len(p) else np.zeros(0, np.int64)
    piece = np.searchsorted(np.array(places), p, side="right") - 1
    table = np.array([(row, lo, n) for row, _, _, lo, _, n in pieces], np.int64)
    row, n = table[piece, 0], table[piece, 2]
    pos = p - np.array(places)[piece] + table[piece, 1]
    left, right = np.minimum(pos, LEFT), np.minimum(n - pos, LENGTH)
    ctx = (left * 256 + right).astype(np.uint64)
    for part, shift in ((h, -68), (h, -36), (four, -4), (h, 32), (h, 64), (four, 96)):
        ctx = texts.mix(ctx * np.uint64(0xA0761D6478BD642F) + part[p + shift])
    return row, pos, scrambled[p], ctx, left, right


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where sorted columns take new values."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return new


def _joined(rid, start, stop, first_rid, first_start) -> tuple[np.ndarray, ...]:
    """Occurrences of the same original at the same distance become one where they touch."""
    apart = first_start - start
    order = np.lexsort((stop, start, apart, first_rid, rid))
    rid, start, stop, first_rid, apart = (x[order] for x in (rid, start, stop, first_rid, apart))
    new = _starts(rid, first_rid, apart)
    if len(new):
        # the furthest end so far within the run: ends are lifted above those of earlier runs
        run = np.cumsum(new)
        lift = run * (stop.max() + 1)
        furthest = np.maximum.accumulate(stop + lift) - lift
        new[1:] |= start[1:] > furthest[:-1]
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(new)) - 1
        stop = furthest[last]
        rid, start, first_rid, apart = (x[first] for x in (rid, start, first_rid, apart))
    return rid, start, stop, first_rid, start + apart


def _classes(h, ctx, rid, pos, left, right):
    """Members of equal (h, ctx) other than the first as occurrences, and the first ones."""
    order = np.lexsort((pos, rid, ctx, h))
    h, ctx, rid, pos, left, right = (x[order] for x in (h, ctx, rid, pos, left, right))
    new = _starts(h, ctx)
    first = np.flatnonzero(new)[np.cumsum(new) - 1] if len(new) else np.zeros(0, np.int64)
    again = ~new
    f = first[again]
    spans = _joined(rid[again], (pos - left)[again], (pos + right)[again], rid[f], (pos - left)[f])
    return spans, tuple(x[new] for x in (h, ctx, rid, pos, left, right))


def _rows(names: str, columns: list, kinds: list | None = None) -> pa.RecordBatch:
    fields = [f.strip().split() for f in names.split(",")]
    types = [{"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[k] for _, k in fields]
    n = next(len(c) for c in columns if c is not None)
    arrays = [pa.nulls(n, t) if c is None else pa.array(c, t) for c, t in zip(columns, types)]
    return pa.RecordBatch.from_arrays(arrays, names=[f for f, _ in fields])


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _map_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors that are first in their class here; occurrences found here (ctx null, pos and right
    as start and end, the original beside)."""
    held: list[tuple] = []

    def flush():
        spans, firsts = _classes(*(np.concatenate(c) for c in zip(*held)))
        h, ctx, rid, pos, left, right = firsts
        for a in range(0, len(h), 100_000):
            cut = slice(a, a + 100_000)
            yield _rows(ANCHORS, [_signed(h[cut]), _signed(ctx[cut]), rid[cut], pos[cut], left[cut], right[cut], None, None])
        rid, start, stop, first_rid, first_start = spans
        if len(rid):
            spread = _signed(texts.mix(rid.astype(np.uint64) * np.uint64(31) + start.astype(np.uint64)))
            yield _rows(ANCHORS, [spread, None, rid, start, np.zeros(len(rid), int), stop - start, first_rid, first_start])

    count = 0
    for block in texts.blocks(batches):
        rids = block.column(0).to_numpy()
        row, pos, h, ctx, left, right = _anchors_of(*texts.raw(block.column(1)))
        held.append((h, ctx, rids[row], pos, left, right))
        count += len(h)
        if count > FLUSH:
            yield from flush()
            held, count = [], 0
    if count:
        yield from flush()


def _columns(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    own = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(own) if own else None


def _merge_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For one part of the anchor hashes: occurrences, and the anchors to look up (stop null) with
    the number of classes of their hash."""
    table = _columns(batches)
    if table is None:
        return
    passed = table["ctx"].is_null().to_numpy()
    old = table.filter(pa.array(passed))
    if old.num_rows:
        start = old["pos"].to_numpy()
        yield _rows(FOUND, [old["rid"].to_numpy(), start, start + old["right"].to_numpy(), old["first_rid"].to_numpy(), old["first_pos"].to_numpy(), None, None])
    table = table.filter(pa.array(~passed))
    h, ctx, rid, pos, left, right = (table[c].to_numpy().astype(np.int64) for c in ("h", "ctx", "rid", "pos", "left", "right"))
    spans, (h, ctx, rid, pos, left, right) = _classes(h, ctx, rid, pos, left, right)
    if len(spans[0]):
        yield _rows(FOUND, [*spans, None, None])
    new = _starts(h)
    if len(new):
        counts = np.diff(np.append(np.flatnonzero(new), len(new)))
        counts = np.repeat(counts, counts)
        several = counts > 1
        if several.any():
            yield _rows(FOUND, [rid[several], pos[several], None, None, None, h[several], counts[several]])


AROUND = "h bigint, ctx bigint, rid bigint, pos bigint, before binary, after binary"


def _surroundings(hot: int):
    """Per looked-up anchor its bytes to the left, reversed, and to the right; for anchors with too
    many classes their strings' hashes instead (before null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for rid, text, wanted in zip(*(c.to_pylist() for c in batch.columns)):
                data = text.encode()
                for w in wanted:
                    p = w["start"]
                    before, after = data[max(0, p - LEFT) : p], data[p : p + LENGTH]
                    if w["classes"] <= hot:
                        out.append((w["h"], None, rid, p, before[::-1], after))
                        continue
                    around = before + after
                    for i in range(len(around) - LENGTH + 1):
                        d = xxhash.xxh3_128_intdigest(around[i : i + LENGTH])
                        high, low = (d >> 64) - (1 << 63), (d & ((1 << 64) - 1)) - (1 << 63)
                        out.append((high, low, rid, p - len(before) + i, None, None))
            if out:
                yield _rows(AROUND, list(zip(*out)))

    return run


def _matrix(column: pa.ChunkedArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    values = column.to_pylist()
    joined = b"".join(v.ljust(width, b"\0") for v in values)
    return np.frombuffer(joined, np.uint8).reshape(-1, width), np.fromiter(map(len, values), np.int64, len(values))


def _common(rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each row with the one before; 0 for the first."""
    apart = rows[1:] != rows[:-1]
    first = np.where(apart.any(axis=1), apart.argmax(axis=1), rows.shape[1])
    return np.concatenate([[0], np.minimum(first, np.minimum(sizes[1:], sizes[:-1]))])


def intervals(common: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """(depth, first, end) of all runs of a sorted list with a common prefix of ``depth`` or more,
    that none of their neighbours shares and that is ``least`` long: the inner nodes of the
    interval tree, children before parents."""
    stack = [(0, 0)]
    for i, depth in enumerate([*common.tolist()[1:], -1], 1):
        left = i - 1
        while stack and depth < stack[-1][0]:
            deep, left = stack.pop()
            if deep >= least:
                yield deep, left, i
        if not stack or depth > stack[-1][0]:
            stack.append((depth, left))


def repeat_groups(h, before, before_sizes, after, after_sizes, rank) -> Iterator[tuple[int, int, np.ndarray]]:
    """(bytes to the left, bytes to the right, members by rank) of the maximal repeats around
    anchors. ``rank`` is the order of the anchors in the corpus."""
    width = after.shape[1]
    order = np.lexsort((after_sizes, np.ascontiguousarray(after).view(f"S{width}").reshape(-1), h))
    common = _common(after[order], after_sizes[order])
    common[_starts(h[order])] = 0
    left_order = np.lexsort((before_sizes, np.ascontiguousarray(before).view(f"S{before.shape[1]}").reshape(-1)))
    left_rank = np.empty(len(left_order), np.int64)
    left_rank[left_order] = np.arange(len(left_order))
    for right, first, end in intervals(common, GRAM):
        members = order[first:end]
        members = members[np.argsort(left_rank[members])]
        shared = _common(before[members], before_sizes[members])
        for left, a, b in intervals(shared, max(0, LENGTH - right)):
            if b - a > 1:
                group = members[a:b]
                yield left, right, group[np.argsort(rank[group])]


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = _columns(batches)
    if table is None:
        return
    windows = table["before"].is_null().to_numpy()
    strings = table.filter(pa.array(windows))
    if strings.num_rows:
        h, ctx, rid, pos = (strings[c].to_numpy() for c in ("h", "ctx", "rid", "pos"))
        o = np.lexsort((pos, rid, ctx, h))
        o = o[_starts(h[o], ctx[o], rid[o], pos[o])]  # neighbouring anchors may hold the same string
        spans, _ = _classes(h[o], ctx[o], rid[o], pos[o], np.zeros(len(o), np.int64), np.full(len(o), LENGTH))
        if len(spans[0]):
            yield _rows(FOUND, [*spans, None, None])
    table = table.filter(pa.array(~windows))
    if not table.num_rows:
        return
    h, rid, pos = (table[c].to_numpy() for c in ("h", "rid", "pos"))
    before, before_sizes = _matrix(table["before"], LEFT)
    after, after_sizes = _matrix(table["after"], LENGTH)
    rank = np.empty(len(rid), np.int64)
    rank[np.lexsort((pos, rid))] = np.arange(len(rid))
    found: list[tuple] = []
    for left, right, group in repeat_groups(h, before, before_sizes, after, after_sizes, rank):
        first, rest = group[0], group[1:]
        found.append((rid[rest], pos[rest] - left, pos[rest] + right, np.full(len(rest), rid[first]), np.full(len(rest), pos[first] - left)))
        if len(found) > 20_000:
            yield _rows(FOUND, [*_joined(*(np.concatenate(c) for c in zip(*found))), None, None])
            found = []
    if found:
        yield _rows(FOUND, [*_joined(*(np.concatenate(c) for c in zip(*found))), None, None])


def numbered(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``rid``, ``doc_id``, ``text``: ids themselves where they tell all rows apart, else numbers in
    the order of (id, hash of the text)."""
    pairs = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    repeated = pairs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("doc_id IS NULL OR n > 1")
    if repeated.isEmpty():
        return pairs.select(F.col("doc_id").alias("rid"), "doc_id", "text")
    h = F.xxhash64("text")
    ordered = pairs.withColumn("h", h).repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h")
    return write_and_reread(ordered.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text"), "numbered")


def repeats(rows: DataFrame, hot: int = HOT) -> DataFrame:
    """Occurrences [``start``, ``stop``) of strings of at least ``LENGTH`` bytes in ``rid``, each with
    an earlier occurrence from ``first_start`` in ``first_rid``. ``rows``: ``rid``, ``text``."""
    anchors = rows.select("rid", "text").mapInArrow(_map_anchors, ANCHORS)
    merged = write_and_reread(anchors.repartition("h").mapInArrow(_merge_anchors, FOUND), "anchors")
    wanted = merged.where("stop IS NULL").groupBy("rid").agg(F.collect_list(F.struct("start", "h", "classes")).alias("wanted"))
    around = rows.select("rid", "text").join(wanted, "rid").mapInArrow(_surroundings(hot), AROUND)
    more = around.repartition("h").mapInArrow(_repeats, FOUND)
    names = ["rid", "start", "stop", "first_rid", "first_start"]
    return merged.where("stop IS NOT NULL").select(*names).unionByName(more.select(*names))


def merged_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc, text, spans in zip(*(c.to_pylist() for c in batch.columns)):
            data, gone = text.encode(), merged_spans([(s["start"], s["stop"]) for s in spans or ()])
            edges = [0, *(x for span in gone for x in span), len(data)]
            kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))
            rows.append((doc, len(data), len(data) - len(kept), len(gone), kept))
        doc, size, removed, n, kept = zip(*rows) if rows else ((),) * 5
        yield pa.RecordBatch.from_arrays(
            [pa.array(doc, pa.int64()), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(n, pa.int64()), pa.array(kept, pa.binary())],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
        )


def removed(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept``: the bytes that stay."""
    rows = numbered(docs)
    found = write_and_reread(repeats(rows, hot), "repeats")
    spans = found.groupBy("rid").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    joined = rows.join(spans, "rid", "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(_cut, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")


def digest(cut: DataFrame) -> DataFrame:
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
