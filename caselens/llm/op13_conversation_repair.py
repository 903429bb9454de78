"""Conversation repair: the cheapest edits that make a conversation alternate.

A conversation is a lattice: rows read so far by what the last role was (nothing, system, user,
assistant). Keeping, changing the role of, or deleting the next row moves on by one row, inserting
an empty turn moves within it; each edit has a cost, and a repaired conversation is a path from
the start to the end after nothing or an assistant. The cheapest paths are found from both ends:
one heap of lattice points reached from the start, one of points from which the end is reached;
the side whose next point is cheaper goes on until both next costs together exceed the best
path, so that every crossing of that cost is there. Of all paths through them the one
whose edits, written one after another, come first is walked from the start.

Rows meet in two shuffles by conversation: without texts (faults are judged before, by columns)
to find the edits, and with texts to hash what is repaired. Both are streams in order. Of a
conversation of any length a task holds ``CHUNK`` rows of the lattice and the edits so far, for
each state at the cut the best: paths to the same cut and state compare as their edits do, as
none can be the beginning of another. The hash is one sequential digest, so a conversation passes one task.
Rows alike in all columns are counted before they are shuffled for the edits.

Defined results: nulls are one space (in a role, text, and in what the damage hashes); null ids are
one conversation, null turns come first. Rows with the same turn are ordered by role, then by
the digest of the text. A role counts by its first character; an empty one is neither of the
three. A conversation without rows has zeros, no edits and the hash of nothing. Other columns are not
read. No rows give an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

SPACE = " \t\n\x0b\x0c\r"
ENDS = (".", "!", "?")
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5  # costs
START, SYSTEM, USER, ASSISTANT = range(4)  # what came last
AFTER = {"s": (START,), "u": (START, SYSTEM, ASSISTANT), "a": (USER,)}  # states a role may follow
STATE = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
NAMES = {USER: "user", ASSISTANT: "assistant"}
FINAL = (START, ASSISTANT)
FINE, CUT_OFF, BLANK, DUPLICATE = range(4)  # faults
CHUNK = 4096
Row = tuple[str, int]  # initial of the role ("x" for others), fault


def damaged(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, gone) of the rows of ``turns`` after a damage that the checksum of
    id and turn decides; a dropped row stays with ``gone``, for its conversation's sake."""
    said = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    rows = turns.select(
        "conv_id",
        "turn",
        F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"),
        F.pmod(F.crc32(said), F.lit(20)).cast("int").alias("way"),
    )
    text = F.when(F.col("way") == 1, "").when(F.col("way") == 2, F.translate("text", "".join(ENDS), "")).otherwise(F.col("text"))
    times = F.when(F.col("way") == 3, 2).otherwise(1)
    return rows.select(
        "conv_id",
        "turn",
        F.when(F.col("way") == 4, "user").otherwise(F.col("role")).alias("role"),
        text.alias("text"),
        (F.col("way") == 0).alias("gone"),
        F.explode(F.array_repeat(F.lit(0), times)).alias("_"),
    ).drop("_")


def whole(turns: DataFrame) -> DataFrame:
    """The same columns of rows as they are."""
    columns = [F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")]
    return turns.select("conv_id", "turn", *columns, F.lit(False).alias("gone"))


def _digest(text: str = "text") -> Column:
    return F.unhex(F.sha2(text, 256))


def faults(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, digest, gone, fault, copies): rows alike in all columns once."""
    inked = F.rtrim("text", F.lit(SPACE))
    light = rows.select(
        "conv_id",
        "turn",
        "role",
        _digest().alias("digest"),
        "gone",
        F.when(inked == "", BLANK).when(F.substring(inked, -1, 1).isin(*ENDS), FINE).otherwise(CUT_OFF).alias("own"),
    )
    light = light.groupBy(*light.columns).agg(F.count(F.lit(1)).alias("copies"))
    earlier = Window.partitionBy("conv_id", "role", "digest", "gone").orderBy(F.col("turn").asc_nulls_first())
    seen = (F.row_number().over(earlier) > 1) & (F.col("own") != BLANK)
    return light.select(
        "conv_id", "turn", "role", "digest", "gone", F.when(seen, DUPLICATE).otherwise(F.col("own")).alias("fault"), "copies"
    )


def _edits(row: Row, state: int) -> Iterator[tuple[str, int, int]]:
    """(letter, cost, state after) of what can be done with a row after ``state``."""
    initial, fault = row
    yield "D", DELETE, state
    if fault in (BLANK, DUPLICATE):
        return
    extra = TRUNCATED if fault == CUT_OFF else 0
    if state in AFTER.get(initial, ()):
        yield "K", KEEP + extra, STATE[initial]
    for other in ("u", "a"):
        if other != initial and state in AFTER[other]:
            yield "R", REROLE + extra, STATE[other]


def _inserted(state: int) -> int:
    return ASSISTANT if state == USER else USER


class Lattice:
    """Points 4 * (rows read) + state, of rows of a conversation; without ``tail`` nothing is
    inserted after the last of them, which is left to the rows that follow."""

    def __init__(self, rows: list[Row], tail: bool = True):
        self.rows, self.tail = rows, tail
        forms = {row: [list(_edits(row, s)) for s in range(4)] for row in set(rows)}
        back = {}
        for row, by_state in forms.items():
            back[row] = [[] for _ in range(4)]
            for state, edits in enumerate(by_state):
                for letter, cost, after in edits:
                    back[row][after].append((letter, cost, state))
        self.forms, self.back = forms, back

    def ahead(self, point: int) -> list[tuple[str, int, int]]:
        i, state = divmod(point, 4)
        out = []
        if i < len(self.rows):
            out = [(letter, cost, 4 * i + 4 + after) for letter, cost, after in self.forms[self.rows[i]][state]]
        if i < len(self.rows) or self.tail:
            out.append(("I", INSERT, 4 * i + _inserted(state)))
        return out

    def behind(self, point: int) -> list[tuple[str, int, int]]:
        i, state = divmod(point, 4)
        out = []
        if i:
            out = [(letter, cost, 4 * i - 4 + before) for letter, cost, before in self.back[self.rows[i - 1]][state]]
        if i < len(self.rows) or self.tail:
            out += [("I", INSERT, 4 * i + s) for s in range(4) if _inserted(s) == state]
        return out

    def cheapest(self, start: int, ends: tuple[int, ...]) -> tuple[int, str] | None:
        """Cost and edits from state ``start`` before the rows to one of ``ends`` after them."""
        last = 4 * len(self.rows)
        known = ({start: 0}, {last + s: 0 for s in ends})
        heaps = ([(0, start)], [(0, last + s) for s in ends])
        settled = (set(), set())
        near = (self.ahead, self.behind)
        best = None
        while heaps[0] and heaps[1]:
            if best is not None and heaps[0][0][0] + heaps[1][0][0] > best:
                break  # every crossing of the best cost is known
            side = 0 if heaps[0][0][0] <= heaps[1][0][0] else 1
            cost, point = heapq.heappop(heaps[side])
            if point in settled[side]:
                continue
            settled[side].add(point)
            if point in known[1 - side]:
                total = cost + known[1 - side][point]
                best = total if best is None else min(best, total)
            for _, step, other in near[side](point):
                if cost + step < known[side].get(other, cost + step + 1):
                    known[side][other] = cost + step
                    heapq.heappush(heaps[side], (cost + step, other))
        if best is None:
            return None
        settled[0].add(start)  # the costs of both ends are known, whether a heap came to them or not
        settled[1].update(last + s for s in ends)
        return best, self._first(start, last, best, known, settled)

    def _first(self, start: int, last: int, best: int, known, settled) -> str:
        """Of the edits of all cheapest paths those that come first as text."""
        (from_start, to_end), (met, open_) = known, settled
        # points of the first half from which a cheapest path goes on to the second
        crossing = [p for p in met if p in open_ and from_start[p] + to_end[p] == best]
        crossing += [
            p
            for p in met
            for _, step, other in self.ahead(p)
            if other in open_ and from_start[p] + step + to_end[other] == best
        ]
        good, todo = set(crossing), crossing
        while todo:
            point = todo.pop()
            for _, step, other in self.behind(point):
                if other in met and other not in good and from_start[other] + step == from_start[point]:
                    good.add(other)
                    todo.append(other)
        edits, here = [], {start: 0}
        while not any(p >= last and p in open_ and to_end[p] == 0 and cost == best for p, cost in here.items()):
            ways = {}
            for point, cost in here.items():
                for letter, step, other in self.ahead(point):
                    total = cost + step
                    if (other in good and from_start[other] == total) or (other in open_ and total + to_end[other] == best):
                        ways.setdefault(letter, {})[other] = total
            letter = min(ways)
            edits.append(letter)
            here = ways[letter]
        return "".join(edits)


class Repair:
    """The cheapest edits of a conversation whose rows come one by one."""

    def __init__(self, chunk: int = CHUNK):
        self.chunk, self.rows = chunk, []
        self.before = {START: (0, "")}  # per state at the last cut: cost and edits so far

    def add(self, row: Row) -> None:
        if len(self.rows) == self.chunk:
            lattice, after = Lattice(self.rows, tail=False), {}
            for end in range(4):
                found = self._through(lattice, (end,))
                if found is not None:
                    after[end] = found
            self.before, self.rows = after, []
        self.rows.append(row)

    def _through(self, lattice: Lattice, ends: tuple[int, ...]) -> tuple[int, str] | None:
        ways = []
        for state, (cost, edits) in self.before.items():
            found = lattice.cheapest(state, ends)
            if found is not None:
                ways.append((cost + found[0], edits, found[1]))
        if not ways:
            return None
        cost, edits, more = min(ways)
        return cost, edits + more

    def finish(self) -> tuple[int, str]:
        return self._through(Lattice(self.rows), FINAL)


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


class _Tally:
    """What is known of a conversation after its rows so far."""

    def __init__(self, conversation, chunk: int):
        self.conversation, self.repair = conversation, Repair(chunk)
        self.counts = dict.fromkeys(range(4), 0)
        self.illegal, self.last = 0, None
        self.low = self.high = None
        self.turns = 0

    def add(self, turn: int | None, role: str, fault: int, copies: int) -> None:
        initial = role[:1] if role[:1] in STATE else "x"
        if turn is not None and turn != self.high:
            self.low = turn if self.low is None else self.low
            self.high = turn
            self.turns += 1
        for copy in range(copies):
            own = fault if copy == 0 or fault == BLANK else DUPLICATE
            self.counts[own] += 1
            self.illegal += self.last is not None and self.last + initial not in ("su", "ua", "au")
            self.last = initial
            self.repair.add((initial, own))

    def row(self) -> tuple:
        cost, edits = self.repair.finish()
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        c = self.counts
        return (self.conversation, gaps, c[BLANK], c[DUPLICATE], c[CUT_OFF], self.illegal, cost, edits)


def _lists(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    return zip(*[batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names])


def _batch(rows: list[tuple], kind: pa.DataType, names: list[str], text: set[str]) -> pa.RecordBatch:
    kinds = [kind if n == "conv_id" else pa.string() if n in text else pa.int64() for n in names]
    columns = zip(*rows) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names)


def _edited(chunk: int):
    names = ["conv_id", *_COUNTS, "audit"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = kind = None
        for batch in batches:
            kind, done = batch.schema.field("conv_id").type, []
            for conversation, turn, role, gone, fault, copies in _lists(batch, "conv_id", "turn", "role", "gone", "fault", "copies"):
                if tally is None or conversation != tally.conversation:
                    if tally is not None:
                        done.append(tally.row())
                    tally = _Tally(conversation, chunk)
                if not gone:
                    tally.add(turn, role, fault, copies)
            yield _batch(done, kind, names, {"audit"})
        if tally is not None:
            yield _batch([tally.row()], kind, names, {"audit"})

    return run


class Replay:
    """Lines ``role:text`` of a conversation after its edits, as its rows come."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, START

    def inserts(self) -> Iterator[tuple[str, str]]:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            self.state = _inserted(self.state)
            yield NAMES[self.state], ""

    def row(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        yield from self.inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.state = STATE[role[:1]]
            yield role, text
        elif edit == "R":
            self.state = _inserted(self.state)
            yield NAMES[self.state], text


class _Hash:
    def __init__(self, found: tuple):
        self.found, self.replay, self.sha, self.lines = found, Replay(found[-1]), hashlib.sha256(), 0

    def take(self, lines: Iterator[tuple[str, str]]) -> None:
        for role, text in lines:
            self.sha.update(("\n" if self.lines else "").encode() + f"{role}:{text}".encode())
            self.lines += 1

    def row(self) -> tuple:
        self.take(self.replay.inserts())
        return (*self.found, self.sha.hexdigest())


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", *_COUNTS, "audit", "repaired_sha256"]
    current = kind = None
    for batch in batches:
        kind, done = batch.schema.field("conv_id").type, []
        for row in _lists(batch, *names[:-1], "is_row", "role", "text"):
            if not row[-3]:
                if current is not None:
                    done.append(current.row())
                current = _Hash(row[:-3])
            else:
                current.take(current.replay.row(*row[-2:]))
        yield _batch(done, kind, names, {"audit", "repaired_sha256"})
    if current is not None:
        yield _batch([current.row()], kind, names, {"audit", "repaired_sha256"})


def _schema(turns: DataFrame, *texts: str) -> StructType:
    numbers = [StructField(c, LongType()) for c in _COUNTS]
    return StructType([StructField("conv_id", turns.schema["conv_id"].dataType), *numbers, *[StructField(c, StringType()) for c in texts]])


def audits(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of each conversation."""
    found = faults(rows).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "digest")
    light = found.select("conv_id", "turn", "role", "gone", "fault", "copies")
    return light.mapInArrow(_edited(chunk), _schema(rows, "audit"))


def repair(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The columns of :func:`audits` and ``repaired_sha256``, from rows of :func:`damaged` or :func:`whole`."""
    texts = rows.where(~F.col("gone")).select(
        "conv_id", "turn", "role", "text", _digest().alias("digest"), F.lit(True).alias("is_row")
    )
    both = audits(rows, chunk).withColumn("is_row", F.lit(False)).unionByName(texts, allowMissingColumns=True)
    both = both.repartition("conv_id").sortWithinPartitions("conv_id", "is_row", "turn", "role", "digest")
    return both.drop("digest", "turn").mapInArrow(_hashed, _schema(rows, "audit", "repaired_sha256"))
