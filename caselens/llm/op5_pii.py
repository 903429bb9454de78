"""Personal data: candidate spans, boosted trees, calibrated thresholds.

Four kinds have exact rules (``base_spans``): email, ip, card, phone. Beside them, generators
with high recall propose overlapping candidates: every run of digit groups of up to
``MOST_DIGITS`` digits, and every whole word with an at sign in it. Boosted trees score candidates by format (digits, groups,
separators, checksum) and context (what stands around them). They learn from a bounded sample
which candidates the rules confirm; a leading plus is left out of the features, so a number
written like the confirmed ones but without it can be found. The threshold is the lowest at
which held-out candidates are right with ``PRECISION``. Selected candidates that touch no
base span are added, as ``number`` or ``address``; the best of overlapping ones stays.

The sample has about ``SAMPLE_DOCS`` documents, by a hash of their id, and at most
``SAMPLE_ROWS`` candidates; all documents are searched. Nothing is shuffled. Every scan is
linear in the text.

Defined results: null and empty texts have no spans; without candidates to learn from only
base spans are found; rows that repeat give the same result each; offsets are code points,
ends exclusive; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from caselens.llm.boosting import Trees, calibrated_threshold

SAMPLE_DOCS = 8000
SAMPLE_ROWS = 100_000
PRECISION = 0.995
MOST_DIGITS = 20
LEAST_LENGTH = 7
CHUNK = 4096
KINDS = ("email", "ip", "card", "phone", "address", "number")
RANK = {kind: i for i, kind in enumerate(KINDS)}

Span = tuple[int, int, str]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[^0-9]")
_NUMBER = re.compile(r"\(?[0-9](?:[0-9 ().-]*[0-9])?")
_RUNS = re.compile(r"[0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    """A match begins with the run of allowed characters before an at sign, after the last match."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        end = _DOMAIN.match(text, at + 1) if start < at else None
        if end:
            yield start, end.end(), "email"
            done = end.end()
        at = text.find("@", max(at + 1, done))


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def base_spans(text: str) -> list[Span]:
    """Spans by the exact rules, leftmost and without overlap within each kind."""
    found = list(_emails(text)) if "@" in text else []
    for m in _IP.finditer(text):
        if all(_octet(p) for p in m[0].split(".")):
            found.append((m.start(), m.end(), "ip"))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = _DIGITS.sub("", m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), m.end(), "card"))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_DIGITS.sub("", m[0])) <= 15:
                found.append((m.start(), m.end(), "phone"))
    return sorted(found, key=lambda s: (s[0], RANK[s[2]]))


def _numbers(text: str) -> Iterator[Span]:
    """In each maximal run of digits and separators: from each group to each later one with at most
    ``MOST_DIGITS`` digits in all, long before short, and single groups and the whole run whatever their digits."""
    for m in _NUMBER.finditer(text):
        if m.end() - m.start() < LEAST_LENGTH:
            continue
        groups = [r.span() for r in _RUNS.finditer(text, m.start(), m.end())]
        for i, (start, end) in enumerate(groups):
            ends, digits = [end], end - start
            for a, b in groups[i + 1 : i + MOST_DIGITS]:
                digits += b - a
                if digits > MOST_DIGITS:
                    break
                ends.append(b)
            if i == 0 and ends[-1] != m.end():
                ends.append(m.end())
            for stop in reversed(ends):
                if stop - start >= LEAST_LENGTH:
                    if start > m.start() and text[start - 1] == "(":
                        yield start - 1, stop, "number"
                    yield start, stop, "number"


def candidates(text: str) -> Iterator[Span]:
    """Proposed spans, overlapping: numbers, and words with an at sign inside."""
    yield from _numbers(text)
    at = text.find("@")
    while at >= 0:
        left, right = at, at + 1
        while left > 0 and not text[left - 1].isspace():
            left -= 1
        while right < len(text) and not text[right].isspace():
            right += 1
        if text.find("@", left + 1, right - 1) >= 0:
            yield left, right, "address"
        at = text.find("@", right)


def _class(c: str) -> int:
    return 0 if not c else 1 if c.isspace() else 2 if c.isalpha() else 3 if c.isdigit() else 4


def features(text: str, span: Span) -> list[float]:
    start, end, kind = span
    s = text[start:end]
    runs = [len(r) for r in _RUNS.findall(s)] or [0]
    digits = _DIGITS.sub("", s)
    before, after = text[max(0, start - 24) : start].rstrip("+"), text[end : end + 24]
    plain = before.rstrip()
    parts = s.split(".")
    return [
        kind == "address", len(s), len(digits), sum(c.isalpha() for c in s), len(runs), max(runs), min(runs),
        runs[0], runs[-1], s.count("."), s.count("-"), s.count(" "), s.count("(") + s.count(")"),
        s.count("@"), len(set(digits)), 12 <= len(digits) <= 19 and luhn(digits),
        len(parts) == 4 and all(p.isdigit() and p.isascii() and _octet(p) for p in parts),
        _class(before[-1:]), _class(after[:1]), sum(c.isalpha() for c in before), plain[-1:] in (":", "="),
        sum(c.isdigit() for c in before), sum(c.isdigit() for c in after), s[-1:].isalnum(),
    ]


WIDTH = len(features("x", (0, 1, "number")))


class Model:
    """Trees and threshold; without trees nothing is added."""

    def __init__(self, trees: Trees | None = None, threshold: float = 2.0):
        self.trees, self.threshold = trees, threshold

    @classmethod
    def fitted(cls, x: np.ndarray, y: np.ndarray, held: np.ndarray, precision: float = PRECISION) -> Model:
        if len(y) < 100 or y[~held].min(initial=1) == y[~held].max(initial=0):
            return cls()
        trees = Trees(x[~held], y[~held])
        return cls(trees, calibrated_threshold(trees.probability(x[held]), y[held], precision))

    def added(self, text: str, base: list[Span]) -> list[Span]:
        if self.trees is None or self.threshold > 1:
            return []
        covered = bytearray(len(text))
        for start, end, _ in base:
            covered[start:end] = b"\1" * (end - start)
        proposed = (c for c in candidates(text) if covered.find(1, c[0], c[1]) < 0)
        likely: list[tuple[float, Span]] = []
        while chunk := list(islice(proposed, CHUNK)):
            p = self.trees.probability(np.array([features(text, c) for c in chunk], float))
            likely += [(float(p[i]), chunk[i]) for i in np.flatnonzero(p >= self.threshold)]
        kept: list[Span] = []
        for _, c in sorted(likely, key=lambda x: -x[0]):
            if covered.find(1, c[0], c[1]) < 0:
                kept.append(c)
                covered[c[0] : c[1]] = b"\1" * (c[1] - c[0])
        return kept


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates of the sample with features and whether a rule confirms them: a base span that
    begins at the candidate, or at the plus before it, and ends with it."""
    def rows() -> Iterator[tuple[int, list[float], bool]]:
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not text:
                    continue
                ends = {}
                for a, b, _ in base_spans(text):
                    ends.setdefault(b, []).append(a)
                for c in candidates(text):
                    plus = c[0] > 0 and text[c[0] - 1] == "+"
                    yield doc, features(text, c), any(a == c[0] - plus for a in ends.get(c[1], ()))

    found = rows()
    while chunk := list(islice(found, CHUNK)):
        ids, x, y = zip(*chunk)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(np.array(x, float).tolist(), pa.list_(pa.float64())), pa.array(y, pa.bool_())],
            names=["h", "x", "y"],
        )


def fit(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", sample_docs: int = SAMPLE_DOCS, sample_rows: int = SAMPLE_ROWS) -> Model:
    total = docs.count()
    if not total:
        return Model()
    h = F.xxhash64(F.col(id_column))
    part = F.pmod(h, F.lit(1 << 30)) < int(min(1.0, sample_docs / total) * (1 << 30))
    sample = docs.where(part).select(h.alias("h"), F.col(text_column).alias("text"))
    rows = sample.mapInArrow(_labelled, "h bigint, x array<double>, y boolean").orderBy("h", "x").limit(sample_rows).collect()
    if not rows:
        return Model()
    x, y = np.array([r["x"] for r in rows], float), np.array([r["y"] for r in rows], float)
    held = np.array([(r["h"] >> 33) % 2 == 0 for r in rows])
    return Model.fitted(x, y, held)


FOUND = "doc_id bigint, base array<struct<start:int,end:int,kind:string>>, added array<struct<start:int,end:int,kind:string>>"
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))


def _dicts(spans: list[Span]) -> list[dict]:
    return [{"start": a, "end": b, "kind": k} for a, b, k in spans]


def _search(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, added = [], []
            for text in batch.column(1):
                text = text.as_py() or ""
                own = base_spans(text)
                base.append(_dicts(own))
                added.append(_dicts(sorted(model.value.added(text, own), key=lambda s: (s[0], RANK[s[2]]))))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(base, _SPANS), pa.array(added, _SPANS)], names=["doc_id", "base", "added"]
            )

    return run


def find(docs: DataFrame, model: Model | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id``, ``base`` spans by the rules, ``added`` spans by the model."""
    model = model or fit(docs, id_column, text_column)
    known = docs.sparkSession.sparkContext.broadcast(model)
    pairs = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).alias("text"))
    return pairs.mapInArrow(_search(known), FOUND)


def redact(text: str, spans: list[Span]) -> str:
    """Each run of overlapping spans becomes the kind of its first one in brackets."""
    out, done = [], 0
    for start, end, kind in sorted(spans, key=lambda s: (s[0], RANK[s[2]])):
        if start >= done:
            out += [text[done:start], f"[{kind.upper()}]"]
        done = max(done, end)
    return "".join([*out, text[done:]])


def _joined(spans: list[dict]) -> str:
    ordered = sorted(spans, key=lambda s: (s["start"], RANK[s["kind"]]))
    return ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in ordered)


def digest(found: DataFrame) -> DataFrame:
    """``doc_id``, base counts by kind, ``base_sha256``, ``spans``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, added = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            counts = [pa.array([sum(s["kind"] == k for s in own) for own in base], pa.int64()) for k in KINDS[:4]]
            sums = [hashlib.sha256(_joined(own).encode()).hexdigest() for own in base]
            joined = [_joined([*a, *b]) for a, b in zip(base, added)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *counts, pa.array(sums, pa.string()), pa.array(joined, pa.string())],
                names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
            )

    kinds = ", ".join(f"n_{k} bigint" for k in KINDS[:4])
    return found.mapInArrow(run, f"doc_id bigint, {kinds}, base_sha256 string, spans string")
