"""Exact copies, shingle sets, repeated strings, benchmark windows against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from caselens.llm import (
    components, op3_suffix_dedup as suffix_dedup, op7_jaccard_join as jaccard, op9_decontamination as decontamination,
    op10_exact_dedup as exact,
)
from tests.llm.conftest import LONG, ODD


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def frame(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in texts], "doc_id bigint, text string")


def test_exact_groups(odd, empty):
    groups = defaultdict(list)
    for i, t, *_ in ODD:
        groups[lower(t)].append(i)
    want = Counter()
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        for i in ids:
            keep = (max(known) if known else None) if len(ids) > 1 else i
            want[(i, keep, len(ids), i == keep, hashlib.sha256(text.encode()).hexdigest())] += 1
    got = Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact.exact_groups(odd).collect())
    assert got == want
    assert exact.exact_groups(empty).count() == 0


def test_only_ascii_letters_are_lowered(spark):
    got = exact.exact_groups(frame(spark, [(1, "ÀB"), (2, "àb"), (3, "Àb"), (4, "KK"), (5, "kK")])).collect()
    assert {r.doc_id: r.keep_id for r in got} == {1: 3, 2: 2, 3: 3, 4: 4, 5: 5}


# ---- Jaccard ---------------------------------------------------------------------------


def shingles(text, n=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def brute_components(texts, percent=85):
    sets = [shingles(t) for _, t in texts]
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if texts[i][0] is None or texts[j][0] is None:
                continue
            both = len(sets[i] & sets[j])
            if texts[i][0] == texts[j][0] or (both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both)):
                parent[root(i)] = root(j)
    least = defaultdict(list)
    for i, (doc, _) in enumerate(texts):
        if doc is not None:
            least[root(i)].append(doc)
    return Counter((doc, len(s), None if doc is None else min(least[root(i)])) for i, ((doc, _), s) in enumerate(zip(texts, sets)))


def near(spark, texts):
    got = jaccard.near_groups(frame(spark, texts)).collect()
    return Counter((r.doc_id, r.n_shingles, r.component_id) for r in got)


def varied(seed, base, n, edits):
    """Copies of ``base`` words with a few words changed each."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(rng.randint(0, edits)):
            words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(words))
    return out


def test_near_groups_of_all_sizes(spark, monkeypatch):
    rng = random.Random(1)
    texts = []
    for size in (1, 2, 3, 4, 5, 8, 11, 13, 15, 17, 20, 25, 40, 90):
        for k in range(4):
            base = [f"b{size}_{k}_{rng.randrange(30)}" for _ in range(size)]
            texts += varied(size * 10 + k, base, 6, 1 + size // 20)
    texts = list(zip(rng.sample(range(10_000), len(texts)), texts))
    want = brute_components(texts)
    assert near(spark, texts) == want
    monkeypatch.setattr(jaccard, "choose_boundary", lambda *_: 0)  # all sets heavy
    assert near(spark, texts) == want
    monkeypatch.setattr(jaccard, "choose_boundary", lambda *_: 16)
    assert near(spark, texts) == want


def test_large_groups_and_common_passages(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    rng = random.Random(2)
    passage = [f"p{i}" for i in range(40)]
    texts = varied(3, [f"g{i}" for i in range(80)], 60, 4)  # many links, not between all
    texts += varied(4, passage + ["tail"] * 3, 40, 5)
    texts += [" ".join(passage + [f"q{rng.randrange(10**6)}" for _ in range(rng.choice((3, 8, 60)))]) for _ in range(40)]
    texts += [texts[0]] * 30
    texts = list(zip(rng.sample(range(10_000), len(texts)), texts))
    assert near(spark, texts) == brute_components(texts)


def test_near_groups_of_odd_rows(spark, odd, empty):
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_groups(odd).collect())
    assert got == brute_components([(r[0], r[1]) for r in ODD])
    assert jaccard.near_groups(empty).count() == 0


def test_bounds():
    for s in range(1, 60):
        for t in range(s, 80):
            link = [k for k in range(1, s + 1) if 100 * k >= 85 * (s + t - k)]
            if link:
                assert jaccard.least_overlap(s, t) == link[0]
                assert s - link[0] < jaccard.prefix_length(s) and t - link[0] < jaccard.prefix_length(t)


def test_components_of_paths(spark):
    links = [(i, i + 1) for i in range(50)] + [(100, 105), (105, 103), (200, 200)]
    got = components.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()
    assert {r.node: r.component for r in got} == {**{i: 0 for i in range(51)}, 100: 100, 103: 100, 105: 100}


# ---- repeated strings --------------------------------------------------------------------


def brute_removed(texts):
    """Rows in order; texts of the same id in the order given."""
    seen, out = set(), []
    for _, text in texts:
        data = (text or "").encode()
        flags = bytearray(len(data))
        for s in range(len(data) - 99):
            w = data[s : s + 100]
            if w in seen:
                flags[s : s + 100] = b"\1" * 100
            else:
                seen.add(w)
        kept = bytes(c for c, f in zip(data, flags) if not f)
        spans = sum(f and (p == 0 or not flags[p - 1]) for p, f in enumerate(flags))
        out.append((len(data), sum(flags), spans, kept))
    return out


def cut(docs, **more):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.removed(docs, **more).collect()), key=repr)


@pytest.mark.parametrize("hot", [suffix_dedup.HOT, 1])
def test_repeated_strings(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "PIECE", 500)
    rng = random.Random(5)
    word = lambda: rng.choice(["ab", "é", "xyz", "\0", "the", "0"]) + rng.choice([" ", "", "q"])
    passages = ["".join(word() for _ in range(n)) for n in (30, 45, 60, 90, 200)]
    texts = []
    for i in range(60):
        parts = []
        for _ in range(rng.randint(0, 5)):
            p = rng.choice(passages)
            a = rng.randrange(len(p) // 2)
            parts += ["".join(word() for _ in range(rng.randint(0, 60))), p[a : a + rng.randint(20, len(p))]]
        texts.append((i, "".join(parts)))
    texts += [(100, "ab" * 400), (101, "a" * 99), (102, "a" * 100), (103, "a" * 101), (104, texts[3][1]), (105, None), (106, "")]
    want = sorted(((i, *w) for (i, _), w in zip(texts, brute_removed(texts))), key=repr)
    assert cut(frame(spark, texts).repartition(4), hot=hot) == want


def test_repeated_strings_of_documents(documents, rows):
    texts = [(r[0], r[1]) for r in rows]
    assert cut(documents) == sorted(((i, *w) for (i, _), w in zip(texts, brute_removed(texts))), key=repr)


def test_repeated_strings_of_odd_rows(odd, empty):
    got = suffix_dedup.removed(odd).collect()
    assert Counter((r.doc_id, r.n_bytes) for r in got) == Counter((i, len((t or "").encode())) for i, t, *_ in ODD)
    by_id = {r.doc_id: r for r in got if r.n_bytes}
    assert by_id[8].n_removed == len(LONG) + 3 - len(by_id[8].kept) and bytes(by_id[8].kept).endswith(b"end")
    twice = sorted(len(r.kept) for r in got if r.doc_id == 2)
    assert twice[0] == 0  # the repeated row goes whole
    assert suffix_dedup.removed(empty).count() == 0


def test_intervals_are_those_of_the_sorted_list():
    words = sorted(["banana", "ban", "bandana", "cab", "cabin", "cabinet", "x"])
    rows = np.array([list(w.ljust(8, "\0").encode()) for w in words], np.uint8)
    common = suffix_dedup._common(rows, np.array([len(w) for w in words]))
    assert set(suffix_dedup.intervals(common, 1)) == {(3, 0, 3), (3, 3, 6), (5, 4, 6)}


def test_all_occurrences_are_reported(spark):
    passage = "".join(f"{i:03d}" for i in range(60))
    texts = [(i, f"{'abcdefghij'[i] * 30}{passage}{'klmnopqrst'[i] * 30}") for i in range(8)]
    got = suffix_dedup.repeats(suffix_dedup.numbered(frame(spark, texts))).collect()
    assert {(r.rid, r.start, r.stop) for r in got} >= {(i, 30, 210) for i in range(1, 8)}
    assert all(texts[r.first_rid][1][r.first_start : r.first_start + r.stop - r.start] == texts[r.rid][1][r.start : r.stop] for r in got)


# ---- benchmark windows --------------------------------------------------------------------


def items_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def brute_hits(texts, items, width=10):
    out = []
    for doc, text in texts:
        words, flags, found = items_words(text), set(), set()
        for item, own in items:
            own = items_words(own)
            n = min(width, len(own))
            for i in range(len(own) - n + 1) if own else ():
                for j in range(len(words) - n + 1):
                    if words[j : j + n] == own[i : i + n]:
                        flags |= set(range(j, j + n))
                        found.add("null" if item is None else str(item))
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc, len(words), len(flags), len(found), sha, bool(flags)))
    return Counter(out)


ITEMS = [
    (1, "The quick, brown FOX jumps over the lazy dog and runs far"), (10, "two words"), (2, "two words"), (3, ""), (4, None), (None, "no id"),
    (5, "!!!"), (6, "word3x3 word4x4 word5x5 word6x6 word7x7 word8x8 word9x9 word10x10 word11x11 word12x12 word13x13"), (6, "élan"), (7, "id here"),
]


@pytest.mark.parametrize("part_bytes", [decontamination.PART_BYTES, 60])
def test_contamination(spark, part_bytes):
    texts = [(i, t) for i, t in dict((r[0], r[1][:6000] if r[1] else r[1]) for r in ODD).items() if i is not None or part_bytes > 60]
    benchmark = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    found = decontamination.contamination(frame(spark, texts), benchmark, part_bytes=part_bytes)
    got = decontamination.digest(found).collect()
    assert Counter(tuple(r) for r in got) == brute_hits(texts, ITEMS)


def test_every_row_has_its_own_result_with_many_parts(spark):
    """Rows without an id and rows that repeat one, all with hits of their own."""
    texts = [(r[0], r[1][:6000] if r[1] else r[1]) for r in ODD] + [(2, "two words"), (None, "Two words"), (None, "no id twice, no id")]
    benchmark = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    want = brute_hits(texts, ITEMS)
    for part_bytes in (decontamination.PART_BYTES, 60):
        found = decontamination.contamination(frame(spark, texts).repartition(3), benchmark, part_bytes=part_bytes)
        assert Counter(tuple(r) for r in decontamination.digest(found).collect()) == want


def test_contamination_of_odd_rows_and_empty_tables(spark, odd, empty):
    benchmark = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    assert decontamination.contamination(odd, benchmark).count() == len(ODD)
    assert decontamination.contamination(empty, benchmark).count() == 0
    assert decontamination.digest(decontamination.contamination(odd, benchmark.limit(0))).where("contaminated").count() == 0
    clean = decontamination.without_contaminated(odd, benchmark)
    assert clean.columns == odd.columns
    assert clean.count() == len(ODD) - sum(bool(r[2]) * n for r, n in brute_hits([(i, (t or "")[:6000]) for i, t, *_ in ODD], ITEMS).items())


def test_spans_are_taken_out(spark):
    docs = frame(spark, [(1, "Keep this. Two, WORDS; and that"), (2, "nothing"), (3, None)])
    benchmark = spark.createDataFrame([(1, "two words")], "item_id bigint, text string")
    got = {r.doc_id: r.text for r in decontamination.clean_spans(docs, decontamination.contamination(docs, benchmark)).collect()}
    assert got == {1: "Keep this. ; and that", 2: "nothing", 3: None}
