"""Vector search and vector codes against plain numpy, on odd rows too."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from caselens.llm import op11_vector_search as search
from caselens.llm import op12_vector_codes as codes

WIDTH = 8
SCHEMA = "vec_id bigint, embedding array<float>, label int, row int, id string, v int, q int, shard string, x int, near int"


def table(spark, n=600, seed=3):
    """Clustered vectors with ties, repeated rows, nulls and vectors that take no part."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, WIDTH))
    rows = [(i, (centres[i % 6] * (1 + i % 3) + 0.2 * rng.normal(size=WIDTH)).tolist(), i % 5 or None) for i in range(n)]
    same = [0.5, -0.25, 0.125, 0.0, 1.0, -1.0, 0.75, 0.5]
    rows += [(n + i, same, 9) for i in range(200)]  # a third of a table of equal vectors
    rows += [(20, rows[20][1], 0), (20, rows[20][1], 0), (40, [-x for x in same], None), (None, same, 1), (None, same, 1)]
    rows += [(n + 300, None, 1), (n + 320, [], 1), (n + 340, [0.0] * WIDTH, 1), (n + 360, [float("nan")] * WIDTH, 1)]
    rows += [(n + 380, [1.0] * 7 + [None], 1), (n + 400, [1.0] * 7 + [float("inf")], None), (-20, [0.0] * 7 + [-1.0], None)]
    extra = (1, "id", 2, 3, "s", 4, 5)
    return spark.createDataFrame([(*r, *extra) for r in rows], SCHEMA).repartition(3)


def plain(df):
    rows = [(r.vec_id, r.embedding, r.label) for r in df.select("vec_id", "embedding", "label").collect()]
    good = lambda v: v and all(x is not None and math.isfinite(x) for x in v)
    return [(i, [float(x) for x in v], label) for i, v, label in rows if good(v)]


def nearest(rows, k):
    """(query_id, rank, vec_id, score) of all queries, added component by component."""
    rows = [(i, v) for i, v, _ in rows if any(v)]
    out = []
    for qi, qv in rows:
        if qi is None or qi % 20:
            continue
        scored = []
        for ci, cv in rows:
            if ci != qi:
                total = 0.0
                for a, b in zip(qv, cv):
                    total += a * b
                scored.append((-total, ci is None, ci or 0, ci))
        out += [(qi, rank + 1, s[3], -s[0]) for rank, s in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("shard_rows,k", [(65_536, 20), (100, 3), (300, 2000)])
def test_exact_search_finds_what_comparing_everything_finds(spark, shard_rows, k):
    df = table(spark)
    rows = search.usable(df)
    index = search.build_index(rows, shard_rows, least_shards=2)
    got = search.search(index, rows.where("id % 20 = 0"), k).collect()
    assert sorted([tuple(r) for r in got], key=repr) == nearest(plain(df), k)


def test_every_row_is_in_the_index(spark):
    rows = search.usable(table(spark))
    index = search.build_index(rows, 100, 3).collect()
    assert sum(len(r.ids) // 8 for r in index) == rows.count()


def test_a_larger_factor_compares_less_and_finds_most():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 16))
    points = centres[rng.integers(0, 40, 8000)] + 0.15 * rng.normal(size=(8000, 16))
    ids, queries = np.arange(8000), np.arange(0, 8000, 100)
    tree = search.Tree.of(points, ids)
    exact = tree.search(points[queries], ids[queries], 20)
    relaxed = tree.search(points[queries], ids[queries], 20, 2.0)
    recall = np.mean([len(set(a) & set(b)) / 20 for a, b in zip(exact.ids, relaxed.ids)])
    assert recall >= 0.9
    assert relaxed.compared < exact.compared < len(queries) * len(points)
    products = points[queries] @ points.T
    products[np.arange(len(queries)), queries] = -np.inf
    assert np.allclose(np.sort(exact.scores)[:, ::-1], np.sort(products)[:, ::-1][:, :20])


def test_a_tree_survives_its_row():
    rng = np.random.default_rng(2)
    points = rng.normal(size=(1000, 4))
    tree = search.Tree.of(points, np.arange(1000), leaf=16)
    again = search.Tree.of_row(*tree.row())
    a, b = (t.search(points[:50], np.arange(50), 5) for t in (tree, again))
    assert (a.ids == b.ids).all() and (a.scores == b.scores).all() and a.compared < 50 * 1000


def test_search_of_no_rows_and_of_mixed_widths(spark):
    none = search.usable(table(spark).limit(0))
    assert search.search(search.build_index(none), none).collect() == []
    mixed = search.usable(spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0])], "vec_id int, embedding array<double>"))
    with pytest.raises(Exception, match="components|widths"):
        search.search(search.build_index(mixed, least_shards=1), mixed).collect()


def encoded(rows, entries=256, parts=4, rounds=4):
    """Codes and books by comparing everything."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    x = np.array([[math.floor(1024 * c) for c in v] for _, v, _ in rows], dtype=np.int64)
    x = x.reshape(len(rows), parts, -1)
    books = x[:entries].transpose(1, 0, 2).copy()
    nearest = lambda: np.stack([((x[:, p, None] - books[p]) ** 2).sum(2).argmin(1) for p in range(parts)], 1)
    for _ in range(rounds):
        own = nearest()
        for p in range(parts):
            for e in set(own[:, p].tolist()):
                members = x[own[:, p] == e, p]
                books[p, e] = [int(s) // len(members) for s in members.sum(0)]
    own = nearest()
    error = sum(((x[:, p] - books[p][own[:, p]]) ** 2).sum(1) for p in range(parts))
    by_label = {}
    for (_, _, label), e in zip(rows, error):
        by_label[label] = by_label.get(label, 0) + int(e)
    hashed = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return [(r[0], bytes(o.tolist()).hex(), int(e), by_label[r[2]], hashed) for r, o, e in zip(rows, own, error)]


@pytest.mark.parametrize("n,entries,bounds", [(600, 256, 16), (600, 32, 4), (600, 32, 32), (30, 256, 16)])
def test_codes_equal_comparing_everything(spark, n, entries, bounds):
    df = table(spark, n)
    got = codes.digest(*codes.fit_and_encode(df, entries=entries, bounds=bounds)).collect()
    assert sorted([tuple(r) for r in got], key=repr) == sorted(encoded(plain(df), entries), key=repr)


def test_bounds_hold_and_save_comparisons():
    rng = np.random.default_rng(5)
    centres = rng.integers(-900, 900, (40, 6))
    x = centres[rng.integers(0, 40, 3000)] + rng.integers(-60, 60, (3000, 6))
    book = x[:40].copy()
    state, _ = codes.listed(x, book, 8)
    certain = 0
    for _ in range(6):
        own = state.near[:, 0]
        renewed = np.array([x[own == e].sum(0) // max(1, (own == e).sum()) if (own == e).any() else book[e] for e in range(40)])
        drift = codes._drift(book, renewed)
        book = renewed
        state, need = codes.reassigned(x, book, state, drift)
        distances = codes.squared(x, book)
        assert (state.near[:, 0] == distances.argmin(1)).all()
        true = np.sqrt(distances.astype(float))
        assert (state.upper >= true[np.arange(len(x)), state.near[:, 0]] - 1e-6).all()
        for place in range(state.near.shape[1]):  # each bound holds for all entries from its place on
            unlisted = true.copy()
            np.put_along_axis(unlisted, state.near[:, : place + 1].astype(int), np.inf, 1)
            bound = np.minimum.accumulate(state.lower[:, ::-1], 1)[:, ::-1][:, place]
            assert (bound <= unlisted.min(1) + 1e-6).all()
        certain += (need == 1).sum()
    assert certain > len(x)  # of 6 rounds


def test_list_length_follows_the_needs():
    needs = np.zeros(codes.ENTRIES + 2, np.int64)
    assert codes.adapted(16, needs) == codes.LEAST_BOUNDS
    needs[1], needs[5], needs[9], needs[200] = 10_000, 900, 90, 10
    assert codes.adapted(16, needs) == 9
    assert codes.adapted(8, needs) == 8


def test_large_components_are_exact_or_refused(spark):
    rows = [(i, [float(20_000 - i)] * 4 + [i / 3] * 12, 1) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id int, embedding array<double>, label int")
    got = codes.digest(*codes.fit_and_encode(df, entries=8)).collect()
    assert sorted(tuple(r) for r in got) == sorted(encoded(plain(df), 8))
    with pytest.raises(ValueError, match="64 bits"):
        codes.fit_and_encode(df.withColumn("embedding", F.transform("embedding", lambda v: v * 1e6)))


def test_codes_of_no_rows_and_of_odd_widths(spark):
    assert codes.digest(*codes.fit_and_encode(table(spark).limit(0))).collect() == []
    assert codes.digest(*codes.fit_and_encode(table(spark).where("embedding is null"))).collect() == []
    with pytest.raises(ValueError, match="width"):
        codes.fit_and_encode(spark.createDataFrame([(1, [1.0, 2.0, 3.0], 1)], "vec_id int, embedding array<double>, label int"))
