"""Searches that bound or quantise: bounded top-k, cell bounds, product codes."""

import pathlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from caselens.operators import bounds, pq, topk

SCHEMA = "source_table string, source_id string, kind int, embedding array<float>"
ASKED = "question_id string, embedding array<float>"
WIDTH = 8


def clustered(n=600, clusters=6, seed=1, spread=0.05):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, WIDTH))
    return [("t", f"{i:04d}", i % clusters, (centres[i % clusters] + spread * rng.normal(size=WIDTH)).tolist()) for i in range(n)]


def odd():
    """Equal vectors, zero vectors and NULLs beside the clusters."""
    rows = clustered(240)
    rows += [("t", f"same{i:03d}", 9, rows[0][3]) for i in range(120)]
    return rows + [("z", "1", 1, [0.0] * WIDTH), ("z", "2", 9, [0.0] * WIDTH), ("n", "1", 2, None)]


def records(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5, "source_id")


def questions(spark, rows, every=50):
    asked = [(r[1], r[3]) for r in rows[::every]] + [("none", None), ("zero", [0.0] * WIDTH)]
    return spark.createDataFrame(asked, ASKED)


def as_rows(found):
    columns = ["question_id", "source_table", "source_id", "distance", "rank"]
    return sorted([tuple(r) for r in found.select(*columns).collect()], key=repr)


def same(found, exact):
    a, b = as_rows(found), as_rows(exact)
    assert [r[:3] + r[4:] for r in a] == [r[:3] + r[4:] for r in b]
    for x, y in zip(a, b):
        assert x[3] is y[3] is None or x[3] == pytest.approx(y[3], abs=2e-9, nan_ok=True)


@pytest.mark.parametrize("k,sample_rows", [(5, 50), (5, 10**9), (500, 50)])
def test_two_passes_find_what_one_finds(spark, k, sample_rows):
    rows = odd()
    df, asked = records(spark, rows), questions(spark, rows)
    found = topk.nearest_bounded(df, asked, k, width=WIDTH, sample_rows=sample_rows)
    same(found, topk.nearest(df, asked, k, width=WIDTH))
    empty = topk.nearest_bounded(df.limit(0), asked, k, width=WIDTH)
    assert empty.count() == 0


def test_a_bound_keeps_the_candidates_few():
    """What a task hands on is within the bound; without one it is k per task."""
    rng = np.random.default_rng(0)
    units = topk.unit_rows(rng.normal(size=(4000, WIDTH)))
    question = units[:1]
    scores = topk.score_block(units, np.ones(len(units), bool), question)
    import pyarrow as pa

    ids = pa.table({"id": [f"{i:05d}" for i in range(len(units))]})
    bound = np.sort(scores[::10, 0])[4]  # the fifth nearest of a tenth
    handed = {}
    for limit in (None, np.array([bound])):
        handed[limit is None] = 0
        for at in range(0, 4000, 20):  # 200 small tasks
            best = topk.BestPerQuestion(1, ["id"], 5, limit)
            best.offer(ids.slice(at, 20), scores[at : at + 20], np.array([0]))
            result = best.result()
            handed[limit is None] += 0 if result is None else len(result)
    assert handed[True] == 1000 and handed[False] < 150


@pytest.mark.parametrize("wanted", [None, {"kind": [2]}, {"kind": [9, 1]}, {"kind": [77]}])
def test_bounds_find_what_a_scan_finds(spark, tmp_path, wanted):
    rows = odd()
    df, asked = records(spark, rows), questions(spark, rows)
    cells = bounds.build_bounded_cells(df, str(tmp_path / "cells"), width=WIDTH, filters=["kind"], n_cells=6)
    found = bounds.nearest_by_bounds(cells, asked, 10, wanted, first_cells=1)
    scanned = df if wanted is None else df.where(F.col("kind").isin(wanted["kind"]))
    same(found, topk.nearest(scanned, asked, 10, width=WIDTH))


def test_more_than_there_are_reads_everything(spark, tmp_path):
    rows = odd()
    df, asked = records(spark, rows), questions(spark, rows, 150)
    cells = bounds.build_bounded_cells(df, str(tmp_path / "cells"), width=WIDTH, n_cells=6)
    same(bounds.nearest_by_bounds(cells, asked, 1000), topk.nearest(df, asked, 1000, width=WIDTH))


def test_far_cells_are_not_read(spark, tmp_path):
    rows = clustered()
    path = tmp_path / "cells"
    centres = np.array([np.mean([r[3] for r in rows if r[2] == c], axis=0) for c in range(6)])
    df = records(spark, rows)
    cells = bounds.build_bounded_cells(df, str(path), width=WIDTH, filters=["kind"], centres=centres)
    asked = spark.createDataFrame([("q", rows[0][3])], ASKED)  # in the cell of kind 0
    exact = topk.nearest(df, asked, 10, width=WIDTH)
    only_two = topk.nearest(df.where("kind = 2"), asked, 10, width=WIDTH)
    want, want_two = as_rows(exact), as_rows(only_two)
    for cell in range(1, 6):
        if cell != 2:
            for file in (path / f"cell={cell}").glob("*.parquet"):
                file.write_bytes(b"no longer a table")
                pathlib.Path(file.parent / f".{file.name}.crc").unlink(missing_ok=True)
    assert as_rows(bounds.nearest_by_bounds(cells, asked, 10, first_cells=1)) == want
    assert as_rows(bounds.nearest_by_bounds(cells, asked, 10, {"kind": [2]}, first_cells=1)) == want_two
    with pytest.raises(Exception):
        bounds.nearest_by_bounds(cells, asked, 300, first_cells=1).collect()
    with pytest.raises(ValueError, match="no values of"):
        bounds.nearest_by_bounds(cells, asked, 3, {"source_id": ["1"]})


def test_product_codes_find_most_and_rescore_exactly(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [("t", f"{i:04d}", 0, v) for i, v in enumerate(rng.normal(size=(1500, WIDTH)).tolist())]
    df, asked = records(spark, rows), questions(spark, rows, 30)
    codes = pq.build_codes(df, str(tmp_path / "codes"), width=WIDTH, parts=4, entries=32)
    assert codes.books.shape == (4, 32, 2) and codes.read(spark).count() == len(rows)
    exact = {r[:3]: r[3] for r in as_rows(topk.nearest(df, asked, 10, width=WIDTH))}
    found = {n: {r[:3]: r[3] for r in as_rows(pq.nearest_by_codes(codes, asked, 10, shortlist=n))} for n in (1, 8)}
    hits = {n: [key for key in f if key in exact] for n, f in found.items()}
    assert len(hits[8]) / len(exact) >= 0.9 and len(hits[1]) < len(hits[8])
    for key in hits[8]:
        assert found[8][key] == pytest.approx(exact[key], abs=2e-9, nan_ok=True)


def test_product_codes_of_odd_rows(spark, tmp_path):
    rows = odd()
    df, asked = records(spark, rows), questions(spark, rows, 60)
    codes = pq.build_codes(df, str(tmp_path / "codes"), width=WIDTH, parts=8)
    everything = pq.nearest_by_codes(codes, asked, 50, shortlist=8)  # 400 of 363: all are compared
    same(everything, topk.nearest(df, asked, 50, width=WIDTH))
    stored = {(r.source_table, r.source_id): r.code for r in codes.read(spark).where("source_table <> 't'").collect()}
    assert stored == {("z", "1"): b"", ("z", "2"): b"", ("n", "1"): None}
    none = pq.build_codes(df.limit(0), str(tmp_path / "none"), width=WIDTH, parts=8)
    assert pq.nearest_by_codes(none, asked, 3).count() == 0
    with pytest.raises(ValueError, match="parts"):
        pq.fit_books(df, width=WIDTH, id_columns=["source_id"], parts=3)
