"""Searches with more questions than are sent to every executor: groups of questions that read stored blocks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from caselens.operators import bounds, ivf, pq, topk
from tests.test_bounded_search import WIDTH, clustered, odd, questions, records, same


@pytest.mark.parametrize("most", [1, 7, 4096])
def test_groups_find_what_a_scan_finds(spark, tmp_path, monkeypatch, most):
    rows = odd()
    df, asked = records(spark, rows), questions(spark, rows, every=9)
    exact = topk.nearest(df, asked, 5, width=WIDTH).persist()
    monkeypatch.setattr(topk, "GROUP_QUESTIONS", most)
    same(topk.nearest(df, asked, 5, width=WIDTH, limit_bytes=0, grid_rows=20), exact)
    cells = ivf.build_cells(df, str(tmp_path / "cells"), width=WIDTH, n_cells=6)
    same(ivf.nearest_in_cells(cells, asked, 5, n_probe=6, limit_bytes=0, grid_rows=50), exact)
    some = ivf.nearest_in_cells(cells, asked, 5, n_probe=2)
    same(ivf.nearest_in_cells(cells, asked, 5, n_probe=2, limit_bytes=0), some)


def test_no_row_is_repeated_for_another_group(spark, tmp_path):
    """A shuffle holds each question once, whatever the size of the groups."""
    rows = clustered(400)
    df, asked = records(spark, rows), questions(spark, rows, every=1)
    cells = ivf.build_cells(df, str(tmp_path / "cells"), width=WIDTH, n_cells=6)
    for found in (
        topk.nearest(df, asked, 5, width=WIDTH, limit_bytes=0, grid_rows=5),
        ivf.nearest_in_cells(cells, asked, 5, n_probe=6, limit_bytes=0, grid_rows=5),
    ):
        assert "Generate" not in found._jdf.queryExecution().toString()


@pytest.mark.parametrize("limit_bytes", [topk.MAX_BROADCAST_BYTES, 0])
@pytest.mark.parametrize("wanted", [None, {"kind": [1, 9, None]}])
def test_bounds_take_any_number_of_questions(spark, tmp_path, wanted, limit_bytes):
    rows = odd()
    df, asked = records(spark, rows), questions(spark, rows, every=9)
    cells = bounds.build_bounded_cells(df, str(tmp_path / "cells"), width=WIDTH, n_cells=6, filters=["kind"])
    found = bounds.nearest_by_bounds(cells, asked, 5, wanted, limit_bytes=limit_bytes)
    among = df.where(F.col("kind").isin(1, 9)) if wanted else df
    same(found, topk.nearest(among, asked, 5, width=WIDTH))


def test_codes_take_any_number_of_questions(spark, tmp_path):
    rows = odd()
    df, asked = records(spark, rows), questions(spark, rows, every=9)
    codes = pq.build_codes(df, str(tmp_path / "codes"), width=WIDTH, parts=4, entries=16)
    # a shortlist of all records is the exact search
    found = pq.nearest_by_codes(codes, asked, 5, shortlist=len(rows), limit_bytes=0)
    same(found, topk.nearest(df, asked, 5, width=WIDTH))


def test_products_in_32_bits_lose_nothing():
    import pyarrow as pa

    rng = np.random.default_rng(3)
    units = topk.unit_rows(rng.normal(size=(3000, 16)))
    units[::7] = units[3]  # copies
    units[5] = np.nan
    asked = units[:50].copy()
    present = np.ones(len(units), bool)
    present[11] = False
    dense, quick = (topk.BestPerQuestion(50, ["id"], 4) for _ in range(2))
    for at in range(0, len(units), 100):
        part, ids = slice(at, at + 100), pa.table({"id": np.arange(at, at + 100)})
        dense.offer(ids, topk.score_block(units[part], present[part], asked), np.arange(50))
        quick.offer_vectors(ids, units[part], present[part], asked, np.arange(50))
    a, b = dense.result().to_pandas(), quick.result().to_pandas()
    assert a[["id", "_q"]].equals(b[["id", "_q"]]) and np.abs(a._d - b._d).max() <= 1e-9


@pytest.mark.parametrize("crowd", [0, 900])
def test_products_stay_in_a_core_s_cache(crowd):
    """Blocks pass questions in tiles, whose products take the memory of a tile and not of the block."""
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(5)
    units = topk.unit_rows(rng.normal(size=(6000, 16)))
    units[2500 : 2500 + crowd] = units[0]  # near to one question more often than tiles allow
    asked = units[:1003].copy()
    asked[100:700] = asked[0] if crowd else asked[100:700]
    quick, dense = (topk.BestPerQuestion(len(asked), ["id"], 4) for _ in range(2))
    peaks = []
    for at in range(0, len(units), 3000):
        part, ids, present = units[at : at + 3000], pa.table({"id": np.arange(at, min(at + 3000, len(units)))}), np.ones(3000, bool)
        dense.offer(ids, topk.score_block(part, present, asked), np.arange(len(asked)))
        tracemalloc.start()
        quick.offer_vectors(ids, part, present, asked, np.arange(len(asked)))
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        quick.compact()
    a, b = dense.result().to_pandas(), quick.result().to_pandas()
    assert a[["id", "_q"]].equals(b[["id", "_q"]]) and np.abs(a._d - b._d).max() <= 1e-9
    if not crowd:
        assert peaks[1] < len(asked) * 3000 * 4  # one matrix of products of the block
