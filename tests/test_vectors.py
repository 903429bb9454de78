import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from caselens.functions import vectors as V
from caselens.operators import ivf, topk

SCHEMA = "source_table string, source_id string, embedding array<float>"


def records(spark, rows, partitions=3):
    return spark.createDataFrame(rows, SCHEMA).repartition(partitions)


def random_rows(n, width=8, seed=1):
    rng = random.Random(seed)
    return [("t", f"{i:04d}", [rng.gauss(0, 1) for _ in range(width)]) for i in range(n)]


def brute_force(rows, questions, k):
    found = set()
    for qid, q in questions:
        scored = []
        for table, rid, v in rows:
            a, b = np.float32(v).astype(float), np.float32(q).astype(float)
            d = 1 - a @ b / (np.linalg.norm(a) * np.linalg.norm(b))
            scored.append((round(d, 9), table, rid))
        for rank, (d, table, rid) in enumerate(sorted(scored)[:k], start=1):
            found.add((qid, table, rid, rank))
    return found


def as_set(df):
    return {(r.question_id, r.source_table, r.source_id, r["rank"]) for r in df.collect()}


def test_distance_of_special_vectors(spark):
    rows = [(1, [1.0, 0.0], [1.0, 0.0]), (2, [1.0, 0.0], [-2.0, 0.0]), (3, [0.0, 0.0], [1.0, 0.0]), (4, None, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "i int, a array<float>, b array<float>")
    found = {r.i: r.d for r in df.select("i", V.cosine_distance(F.col("a"), F.col("b")).alias("d")).collect()}
    assert found[1] == 0 and found[2] == 2 and math.isnan(found[3]) and found[4] is None


def test_order_of_ties_nan_and_null(spark):
    rows = [("t", "c", [1.0, 0.0]), ("t", "a", [2.0, 0.0]), ("t", "b", [0.5, 0.0]),
            ("t", "z", [0.0, 0.0]), ("t", "y", None), ("t", "x", [-1.0, 0.0])]
    df = records(spark, rows)
    wanted = ["a", "b", "c", "x", "z", "y"]
    single = topk.nearest_to(df, [1.0, 0.0], 6).collect()
    assert [r.source_id for r in single] == wanted
    questions = spark.createDataFrame([("q", [3.0, 0.0])], "question_id string, embedding array<float>")
    many = topk.nearest(df, questions, 6, width=2).orderBy("rank").collect()
    assert [r.source_id for r in many] == wanted
    assert math.isnan(many[4].distance) and many[5].distance is None
    assert [r.source_id for r in topk.nearest_to(df, [1.0, 0.0], 2).collect()] == ["a", "b"]


def test_wrong_width_is_an_error(spark):
    df = records(spark, [("t", "a", [1.0, 0.0, 0.0])])
    with pytest.raises(Exception, match="expected 2 dimensions"):
        topk.nearest_to(df, [1.0, 0.0]).collect()
    questions = spark.createDataFrame([("q", [1.0, 0.0])], "question_id string, embedding array<float>")
    with pytest.raises(Exception, match="expected 2 dimensions"):
        topk.nearest(df, questions, width=2).collect()


@pytest.mark.parametrize("partitions", [1, 5])
@pytest.mark.parametrize("limit_bytes", [topk.MAX_BROADCAST_BYTES, 0])
def test_many_questions_against_brute_force(spark, partitions, limit_bytes, monkeypatch):
    rows, k = random_rows(300), 7
    rows += [("t", f"copy{i:03d}", rows[0][2]) for i in range(200)]  # a third are copies
    questions = [(f"q{i}", v) for i, (_, _, v) in enumerate(rows[:20])]
    df = records(spark, rows, partitions)
    asked = spark.createDataFrame(questions, "question_id string, embedding array<float>")
    found = topk.nearest(df, asked, k, width=8, limit_bytes=limit_bytes, grid_rows=100)
    assert as_set(found) == brute_force(rows, questions, k)


def test_state_of_a_task_stays_small():
    import pyarrow as pa

    rng = np.random.default_rng(0)
    best = topk.BestPerQuestion(3, ["id"], 2)
    scores = np.round(rng.random((200_000, 3)), 2)  # many ties
    ids = np.arange(len(scores))
    for at in range(0, len(scores), 500):
        best.offer(pa.table({"id": ids[at : at + 500]}), scores[at : at + 500], np.arange(3))
        assert best.rows <= 4 * 3 * 2 + 100_000 + 500 * 3
    table = best.result().to_pandas()
    for q in range(3):
        order = np.lexsort((ids, scores[:, q]))[:2]
        assert table[table._q == q].id.tolist() == ids[order].tolist()


def test_fewer_than_k(spark):
    df = records(spark, random_rows(4))
    asked = spark.createDataFrame([("q", [1.0] * 8)], "question_id string, embedding array<float>")
    assert topk.nearest(df, asked, 15, width=8).count() == 4
    assert topk.nearest_to(df.where("false"), [1.0] * 8).count() == 0


def test_filter_comes_before_the_cut(spark):
    df = records(spark, random_rows(200)).withColumn("kind", F.col("source_id").cast("int") % 10)
    ids = ["source_table", "source_id", "kind"]
    found = topk.nearest_to(df.where("kind = 3"), [1.0] * 8, 15, id_columns=ids)
    assert found.count() == 15 and found.where("kind <> 3").count() == 0


def test_cells(spark, tmp_path):
    rows, k = random_rows(400), 10
    rows += [("t", f"copy{i:03d}", rows[0][2]) for i in range(200)]
    questions = [(f"q{i}", v) for i, (_, _, v) in enumerate(random_rows(25, seed=2))]
    asked = spark.createDataFrame(questions, "question_id string, embedding array<float>")
    cells = ivf.build_cells(records(spark, rows), str(tmp_path / "cells"), width=8, n_cells=8)
    assert cells.read(spark).count() == len(rows)
    exact = brute_force(rows, questions, k)
    recall = []
    for n_probe in (1, 2, 4, 8):
        found = as_set(ivf.nearest_in_cells(cells, asked, k, n_probe))
        recall.append(len({f[:3] for f in found} & {e[:3] for e in exact}) / len(exact))
    assert recall == sorted(recall) and recall[0] > 0.2 and recall[-1] == 1.0
    assert as_set(ivf.nearest_in_cells(cells, asked, k, 8)) == exact


def test_only_probed_cells_are_read(spark, tmp_path):
    cells = ivf.build_cells(records(spark, random_rows(200)), str(tmp_path / "cells"), width=8, n_cells=4)
    asked = spark.createDataFrame([("q", [1.0] * 8)], "question_id string, embedding array<float>")
    plan = ivf.nearest_in_cells(cells, asked, 5, 1)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(cell" in plan or "PartitionFilters: [cell" in plan


def test_hashing_finds_most(spark):
    rows = random_rows(500)
    q = rows[7][2]
    found = ivf.nearest_by_hashing(records(spark, rows), q, 10, bucket_length=1.0).collect()
    exact = {e[2] for e in brute_force(rows, [("q", q)], 10)}
    assert len({r.source_id for r in found} & exact) >= 7
    assert min(r.distance for r in found) == pytest.approx(0, abs=1e-6)


def test_half_precision(spark):
    values = [1.0, 0.1, -65504.0, 6e-8, 0.0]
    df = spark.createDataFrame([(values,), (None,)], "v array<float>").coalesce(1)
    back = df.select(V.from_half(V.to_half("v")).alias("h"), F.octet_length(V.to_half("v")).alias("n")).collect()
    assert back[0].n == 10 and back[1].h is None
    assert back[0].h == [float(np.float16(x)) for x in values]


def test_literal_round_trip(spark):
    df = spark.createDataFrame([([0.1, -2e-5, 3.0],)], "v array<float>")
    row = df.select(V.vector_literal("v").alias("t"), V.parse_vector(V.vector_literal("v")).alias("b"), "v").first()
    assert row.b == row.v and row.t.startswith("[0.1,") and row.t.endswith("]")
    assert spark.sql("select '[1,2.5]' t").select(V.parse_vector("t")).first()[0] == [1.0, 2.5]


def test_a_question_without_a_vector_finds_nothing(spark, tmp_path):
    rows = random_rows(60)
    df = records(spark, rows)
    asked = spark.createDataFrame([("q", rows[0][2]), ("none", None)], "question_id string, embedding array<float>")
    cells = ivf.build_cells(df, str(tmp_path / "cells"), width=8, n_cells=4)
    for found in (
        topk.nearest(df, asked, 5, width=8),
        topk.nearest(df, asked, 5, width=8, limit_bytes=0, grid_rows=20),
        ivf.nearest_in_cells(cells, asked, 5, n_probe=4),
        ivf.nearest_in_cells(cells, asked, 5, n_probe=4, limit_bytes=0, grid_rows=20),
    ):
        assert as_set(found) == brute_force(rows, [("q", rows[0][2])], 5)


def test_candidates_do_not_grow_with_the_splits(spark):
    df = records(spark, random_rows(400))
    asked = spark.createDataFrame([("q", [1.0] * 8)], "question_id string, embedding array<float>")
    limit = topk.TASKS_PER_CORE * spark.sparkContext.defaultParallelism
    plan = topk.nearest(df.repartition(200), asked, 5, width=8)._jdf.queryExecution().toString()
    assert f"Coalesce {limit}" in plan


def test_matrices_stay_small(monkeypatch):
    monkeypatch.setattr(ivf, "MAX_CELLS", 64)
    rng = np.random.default_rng(1)
    units, centres = topk.unit_rows(rng.normal(size=(100, 8))), rng.normal(size=(16, 8))
    whole = np.argsort(-(units @ topk.unit_rows(centres).T), axis=1, kind="stable")
    assert (ivf._nearest_cells(units, centres, 1)[:, 0] == whole[:, 0]).all()
    assert (ivf._nearest_cells(units, centres, 5) == whole[:, :5]).all()
    assert ivf.default_cells(10_000, 64) == 100 and ivf.default_cells(1 << 60, 64) == ivf.MAX_BROADCAST_BYTES // 512
