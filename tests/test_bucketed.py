"""Joins and checks over bucketed tables move nothing."""

import contextlib
import uuid

from pyspark.sql import functions as F, types as T

from caselens.operators import quality
from caselens.sources import bucketed as dealing
from caselens.sources.bucketed import BucketedTable

FACT = T.StructType().add("k", "long").add("kind", "string").add("cost", "double")
DIM = T.StructType().add("k", "long").add("who", "string")


@contextlib.contextmanager
def plain_plans(spark):
    """No broadcast and no adaptive execution, so the plan is the one that runs."""
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {name: spark.conf.get(name) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    yield
    for name, value in before.items():
        spark.conf.set(name, value)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def bucketed(spark, tmp_path, name, schema, appends):
    table = BucketedTable(f"t_{uuid.uuid4().hex}", str(tmp_path / name), schema, "k", 4)
    for rows in appends:
        table.append(rows)
    return table


def tables(spark, tmp_path):
    facts = [(i % 50 if i % 9 else None, "ab"[i % 2], i / 4) for i in range(400)]
    fact = spark.createDataFrame(facts, FACT)
    dim = spark.createDataFrame([(i, f"w{i % 3}") for i in range(40)] + [(None, "none")], DIM)
    halves = [fact.where("kind = 'a'").withColumn("k", F.col("k").cast("int")), fact.where("kind = 'b'")]
    return fact, dim, bucketed(spark, tmp_path, "fact", FACT, halves), bucketed(spark, tmp_path, "dim", DIM, [dim])


def test_joins_and_checks_have_no_exchange(spark, tmp_path):
    fact, dim, fact_table, dim_table = tables(spark, tmp_path)
    stored, parent = fact_table.open(spark), dim_table.open(spark)
    assert stored.count() == 400 and stored.schema.simpleString() == fact.schema.simpleString()
    with plain_plans(spark):
        per_key = stored.groupBy("k", "kind").agg(F.sum("cost").alias("total"))
        joined = per_key.join(parent, "k")
        orphans = quality.foreign_key_violations(stored, "k", parent, "k")
        assert "Exchange" not in plan(joined) and "Exchange" not in plan(orphans)
        assert "Exchange" in plan(fact.groupBy("k").count())
        want = fact.groupBy("k", "kind").agg(F.sum("cost").alias("total")).join(dim, "k")
        assert sorted(map(repr, joined.collect())) == sorted(map(repr, want.collect()))
        want = quality.foreign_key_violations(fact, "k", dim, "k")
        assert sorted(map(tuple, orphans.collect())) == sorted(map(tuple, want.collect())) != []


def test_another_session_finds_the_table(spark, tmp_path):
    _, _, fact_table, _ = tables(spark, tmp_path)
    spark.sql(f"DROP TABLE {fact_table.name}")  # external: the files stay
    again = BucketedTable(f"t_{uuid.uuid4().hex}", fact_table.path, FACT, "k", 4)
    assert again.open(spark).count() == 400
    again.append(spark.createDataFrame([(1, "c", 1.0)], FACT))
    with plain_plans(spark):
        counted = again.open(spark).groupBy("k").count()
        assert "Exchange" not in plan(counted)
        assert counted.agg(F.sum("count")).first()[0] == 401


def test_buckets_follow_the_rows(spark, monkeypatch):
    rows = spark.range(1000)
    assert dealing.buckets_for(rows, 8) == 8
    monkeypatch.setattr(dealing, "BUCKET_ROWS", 10)
    assert dealing.buckets_for(rows, 8) == 100
    assert dealing.buckets_for(rows.limit(0)) == 1
