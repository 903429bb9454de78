from pyspark.sql import functions as F

from caselens.operators import skew
from caselens.operators.skew import find_hot_keys, missing_from, skew_join


def hot_rows(spark):
    """A third of the rows share one key, a sixth have none."""
    key = (
        F.when(F.col("id") % 3 == 0, F.lit("hot"))
        .when(F.col("id") % 6 == 1, F.lit(None))
        .otherwise(F.concat(F.lit("k"), F.col("id") % 500))
    )
    return spark.range(30_000).withColumn("key", key)


def parents(spark):
    keys = [("hot", 1)] + [(f"k{i}", i) for i in range(0, 500, 2)]
    return spark.createDataFrame(keys, "key string, parent int")


def same(a, b):
    return sorted(map(repr, a.collect())) == sorted(map(repr, b.select(*a.columns).collect()))


def test_finds_hot_keys(spark):
    df = hot_rows(spark)
    hot = find_hot_keys(df, ["key"], share=1 / 200)
    name = df.sparkSession.range(1).select(F.xxhash64(F.lit("hot"))).first()[0]
    assert set(hot.groups) == {name}
    assert 60 <= hot.groups[name] <= 70  # each group below a two-hundredth
    assert hot.null_groups > 30


def test_no_rows_no_hot_keys(spark):
    hot = find_hot_keys(spark.createDataFrame([], "key string"), ["key"], 1 / 200)
    assert hot.groups == {} and hot.null_groups == 1


def test_skew_join_equals_join(spark):
    df, small = hot_rows(spark), parents(spark)
    for how in ("inner", "left"):
        for share in (None, 1 / 200):
            joined = skew_join(df, small, ["key"], how=how, salt_on=["id"], share=share)
            assert same(joined, df.join(small, ["key"], how)), how


def test_skew_join_with_repeated_parent(spark):
    df, small = hot_rows(spark).limit(3000), parents(spark).union(parents(spark))
    for share in (None, 1 / 200):
        joined = skew_join(df, small, ["key"], salt_on=["id"], share=share)
        assert same(joined, df.join(small, ["key"]))


def test_hot_key_is_spread_over_partitions(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df, small = hot_rows(spark).where("key is not null"), parents(spark)

        def largest(joined):
            sizes = joined.groupBy(F.spark_partition_id().alias("p")).count()
            return sizes.agg(F.max("count")).first()[0] / joined.count()

        assert largest(df.join(small, ["key"])) > 0.5
        assert largest(skew_join(df, small, ["key"], salt_on=["id"])) < 0.4
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def test_missing_from(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3), (None, 4)], "key string, n int")
    existing = spark.createDataFrame([("b",), ("b",), ("z",)], "key string")
    assert sorted(r.n for r in missing_from(df, existing, ["key"]).collect()) == [1, 4]


def test_rows_without_a_key_are_spread(spark, monkeypatch):
    monkeypatch.setattr(skew, "MAX_BROADCAST_BYTES", 0)
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        df = spark.range(8000).withColumn("key", F.when(F.col("id") % 4 == 0, F.col("id") % 50))
        existing = spark.range(0, 50, 2).select(F.col("id").alias("key"))
        left = missing_from(df, existing, ["key"])
        assert left.count() == df.where("key IS NULL OR key % 2 = 1").count()
        sizes = [len(part) for part in left.rdd.glom().collect()]
        assert max(sizes) < 0.5 * sum(sizes)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
