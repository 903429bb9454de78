import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from caselens.plans import sql_tool as S

CASES = [
    # text, compat, strict (None: may run)
    ("SELECT 1;", None, None),
    ("  select 1 ;; ", None, None),
    ("", S.EMPTY, S.EMPTY),
    (" \n\t", S.EMPTY, S.EMPTY),
    (";", S.NOT_SELECT, S.EMPTY),
    ("WITH a AS (SELECT 1) SELECT * FROM a", S.NOT_SELECT, None),
    ("DELETE FROM t", S.NOT_SELECT, S.NOT_SELECT),
    ("SELECT 1; DROP TABLE t", S.REFUSED.format(word="drop"), S.SECOND_STATEMENT),
    ("SELECT last_update FROM t", S.REFUSED.format(word="update"), None),
    ("SELECT 'drop table' x", S.REFUSED.format(word="drop"), None),
    ("SELECT 1;DROP\nTABLE t", None, S.SECOND_STATEMENT),
    ("WITH a AS (SELECT 1) INSERT INTO t SELECT * FROM a", S.NOT_SELECT, S.REFUSED.format(word="insert")),
    ("SELECT /* drop */ 1 -- create\n", S.REFUSED.format(word="drop"), None),
    ("SELECT reflect('java.lang.System', 'exit', 0)", None, S.REFUSED.format(word="reflect")),
    ("SELECT * FROM parquet.`/etc`", None, S.FILE_READ),
    ("SELECT `drop` FROM t", None, None),
    ("SELECT `update ` FROM t", S.REFUSED.format(word="update"), None),
    ("selective", None, S.NOT_SELECT),
    ("(SELECT 1)", S.NOT_SELECT, None),
    ("SELECT 'it''s; fine'", None, None),
]


def test_policies(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i int, sql string")
    compat = {r.i: r.reason for r in S.sql_policy(df, strict=False).collect()}
    strict = {r.i: r.reason for r in S.sql_policy(df, strict=True).collect()}
    for i, (text, wanted, wanted_strict) in enumerate(CASES):
        assert compat[i] == wanted, text
        assert strict[i] == wanted_strict, text
    missing = spark.sql("select cast(null as string) sql")
    assert S.sql_policy(missing, strict=False).first().reason == S.EMPTY
    assert S.sql_policy(missing, strict=True).first().reason == S.EMPTY


def test_long_texts(spark):
    long = [
        "SELECT '" + "x" * 300_000 + " drop table' AS a",
        "SELECT '" + "it''s " * 30_000 + "' AS a",
        "SELECT /*" + " * " * 30_000 + "*/ 1",
        "SELECT 1" + " " * 300_000 + "AS a",
    ]
    df = spark.createDataFrame([(t,) for t in long], "sql string")
    assert all(r.allowed for r in S.sql_policy(df, strict=True).collect())
    assert sum(r.allowed for r in S.sql_policy(df, strict=False).collect()) == 3


def rows(found):
    return [json.loads(r.row_json) for r in found["rows"].collect()]


def test_envelope(spark):
    spark.createDataFrame([("D1", "Oncology"), ("D2", None)], "doctor_id string, spec string").createOrReplaceTempView("docs")
    found = S.execute_sql(spark, "SELECT doctor_id, spec, DATE '2024-01-02' AS day, 1.50 AS cost FROM docs ORDER BY 1;")
    assert (found["success"], found["columns"], found["row_count"]) == (True, ["doctor_id", "spec", "day", "cost"], 2)
    assert sorted(rows(found), key=lambda r: r["doctor_id"]) == [
        {"doctor_id": "D1", "spec": "Oncology", "day": "2024-01-02", "cost": "1.50"},
        {"doctor_id": "D2", "spec": None, "day": "2024-01-02", "cost": "1.50"},
    ]


def test_envelope_has_all_rows(spark):
    found = S.execute_sql(spark, "SELECT id FROM range(2500)")
    assert found["row_count"] == 2500 and {r["id"] for r in rows(found)} == set(range(2500))


def test_repeated_names_keep_their_values(spark):
    found = S.execute_sql(spark, "SELECT 1 AS a, 2 AS a")
    assert found["columns"] == ["a", "a_2"] and rows(found) == [{"a": 1, "a_2": 2}]


HOLES = [
    "SELECT TRANSFORM(id) USING 'cat' AS (b string) FROM range(3)",
    "SELECT /* */ TRANSFORM (id) USING \"cat\" FROM range(3)",
    "FROM range(3) MAP id USING 'cat' AS b",
    "WITH x AS (SELECT transform(id) USING 'cat' AS b FROM range(3)) SELECT * FROM x",
    "SELECT (SELECT max(b) FROM (SELECT TRANSFORM(id) USING 'cat' AS (b string) FROM range(3)))",
    "SELECT java_method('java.lang.Math', 'abs', -1)",
    "SELECT `reflect`('java.lang.Math', 'abs', -1)",
    "SELECT * FROM text.`/etc/hostname`",
    "SELECT * FROM `text`.`/etc/hostname`",
    "SELECT * FROM (SELECT * FROM `csv` . `/etc/hostname`)",
    "SELECT * FROM read_files('/etc/hostname')",
    "SELECT 1; SELECT 2",
]


@pytest.mark.parametrize("sql", HOLES)
def test_strict_by_default_refuses(spark, sql):
    with pytest.raises((S.Refused, PySparkException)):
        S.guarded_sql(spark, sql).collect()


def test_plans_alone_refuse_what_does_more_than_read(spark):
    for sql in [*HOLES[:11], "INSERT INTO t VALUES (1)", "DROP TABLE t", "CREATE TABLE t AS SELECT 1", "SET x = 1", "ADD JAR x"]:
        assert S.plan_reason(spark, sql) is not None, sql


def test_strict_admits_reading(spark):
    spark.range(3).createOrReplaceTempView("t")
    for sql in [
        "SELECT transform(array(id), x -> x + 1) FROM t JOIN t AS u USING (id)",
        "SELECT id, row_number() OVER (ORDER BY id) FROM t UNION ALL SELECT 1, 2",
        "SELECT * FROM t WHERE id IN (SELECT max(id) FROM t) GROUP BY ALL HAVING count(*) > 0 ORDER BY 1 LIMIT 2",
        "SELECT * FROM VALUES (1) AS v(x)",
    ]:
        assert S.guarded_sql(spark, sql).collect(), sql


@pytest.mark.parametrize("sql", ["DROP TABLE x", "SELECT * FROM no_such_table", "SELECT 1;DROP\nTABLE t", "SELECT 1/0"])
def test_errors_become_envelopes(spark, sql):
    found = S.execute_sql(spark, sql)
    assert found["success"] is False and found["error"]


def test_catalog(spark):
    tables = {"t": spark.range(1).select("id", F.lit("x").alias("name"))}
    assert [tuple(r) for r in S.schema_catalog(spark, tables).collect()] == [
        ("t", 1, "id", "bigint"), ("t", 2, "name", "string")
    ]
    assert S.catalog_text(tables) == "t:\n    id\n    name"
