"""Read-only SQL over registered views.

Two policies decide whether a text may run. ``compat`` looks for forbidden words followed
by a space anywhere in the text, inside quotes and names too. ``strict`` looks at whole
words outside quotes and comments, admits ``WITH``, and also refuses a second statement,
reading files by path, scripts, and functions that call into the JVM. Before a text runs under
``strict``, Spark's parser reads it as well, and only plans made of known reading steps pass;
a word list is not relied on alone. ``strict`` is the default.
"""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from caselens.functions.text import rows_as_json, strip
from caselens.scratch import write_and_reread

# The refused words in the order they are looked for, and the messages.
FORBIDDEN = ["insert", "update", "delete", "drop", "alter", "truncate", "create", "grant", "revoke"]
EMPTY = "Empty SQL query."
NOT_SELECT = "Only SELECT queries are allowed."
REFUSED = "SQL operation '{word}' is not allowed."

STRICT_FUNCTIONS = ["reflect", "try_reflect", "java_method"]
SECOND_STATEMENT = "Only one statement is allowed."
FILE_READ = "Reading files by path is not allowed."

# Single-quoted, double-quoted and back-quoted text, and both kinds of comment.
_QUOTED = (
    r"""'[^'\\]*+(?:(?:\\[\s\S]|'')[^'\\]*+)*+'|"[^"\\]*+(?:\\[\s\S][^"\\]*+)*+\""""
    r"""|--[^\n]*|/\*[^*]*+\*++(?:[^/*][^*]*+\*++)*+/"""
)
_NAMED = r"`[^`]*`"
FILE_SOURCES = {"parquet", "orc", "csv", "json", "text", "avro", "xml", "binaryfile", "delta"}
_FILE = r"(?i)\b(?:parquet|orc|csv|json|text|avro|xml|binaryfile|delta)\s*\.\s*`"

SCRIPT = "Scripts are not allowed."
_SCRIPT = r"\b(?:transform|map|reduce)\b(?=[\s\S]*\busing\b\s*+(?!\())"

STEP = "The step '{step}' is not allowed."
# The steps of a plan, before names are resolved, that only read and compute.
READING_STEPS = {
    "Project", "Filter", "Aggregate", "Join", "Sort", "GlobalLimit", "LocalLimit", "Offset", "Distinct", "Deduplicate",
    "Union", "Intersect", "Except", "SubqueryAlias", "UnresolvedRelation", "UnresolvedInlineTable", "OneRowRelation",
    "UnresolvedWith", "UnresolvedHaving", "UnresolvedSubqueryColumnAliases", "Generate", "Window", "WithWindowDefinition",
    "Expand", "GroupingSets", "Sample", "Pivot", "UnresolvedPivot", "Unpivot", "UnresolvedHint", "LateralJoin",
    "UnresolvedTableValuedFunction", "LocalRelation", "Range", "UnresolvedOrdinal", "Tail", "CTE", "View", "Values",
    "With", "UnresolvedStarWithColumns",
}
TABLE_FUNCTIONS = {
    "range", "explode", "explode_outer", "inline", "inline_outer", "posexplode", "posexplode_outer", "stack",
    "json_tuple", "variant_explode", "variant_explode_outer",
}


def statement(sql: Column | str) -> Column:
    """The text without surrounding white space and closing semicolons."""
    sql = F.col(sql) if isinstance(sql, str) else sql
    return strip(F.regexp_replace(strip(sql), r";+\z", ""))


def _compat_reason(df: DataFrame, sql: str) -> tuple[DataFrame, Column]:
    prepared = df.withColumn("_text", F.lower(statement(sql)))
    reason = F.when(F.coalesce(strip(sql), F.lit("")) == "", F.lit(EMPTY)).when(
        ~F.col("_text").startswith("select"), F.lit(NOT_SELECT)
    )
    for word in FORBIDDEN:
        reason = reason.when(F.contains("_text", F.lit(word + " ")), F.lit(REFUSED.format(word=word)))
    return prepared, reason


def _strict_reason(df: DataFrame, sql: str) -> tuple[DataFrame, Column]:
    unquoted = F.regexp_replace(F.coalesce(sql, F.lit("")), _QUOTED, " ")  # a quoted command leaves a space
    text = F.lower(strip(F.regexp_replace(strip(unquoted), r"(?:;\s*)+\z", "")))
    prepared = df.withColumn("_text", text).withColumn("_bare", F.regexp_replace("_text", _NAMED, " x "))
    bare = F.col("_bare")
    reason = (
        F.when(bare == "", F.lit(EMPTY))
        .when(~bare.rlike(r"\A\(*\s*(?:select|with)\b"), F.lit(NOT_SELECT))
        .when(F.contains(bare, F.lit(";")), F.lit(SECOND_STATEMENT))
        .when(F.col("_text").rlike(_FILE), F.lit(FILE_READ))
    )
    words = rf"\b({'|'.join(FORBIDDEN)})\b"
    calls = rf"\b({'|'.join(STRICT_FUNCTIONS)})\s*\("
    reason = reason.when(bare.rlike(_SCRIPT), F.lit(SCRIPT))
    for pattern in (words, calls):
        before, after = REFUSED.split("{word}")
        message = F.concat(F.lit(before), F.regexp_extract(bare, pattern, 1), F.lit(after))
        reason = reason.when(bare.rlike(pattern), message)
    return prepared, reason


def sql_policy(queries: DataFrame, sql: str = "sql", strict: bool = True) -> DataFrame:
    """Add ``reason`` (why the text is refused, or NULL) and ``allowed`` to a table of SQL
    texts."""
    prepared, reason = (_strict_reason if strict else _compat_reason)(queries, sql)
    judged = prepared.withColumn("reason", reason)
    return judged.select(*queries.columns, "reason", F.col("reason").isNull().alias("allowed"))


class Refused(ValueError):
    pass


def _listed(sequence) -> list:
    return [sequence.apply(i) for i in range(sequence.size())]


def plan_reason(spark: SparkSession, sql: str) -> str | None:
    """Why the parsed text may not run, or None: a step that does more than read, a file named as a
    table, a table function or a call that is not known to be harmless. Only the text is parsed;
    nothing is looked up or run."""
    todo = [spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)]
    while todo:
        plan = todo.pop()
        step = plan.getClass().getSimpleName().rstrip("$")
        if step not in READING_STEPS:
            return STEP.format(step=step)
        if step == "UnresolvedRelation" and plan.multipartIdentifier().size() > 1:
            first = plan.multipartIdentifier().apply(0).lower()
            last = plan.multipartIdentifier().apply(plan.multipartIdentifier().size() - 1)
            if first in FILE_SOURCES or "/" in last or ":" in last:
                return FILE_READ
        if step == "UnresolvedTableValuedFunction":
            name = plan.name().apply(plan.name().size() - 1).lower()
            if name not in TABLE_FUNCTIONS:
                return REFUSED.format(word=name)
        if step == "UnresolvedWith":
            todo += [pair._2() for pair in _listed(plan.cteRelations())]
        todo += _listed(plan.children()) + _listed(plan.subqueries())
        calls = _listed(plan.expressions())
        while calls:
            call = calls.pop()
            if call.getClass().getSimpleName() == "UnresolvedFunction":
                name = call.nameParts().apply(call.nameParts().size() - 1).lower()
                if name in STRICT_FUNCTIONS:
                    return REFUSED.format(word=name)
            calls += _listed(call.children())
    return None


def guarded_sql(spark: SparkSession, sql: str, strict: bool = True) -> DataFrame:
    """The whole result as a DataFrame, or :class:`Refused`."""
    asked = spark.range(1).select(F.lit(sql).alias("sql"))
    judged = sql_policy(asked, strict=strict).withColumn("text", statement("sql")).first()
    if not judged["allowed"]:
        raise Refused(judged["reason"])
    reason = plan_reason(spark, judged["text"]) if strict else None
    if reason is not None:
        raise Refused(reason)
    return spark.sql(judged["text"])


def distinct_names(df: DataFrame) -> DataFrame:
    """Repeated column names get a number, so that no value is lost."""
    seen: dict[str, int] = {}
    names = []
    for name in df.columns:
        seen[name] = seen.get(name, 0) + 1
        names.append(name if seen[name] == 1 else f"{name}_{seen[name]}")
    return df.toDF(*names)


def execute_sql(spark: SparkSession, sql: str, strict: bool = True) -> dict:
    """The result envelope: {success, columns, rows, row_count} or {success, error}.

    ``rows`` is a DataFrame with every row of the result as JSON in ``row_json``. The query
    runs once: its rows are stored, then counted.
    """
    try:
        result = distinct_names(guarded_sql(spark, sql, strict))
        rows = write_and_reread(result.select(rows_as_json(result)), "result")
        return {"success": True, "columns": result.columns, "rows": rows, "row_count": rows.count()}
    except (Refused, PySparkException) as error:
        return {"success": False, "error": str(error)}


def schema_catalog(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, position, column_name, column_type): what may be asked about, taken
    from the tables themselves."""
    rows = [
        (name, position, field.name, field.dataType.simpleString())
        for name, df in tables.items()
        for position, field in enumerate(df.schema.fields, start=1)
    ]
    return spark.createDataFrame(
        rows, "table_name string, position int, column_name string, column_type string"
    )


def catalog_text(tables: dict[str, DataFrame]) -> str:
    """The tables and their columns as indented text, for the instructions of a prompt."""
    return "\n\n".join(
        f"{name}:\n" + "\n".join(f"    {column}" for column in df.columns) for name, df in tables.items()
    )
