"""The record tables, documents, frames and SQL texts, derived from the test tables.

Each is one SELECT that Spark and DuckDB both understand, so a check can give both engines
the same input. ``{name}`` stands for a table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

_STATUS = "CASE o_orderstatus WHEN 'F' THEN 'Completed' WHEN 'O' THEN 'Scheduled' ELSE 'Cancelled' END"
_PAID = "CASE o_orderstatus WHEN 'F' THEN 'Paid' WHEN 'O' THEN 'Pending' ELSE 'Failed' END"
_K = "regexp_extract(props, '[0-9]+', 0)"
_REQUEST = "CAST(user_id AS VARCHAR(20)) || '/' || CAST(CAST(ts AS DATE) AS VARCHAR(10))"

VIEWS = {
    "patients": """
        SELECT 'P' || c_custkey AS patient_id, split_part(c_name, '#', 1) AS first_name,
               split_part(c_name, '#', 2) AS last_name,
               CASE WHEN c_nationkey % 2 = 0 THEN 'F' ELSE 'M' END AS gender,
               DATE '1940-01-01' + CAST(c_custkey % 20000 AS INT) AS date_of_birth,
               DATE '2010-01-01' + CAST(c_custkey % 4000 AS INT) AS registration_date,
               c_mktsegment AS insurance_provider
        FROM {customer}""",
    "doctors": """
        SELECT 'D' || s_suppkey AS doctor_id, split_part(s_name, '#', 1) AS first_name,
               split_part(s_name, '#', 2) AS last_name,
               CASE s_suppkey % 3 WHEN 0 THEN 'Pediatrics' WHEN 1 THEN 'Dermatology'
                    ELSE 'Oncology' END AS specialization,
               CAST(s_suppkey % 40 AS INT) AS years_experience, n_name AS hospital_branch
        FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey""",
    "appointments": f"""
        SELECT 'A' || o_orderkey AS appointment_id, 'P' || o_custkey AS patient_id,
               'D' || (o_orderkey % 10) AS doctor_id, CAST(o_orderdate AS DATE) AS appointment_date,
               (8 + o_orderkey % 10) || ':15:00' AS appointment_time,
               o_orderpriority AS reason_for_visit, {_STATUS} AS status
        FROM {{orders}}""",
    "treatments": """
        SELECT 'T' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey
                   AS treatment_id,
               'A' || l_orderkey AS appointment_id,
               CASE l_returnflag WHEN 'A' THEN 'X-Ray' WHEN 'N' THEN 'MRI' ELSE 'ECG' END
                   AS treatment_type,
               CASE l_linestatus WHEN 'F' THEN 'Standard procedure' ELSE 'Advanced protocol' END
                   AS description,
               CAST(l_extendedprice AS DECIMAL(10,2)) AS cost, CAST(l_shipdate AS DATE) AS treatment_date
        FROM {lineitem}""",
    "billing": f"""
        SELECT 'B' || o_orderkey AS bill_id, 'P' || o_custkey AS patient_id,
               'T' || o_orderkey AS treatment_id, CAST(o_orderdate AS DATE) AS bill_date,
               CAST(o_totalprice AS DECIMAL(10,2)) AS amount, o_orderpriority AS payment_method,
               {_PAID} AS payment_status
        FROM {{orders}}""",
    "xray": """
        SELECT 'X' || p_partkey AS xray_id, 'A' || p_partkey AS appointment_id,
               'T' || p_partkey AS treatment_id,
               'chest_xray_60/' || p_type || '/' || p_partkey || '.jpeg' AS image_path,
               CASE WHEN p_type IN ('LARGE', 'SMALL', 'PROMO') THEN 'NORMAL' ELSE 'PNEUMONIA' END
                   AS image_label,
               p_name AS image_text
        FROM {part}""",
    # frames of requests (one per user and day): log lines, answers, errors, ends, broken
    # frames and frames without a data line
    "frames": f"""
        SELECT {_REQUEST} AS request_id, event_id AS seq, ts,
               CASE
                 WHEN event_type = 'click' THEN
                   'data: {{{{"type": "output", "text": "Trying gemini-' || {_K} || '...' || chr(92) || 'n"}}}}'
                 WHEN event_type = 'view' THEN
                   'data: {{{{"type": "output", "text": "sql query written by gemini ->  SELECT '
                   || event_id || chr(92) || 'n"}}}}'
                 WHEN event_type = 'purchase' THEN
                   'data: {{{{"type": "output", "text": "--- Answer ---' || chr(92) || 'nTotal ' || {_K}
                   || '.' || chr(92) || 'n"}}}}'
                 WHEN event_type = 'error' AND length({_K}) = 1 THEN 'data: {{{{"type": "error", '
                 WHEN event_type = 'error' AND CAST({_K} AS INT) % 2 = 0 THEN
                   'data: {{{{"type": "error", "message": "code ' || {_K} || '"}}}}'
                 WHEN event_type = 'signup' AND CAST({_K} AS INT) % 5 > 0 THEN
                   'event: end' || chr(10) || 'data: {{{{"type": "done"}}}}'
                 ELSE ': keep-alive ' || {_K} END AS frame
        FROM {{events}}""",
    "log_texts": f"""
        SELECT event_id,
               'Question: ' || event_type || chr(10)
               || CASE event_type
                    WHEN 'click' THEN 'Trying gemini-' || {_K} || '...'
                    WHEN 'view' THEN '  SQL query written by Gemini ->  SELECT ' || {_K}
                    WHEN 'error' THEN 'gemini-' || {_K} || ' quota hit, falling back...'
                    WHEN 'purchase' THEN 'Fallback to GEMINI ' || {_K}
                    ELSE '' END
               || chr(10) AS log
        FROM {{events}}""",
    "sql_texts": f"""
        SELECT event_id, event_type,
               CASE event_type
                 WHEN 'click' THEN '  SELECT * FROM t WHERE k = ' || {_K} || ';'
                 WHEN 'view' THEN 'SELECT last_update FROM t WHERE k = ' || {_K}
                 WHEN 'error' THEN 'DELETE FROM t WHERE k = ' || {_K}
                 WHEN 'purchase' THEN 'WITH a AS (SELECT ' || {_K} || ') SELECT * FROM a'
                 ELSE 'SELECT ' || {_K} || '; DROP TABLE t' END AS sql
        FROM {{events}}""",
    "raw_events": """
        SELECT event_id,
               CASE WHEN event_type = 'error' THEN 'n/a'
                    ELSE CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR(30)) END AS value_text,
               CASE WHEN event_type = 'signup' THEN '2024-13-01'
                    ELSE CAST(CAST(ts AS DATE) AS VARCHAR(10)) END AS date_text
        FROM {events}""",
    "image_links": """
        SELECT p_partkey,
               CASE p_partkey % 9
                 WHEN 0 THEN 'https://host.example/data/archive/chest_xray_60/' || p_type || '/'
                             || replace(p_name, ' ', '%20') || '.jpeg?size=' || p_size || '#top'
                 WHEN 1 THEN 'C:' || chr(92) || 'data' || chr(92) || 'archive' || chr(92)
                             || 'chest_xray_60' || chr(92) || p_type || chr(92) || p_partkey || '.png'
                 WHEN 2 THEN 'chest_xray_60/' || p_type || '/' || p_name || ' (1).jpg'
                 WHEN 3 THEN '/archive/chest_xray_60/old/../' || p_type || '/' || p_partkey || '.GIF'
                 WHEN 4 THEN 'archive/chest_xray_60/' || p_type || '/' || p_partkey || '.txt'
                 WHEN 5 THEN 'https://host.example/' || p_partkey || '.png'
                 WHEN 6 THEN 'archive/chest_xray_60//' || p_partkey || '.png'
                 WHEN 7 THEN 'archive/chest_xray_60/100%/' || p_partkey || '.bmp'
                 ELSE 'HTTPS://HOST.example/Archive/CHEST_XRAY_60/' || p_type || '/' || p_partkey
                      || '%2Fb+c.WebP' END AS link
        FROM {part}""",
    "rich_pages": """
        SELECT page_id,
               html || '<p><img alt="scan ' || page_id || '" src=''/archive/chest_xray_60/N/' || page_id
               || '.png''><code>![view ' || page_id || '](&lt;' || url || '&gt;)</code></p>' AS html
        FROM {pages}""",
    "stock_documents": """
        SELECT source AS source_table, CAST(doc_id AS VARCHAR(20)) AS source_id, text AS content,
               '{{"lang":"' || lang || '","n_chars":' || n_chars || '}}' AS metadata
        FROM {documents}""",
    "questions": "SELECT CAST(item_id AS VARCHAR(20)) AS question_id, text AS question FROM {benchmark}",
    "expected_images": """
        SELECT p_partkey,
               CASE p_partkey % 4 WHEN 0 THEN 'part.parquet' WHEN 1 THEN 'orders.parquet'
                    WHEN 2 THEN 'no such ' || p_type || '.parquet' ELSE 'events.parquet' END AS image_path
        FROM {part}""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = VIEWS[name]
    used = {t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in text}
    return spark.sql(text, **used)


def duckdb_view(name: str) -> str:
    """The same SELECT over the tables by their names."""
    return VIEWS[name].format(**{t: t for t in TABLES}).strip()


def with_views(*names: str, then: str) -> str:
    parts = ", ".join(f"{n} AS ({duckdb_view(n)})" for n in names)
    return f"WITH {parts} {then}"
