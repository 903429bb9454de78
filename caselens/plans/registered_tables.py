"""Registered queries on record tables: load, quality, analytics, SQL."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from caselens.functions import bands
from caselens.functions.json_filter import metadata_contains
from caselens.operators import analytics, documents, quality
from caselens.operators.embed import unembedded
from caselens.operators.skew import fits_broadcast, skew_join
from caselens.plans import sql_tool
from caselens.plans.standins import TABLES, table, view, with_views
from caselens.schemas import RECORD_TABLES
from caselens.scratch import scratch_path, write_and_reread
from caselens.sources import bucketed, csv_tables, images

QUERIES, ORACLES = {}, {}


def registered(oracle: str | None = None, name: str | None = None):
    def add(function):
        key = name or function.__name__
        QUERIES[key] = function
        if oracle is not None:
            ORACLES[key] = oracle
        return function

    return add


def as_double(*names: str):
    return lambda df: df.withColumns({n: F.col(n).cast("double") for n in names})


def as_text(*names: str):
    return lambda df: df.withColumns({n: F.col(n).cast("string") for n in names})


# ---- aggregates -----------------------------------------------------------------------


@registered("SELECT count(*) AS n FROM customer")
def count_all(spark, sf):
    return analytics.count_all(view(spark, sf, "patients"))


@registered("SELECT count(*) AS n FROM orders WHERE lower(o_orderstatus) = 'p'")
def count_status(spark, sf):
    appointments = view(spark, sf, "appointments")
    return analytics.count_where(appointments, F.lower("status") == "cancelled")


@registered(
    with_views(
        "xray",
        then="SELECT image_label, count(*) AS n FROM xray "
        "WHERE image_label IN ('NORMAL', 'PNEUMONIA') GROUP BY image_label",
    )
)
def count_by_label(spark, sf):
    return analytics.count_by(view(spark, sf, "xray"), ["image_label"], ["NORMAL", "PNEUMONIA"])


@registered(
    "SELECT CAST(sum(CAST(o_totalprice AS DECIMAL(10,2))) AS DOUBLE) AS total, count(*) AS n FROM orders"
)
def sum_amount(spark, sf):
    return analytics.sum_by(view(spark, sf, "billing"), "amount").transform(as_double("total"))


@registered(
    with_views(
        "billing",
        then="SELECT payment_status, payment_method, CAST(sum(amount) AS DOUBLE) AS total, count(*) AS n "
        "FROM billing GROUP BY payment_status, payment_method",
    )
)
def sum_by_group(spark, sf):
    billing = view(spark, sf, "billing")
    return analytics.sum_by(billing, "amount", ["payment_status", "payment_method"]).transform(
        as_double("total")
    )


@registered(
    with_views(
        "treatments",
        then="""
        SELECT CAST((SELECT min(cost) FROM treatments) AS DOUBLE) AS lowest,
               (SELECT min(treatment_id) FROM treatments
                WHERE cost = (SELECT min(cost) FROM treatments)) AS lowest_treatment_id,
               CAST((SELECT max(cost) FROM treatments) AS DOUBLE) AS highest,
               (SELECT min(treatment_id) FROM treatments
                WHERE cost = (SELECT max(cost) FROM treatments)) AS highest_treatment_id""",
    )
)
def extremes(spark, sf):
    treatments = view(spark, sf, "treatments")
    return analytics.extremes(treatments, "cost", ["treatment_id"]).transform(as_double("lowest", "highest"))


@registered(
    with_views(
        "appointments",
        then="""SELECT patient_id, n FROM (
            SELECT patient_id, count(*) AS n, rank() OVER (ORDER BY count(*) DESC) AS r
            FROM appointments GROUP BY patient_id) WHERE r = 1""",
    )
)
def argmax_group(spark, sf):
    return analytics.argmax_groups(view(spark, sf, "appointments"), ["patient_id"])


@registered(
    with_views(
        "appointments",
        then="SELECT patient_id, count(*) AS n FROM appointments GROUP BY patient_id HAVING count(*) > 3",
    )
)
def having_over_n(spark, sf):
    return analytics.having_more_than(view(spark, sf, "appointments"), ["patient_id"], 3)


@registered(
    """SELECT o_orderpriority AS reason_for_visit, count(*) AS n,
              count(*) FILTER (WHERE o_orderstatus = 'F') AS completed,
              count(*) FILTER (WHERE o_orderstatus = 'P') AS cancelled
       FROM orders GROUP BY o_orderpriority"""
)
def conditional_counts(spark, sf):
    return analytics.conditional_counts(
        view(spark, sf, "appointments"),
        ["reason_for_visit"],
        {"completed": F.col("status") == "Completed", "cancelled": F.col("status") == "Cancelled"},
    )


# ---- filters and joins ----------------------------------------------------------------


@registered(
    """SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(10,2)) AS DOUBLE) AS total
       FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'"""
)
def filter_exact(spark, sf):
    orders = table(spark, sf, "orders")
    kept = orders.where((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "F"))
    return kept.select("o_orderkey", F.col("o_totalprice").cast("decimal(10,2)").cast("double").alias("total"))


@registered(
    with_views(
        "doctors",
        then="SELECT doctor_id, specialization FROM doctors WHERE lower(specialization) = 'oncology'",
    )
)
def lookup_attribute(spark, sf):
    doctors = view(spark, sf, "doctors").select("doctor_id", "specialization")
    return analytics.lookup(doctors, "specialization", "ONCOLOGY")


@registered("SELECT doc_id, lang, n_chars FROM documents WHERE source = 'src3'")
def filter_source(spark, sf):
    """The store keeps one folder per source, so the filter picks the folder."""
    path = scratch_path(spark, "documents")
    documents = table(spark, sf, "documents")
    documents.write.partitionBy("source").parquet(path)
    stored = spark.read.schema(documents.schema).parquet(path)
    return stored.where(F.col("source") == "src3").select("doc_id", "lang", "n_chars")


@registered(
    "SELECT event_id, event_type FROM events WHERE CAST(json_extract_string(props, '$.k') AS INT) = 12"
)
def metadata_filter(spark, sf):
    events = table(spark, sf, "events")
    return events.where(metadata_contains("props", {"k": 12})).select("event_id", "event_type")


@registered(
    with_views(
        "treatments",
        "appointments",
        then="""SELECT treatment_id, patient_id, doctor_id, CAST(cost AS DOUBLE) AS cost
                FROM treatments JOIN appointments USING (appointment_id)""",
    )
)
def join_two(spark, sf):
    treatments = view(spark, sf, "treatments").select("treatment_id", "appointment_id", "cost")
    visits = view(spark, sf, "appointments").select("appointment_id", "patient_id", "doctor_id")
    joined = skew_join(treatments, visits, ["appointment_id"], salt_on=["treatment_id"])
    return joined.drop("appointment_id").transform(as_double("cost"))


_STAR_SQL = with_views(
    "treatments",
    "appointments",
    "patients",
    "doctors",
    then="""SELECT d.hospital_branch, p.insurance_provider, t.treatment_type, count(*) AS n,
                   CAST(sum(t.cost) AS DOUBLE) AS total
            FROM treatments t JOIN appointments a USING (appointment_id)
            JOIN patients p ON a.patient_id = p.patient_id
            JOIN doctors d ON a.doctor_id = d.doctor_id
            GROUP BY d.hospital_branch, p.insurance_provider, t.treatment_type""",
)


@registered(_STAR_SQL)
def star_join(spark, sf):
    """The fact is dealt once by appointment, for its sums and for the join; patients and doctors
    are sent to it if Spark finds them small enough; one aggregate ends the query."""
    treatments, visits = view(spark, sf, "treatments"), view(spark, sf, "appointments")
    fact = treatments.select("appointment_id", "treatment_type", "cost").repartition("appointment_id")
    return _star(spark, sf, fact, visits.select("appointment_id", "patient_id", "doctor_id"))


def _star(spark, sf, fact, visits, sent=lambda parent: parent):
    per_visit = fact.groupBy("appointment_id", "treatment_type").agg(F.count(F.lit(1)).alias("n"), F.sum("cost").alias("total"))
    patients = view(spark, sf, "patients").select("patient_id", "insurance_provider")
    doctors = view(spark, sf, "doctors").select("doctor_id", "hospital_branch")
    return (
        per_visit.join(visits, "appointment_id")
        .join(sent(patients), "patient_id")
        .join(sent(doctors), "doctor_id")
        .groupBy("hospital_branch", "insurance_provider", "treatment_type")
        .agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
        .transform(as_double("total"))
    )


def _bucketed(spark, rows, key, buckets=8):
    found = bucketed.BucketedTable(f"caselens_{uuid.uuid4().hex}", scratch_path(spark, "bucketed"), rows.schema, key, buckets)
    found.append(rows)
    return found.open(spark)


def _sent_if_small(parent):
    stored = write_and_reread(parent, "parent")
    return F.broadcast(stored) if fits_broadcast(stored) else stored


@registered(_STAR_SQL)
def star_join_bucketed(spark, sf):
    """The fact and its visits are stored in buckets of the appointment: neither moves again."""
    fact = view(spark, sf, "treatments").select("appointment_id", "treatment_type", "cost")
    visits = view(spark, sf, "appointments").select("appointment_id", "patient_id", "doctor_id")
    n = bucketed.buckets_for(fact, 8)
    return _star(spark, sf, _bucketed(spark, fact, "appointment_id", n), _bucketed(spark, visits, "appointment_id", n), _sent_if_small)


@registered(
    with_views(
        "xray",
        "appointments",
        then="""SELECT x.xray_id, a.appointment_id, a.patient_id, CAST(a.appointment_date AS VARCHAR) AS visited
                FROM xray x JOIN appointments a USING (appointment_id) WHERE x.image_label = 'PNEUMONIA'""",
    )
)
def lookup_join(spark, sf):
    """The X-rays that are asked about, each with its appointment. An X-ray's appointment
    may have many X-rays."""
    asked = view(spark, sf, "xray").where(F.col("image_label") == "PNEUMONIA").select("xray_id", "appointment_id")
    visits = view(spark, sf, "appointments").select(
        "appointment_id", "patient_id", F.col("appointment_date").alias("visited")
    )
    return skew_join(asked, visits, ["appointment_id"], salt_on=["xray_id"]).transform(as_text("visited"))


@registered(
    """SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(10,2)) AS DOUBLE) AS total
       FROM orders ORDER BY total DESC NULLS LAST, o_orderkey"""
)
def sort_records(spark, sf):
    orders = table(spark, sf, "orders").select(
        "o_orderkey", F.col("o_totalprice").cast("decimal(10,2)").cast("double").alias("total")
    )
    return analytics.sort_records(orders, "total", ["o_orderkey"])


# ---- quality --------------------------------------------------------------------------


@registered(
    """SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem
       GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1"""
)
def check_primary_key(spark, sf):
    return quality.primary_key_violations(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


_ORPHANS_SQL = """SELECT o_custkey, count(*) AS n_rows FROM orders
       WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_mktsegment <> 'MACHINERY')
       GROUP BY o_custkey"""


@registered(_ORPHANS_SQL)
def check_foreign_key(spark, sf):
    kept = table(spark, sf, "customer").where(F.col("c_mktsegment") != "MACHINERY")
    return quality.foreign_key_violations(table(spark, sf, "orders"), "o_custkey", kept, "c_custkey")


@registered(_ORPHANS_SQL)
def check_foreign_key_bucketed(spark, sf):
    """Both sides stored in buckets of the reference: the check moves nothing."""
    kept = table(spark, sf, "customer").where(F.col("c_mktsegment") != "MACHINERY").select("c_custkey")
    used = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    n = bucketed.buckets_for(used, 8)
    return quality.foreign_key_violations(
        _bucketed(spark, used, "o_custkey", n), "o_custkey", _bucketed(spark, kept, "c_custkey", n), "c_custkey"
    )


def _record_tables(spark, sf):
    names = ["doctors", "patients", "appointments", "treatments", "billing", "xray"]
    return {name: view(spark, sf, name) for name in names}


def _violations_sql() -> str:
    parts = []
    for name, spec in RECORD_TABLES.items():
        parts.append(
            f"SELECT '{name}' AS table_name, 'primary key' AS rule, '{spec.key}' AS column_name, "
            f"count(*) AS n_values, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_rows FROM "
            f"(SELECT count(*) AS n FROM {name} GROUP BY {spec.key} HAVING count(*) > 1)"
        )
        for fk, (parent, pk) in spec.references.items():
            parts.append(
                f"SELECT '{name}', 'reference', '{fk}', count(DISTINCT {fk}), count(*) FROM {name} c "
                f"WHERE NOT EXISTS (SELECT 1 FROM {parent} p WHERE p.{pk} = c.{fk})"
            )
    return with_views(*RECORD_TABLES, then=" UNION ALL ".join(parts))


@registered(_violations_sql())
def check_record_tables(spark, sf):
    return quality.check_record_tables(_record_tables(spark, sf))


def _columns(spark, sf):
    return {name: table(spark, sf, name) for name in TABLES}


_COLUMNS = {
    "region": "r_regionkey r_name",
    "nation": "n_nationkey n_name n_regionkey",
    "customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment",
    "supplier": "s_suppkey s_name s_nationkey s_acctbal",
    "part": "p_partkey p_name p_brand p_type p_size p_retailprice",
    "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority",
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax "
    "l_returnflag l_linestatus l_shipdate",
    "events": "event_id ts user_id event_type value props",
    "documents": "doc_id text lang source n_chars",
    "embeddings": "vec_id embedding label",
    "pages": "page_id url html",
    "benchmark": "item_id text",
    "labels": "doc_id quality toxic",
    "conversations": "conv_id turn role text",
}


@registered(
    " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, '{c}' AS column_name, count(*) AS n_rows, "
        f"count(*) - count({c}) AS n_nulls FROM {t}"
        for t, columns in _COLUMNS.items()
        for c in columns.split()
    )
)
def check_not_null(spark, sf):
    checks = [quality.null_counts(table(spark, sf, t), t, columns.split()) for t, columns in _COLUMNS.items()]
    return reduce(DataFrame.unionByName, checks)


@registered(
    with_views(
        "raw_events",
        then="""SELECT event_id, 'value_text' AS column_name, value_text AS bad_value,
                       'decimal(10,2)' AS expected_type
                FROM raw_events WHERE value_text IS NOT NULL AND try_cast(value_text AS DECIMAL(10,2)) IS NULL
                UNION ALL
                SELECT event_id, 'date_text', date_text, 'date'
                FROM raw_events WHERE date_text IS NOT NULL AND try_cast(date_text AS DATE) IS NULL""",
    )
)
def check_types(spark, sf):
    wanted = {"value_text": "decimal(10,2)", "date_text": "date"}
    return quality.type_rejects(view(spark, sf, "raw_events"), "event_id", wanted)


@registered("SELECT vec_id, CAST(len(embedding) AS INT) AS n_dims FROM embeddings WHERE len(embedding) <> 32")
def check_width(spark, sf):
    return quality.width_rejects(table(spark, sf, "embeddings"), "vec_id", "embedding", 32)


# ---- load -----------------------------------------------------------------------------


@registered(
    with_views(
        "billing",
        then="""SELECT bill_id, patient_id, treatment_id, CAST(bill_date AS VARCHAR) AS bill_date,
                       CAST(amount AS DOUBLE) AS amount, payment_method, payment_status FROM billing""",
    )
)
def csv_ingest(spark, sf):
    """Write the bills as CSV, load them typed into a table twice, read the table."""
    source, target = scratch_path(spark, "bills-csv"), scratch_path(spark, "bills")
    view(spark, sf, "billing").write.option("header", True).csv(source)
    for _ in range(2):  # the second load adds nothing
        rows, _rejects = csv_tables.read_record_table(spark, source, "billing")
        csv_tables.append_new(rows, target, ["bill_id"])
    loaded = spark.read.schema(RECORD_TABLES["billing"].schema).parquet(target)
    return loaded.transform(as_double("amount")).transform(as_text("bill_date"))


@registered(
    with_views(
        "appointments",
        then="""SELECT appointment_id, CAST(appointment_date AS VARCHAR) AS appointment_date,
                       CASE WHEN length(appointment_time) = 7 THEN '0' ELSE '' END || appointment_time
                           AS appointment_time
                FROM appointments WHERE status <> 'Scheduled'""",
    )
)
def csv_times(spark, sf):
    """Times lose no digit; rows with a time that is none are rejected (here the scheduled
    ones, whose time is spoiled in the file)."""
    source = scratch_path(spark, "visits-csv")
    visits = view(spark, sf, "appointments")
    spoiled = F.when(F.col("status") == "Scheduled", F.lit("25:15:00")).otherwise(F.col("appointment_time"))
    visits.withColumn("appointment_time", spoiled).write.option("header", True).csv(source)
    rows, _rejects = csv_tables.read_record_table(spark, source, "appointments")
    return rows.select("appointment_id", "appointment_date", "appointment_time").transform(
        as_text("appointment_date")
    )


_AUDIT_DOCS = """SELECT source AS source_table, CAST(doc_id AS VARCHAR(20)) AS source_id,
    CASE WHEN n_chars < 200 THEN '  ' ELSE text END AS content FROM {documents}"""
_AUDIT_HAVE = """SELECT source AS source_table, CAST(d.doc_id AS VARCHAR(20)) AS source_id
    FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id"""


def _audit_inputs(spark, sf):
    tables = {t: table(spark, sf, t) for t in ("documents", "labels")}
    return spark.sql(_AUDIT_DOCS, documents=tables["documents"]), spark.sql(_AUDIT_HAVE, **tables)


@registered(
    f"""WITH d AS ({_AUDIT_DOCS.format(documents="documents")}),
             e AS (SELECT DISTINCT * FROM ({_AUDIT_HAVE.format(documents="documents", labels="labels")}))
        SELECT d.source_table, count(*) AS n_documents,
               count(*) FILTER (WHERE trim(content) = '') AS n_blank,
               count(*) FILTER (WHERE trim(content) <> '' AND e.source_id IS NOT NULL) AS n_embedded,
               count(*) FILTER (WHERE trim(content) <> '' AND e.source_id IS NULL) AS n_to_embed
        FROM d LEFT JOIN e ON d.source_table = e.source_table AND d.source_id = e.source_id
        GROUP BY d.source_table"""
)
def load_audit(spark, sf):
    return documents.load_audit(*_audit_inputs(spark, sf))


@registered(
    f"""WITH d AS ({_AUDIT_DOCS.format(documents="documents")}),
             e AS ({_AUDIT_HAVE.format(documents="documents", labels="labels")})
        SELECT source_table, source_id FROM d
        WHERE trim(content) <> '' AND NOT EXISTS (
            SELECT 1 FROM e WHERE e.source_table = d.source_table AND e.source_id = d.source_id)""",
    name="unembedded",
)
def unembedded_documents(spark, sf):
    return unembedded(*_audit_inputs(spark, sf)).select("source_table", "source_id")


@registered(
    with_views(
        "expected_images",
        then=f"""SELECT p_partkey, image_path,
                        image_path IN ({", ".join(f"'{t}.parquet'" for t in TABLES)}) AS found
                 FROM expected_images""",
    )
)
def image_inventory(spark, sf):
    """Files listed by path, not opened, against the paths records name."""
    files = images.read_images(spark, sf, glob="*.parquet")
    return images.with_found(view(spark, sf, "expected_images"), files)


# ---- bands ----------------------------------------------------------------------------


@registered(
    """SELECT brand, capacity, occupied, occupancy,
              CASE WHEN occupancy >= 100 THEN 'Full' WHEN occupancy >= 50 THEN 'Limited'
                   ELSE 'Available' END AS status
       FROM (SELECT p_brand AS brand, count(*) AS capacity, count(*) FILTER (WHERE p_size > 25) AS occupied,
                    round(100.0 * count(*) FILTER (WHERE p_size > 25) / count(*), 1) AS occupancy
             FROM part GROUP BY p_brand)"""
)
def status_bands(spark, sf):
    part = table(spark, sf, "part")
    wards = part.groupBy(F.col("p_brand").alias("brand")).agg(
        F.count(F.lit(1)).alias("capacity"), F.count_if(F.col("p_size") > 25).alias("occupied")
    )
    rated = wards.withColumn("occupancy", bands.occupancy(F.col("occupied"), F.col("capacity")))
    return rated.withColumn("status", bands.occupancy_band(F.col("occupancy"), limited_from=50.0))


@registered(
    """SELECT p_partkey, CASE WHEN p_size < 10 + p_partkey % 20 THEN 'Reorder Triggered'
                              ELSE 'Adequate Stock' END AS status FROM part"""
)
def stock_bands(spark, sf):
    part = table(spark, sf, "part")
    level = 10 + F.col("p_partkey") % 20
    return part.select("p_partkey", bands.stock_band(F.col("p_size"), level).alias("status"))


# ---- SQL tool -------------------------------------------------------------------------

_QUESTION = """
    SELECT d.specialization, a.status, count(*) AS n_visits, count(DISTINCT a.patient_id) AS n_patients
    FROM appointments a JOIN doctors d ON a.doctor_id = d.doctor_id
    GROUP BY d.specialization, a.status"""


@registered(with_views("appointments", "doctors", then=_QUESTION))
def guarded_sql(spark, sf):
    for name, df in _record_tables(spark, sf).items():
        df.createOrReplaceTempView(name)
    return sql_tool.guarded_sql(spark, f"  {_QUESTION} ; ")


@registered(
    """SELECT event_id,
              CASE event_type WHEN 'click' THEN NULL
                WHEN 'view' THEN 'SQL operation ''update'' is not allowed.'
                WHEN 'error' THEN 'Only SELECT queries are allowed.'
                WHEN 'purchase' THEN 'Only SELECT queries are allowed.'
                ELSE 'SQL operation ''drop'' is not allowed.' END AS compat_reason,
              CASE event_type WHEN 'error' THEN 'Only SELECT queries are allowed.'
                WHEN 'signup' THEN 'Only one statement is allowed.' ELSE NULL END AS strict_reason,
              event_type = 'click' AS compat_allowed,
              event_type IN ('click', 'view', 'purchase') AS strict_allowed
       FROM events"""
)
def sql_policy(spark, sf):
    texts = view(spark, sf, "sql_texts")
    compat = sql_tool.sql_policy(texts, strict=False).withColumnsRenamed(
        {"reason": "compat_reason", "allowed": "compat_allowed"}
    )
    strict = sql_tool.sql_policy(compat, strict=True).withColumnsRenamed(
        {"reason": "strict_reason", "allowed": "strict_allowed"}
    )
    return strict.drop("sql", "event_type")


@registered(
    f"""WITH n AS ({" UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in TABLES)})
        SELECT c.table_name, CAST(c.ordinal_position AS INT) AS position, c.column_name,
               CASE c.data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string'
                    WHEN 'DOUBLE' THEN 'double' WHEN 'FLOAT[]' THEN 'array<float>'
                    ELSE CASE WHEN c.data_type LIKE 'TIMESTAMP%' THEN 'timestamp_ntz' ELSE c.data_type END END AS column_type, n.n_rows
        FROM information_schema.columns c JOIN n ON n.table_name = c.table_name"""
)
def schema_catalog(spark, sf):
    """What may be asked about, with the size of each table."""
    tables = _columns(spark, sf)
    return sql_tool.schema_catalog(spark, tables).join(csv_tables.row_counts(tables), "table_name")
