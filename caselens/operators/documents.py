"""Record rows rendered as text documents with JSON metadata.

Every function gives (source_table, source_id, content, metadata).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Observation, functions as F

from caselens.functions.text import has_content, metadata_json, render
from caselens.operators.embed import describe_images
from caselens.operators.skew import skew_join
from caselens.schemas import RECORD_TABLES

# Document wording and metadata fields (key -> column) per record table.
TEMPLATES = {
    "doctors": "Dr. {first_name} {last_name} is a {specialization} specialist with "
    "{years_experience} years of experience, based at {hospital_branch}.",
    "patients": "Patient {first_name} {last_name}, {gender}, born {date_of_birth}, "
    "registered on {registration_date}, insured with {insurance_provider}.",
    "appointments": "Appointment on {appointment_date}, reason: {reason_for_visit}. Status: {status}.",
    "treatments": "Treatment type: {treatment_type}. Description: {description}. "
    "Cost: ${cost}. Date: {treatment_date}.",
    "billing": "Bill of ${amount} via {payment_method}, status: {payment_status}, dated {bill_date}.",
    "xray": "{description}",
}
METADATA = {
    "doctors": {"doctor_id": "doctor_id", "specialization": "specialization", "branch": "hospital_branch"},
    "patients": {"patient_id": "patient_id", "gender": "gender", "insurance_provider": "insurance_provider"},
    "appointments": {
        "patient_id": "patient_id",
        "doctor_id": "doctor_id",
        "date": "appointment_date",
        "status": "status",
    },
    "treatments": {
        "patient_id": "patient_id",
        "doctor_id": "doctor_id",
        "treatment_type": "treatment_type",
        "date": "treatment_date",
    },
    "billing": {"patient_id": "patient_id", "payment_status": "payment_status", "date": "bill_date"},
    "xray": {
        "xray_id": "xray_id",
        "image_label": "image_label",
        "image_path": "image_path",
        "appointment_id": "appointment_id",
        "treatment_id": "treatment_id",
    },
}


def record_documents(df: DataFrame, table: str) -> DataFrame:
    return df.select(
        F.lit(table).alias("source_table"),
        F.col(RECORD_TABLES[table].key).alias("source_id"),
        render(TEMPLATES[table]).alias("content"),
        metadata_json(df, METADATA[table]).alias("metadata"),
    )


def doctor_documents(doctors: DataFrame) -> DataFrame:
    return record_documents(doctors, "doctors")


def patient_documents(patients: DataFrame) -> DataFrame:
    return record_documents(patients, "patients")


def appointment_documents(appointments: DataFrame) -> DataFrame:
    return record_documents(appointments, "appointments")


def treatment_documents(treatments: DataFrame, appointments: DataFrame) -> DataFrame:
    """Treatments take their patient and doctor from the appointment. One appointment
    may have very many treatments."""
    visits = appointments.select("appointment_id", "patient_id", "doctor_id")
    joined = skew_join(treatments, visits, ["appointment_id"], salt_on=["treatment_id"])
    return record_documents(joined, "treatments")


def billing_documents(billing: DataFrame) -> DataFrame:
    return record_documents(billing, "billing")


def xray_documents(images: DataFrame, describer: Callable[[str, bytes], str], **options) -> DataFrame:
    """``images``: xray rows with the image bytes in ``content``. Images that could not
    be described have no text and are left out by the blank filter; see
    :func:`describe_images` for their errors."""
    return described_documents(describe_images(images, describer, **options))


def described_documents(described: DataFrame) -> DataFrame:
    """``described``: xray rows with the ``description`` of their image."""
    return record_documents(described.where(F.col("description").isNotNull()), "xray")


def all_documents(*parts: DataFrame) -> DataFrame:
    """The union of document sets without blank ones."""
    return reduce(DataFrame.unionByName, parts).where(has_content("content"))


def load_audit(documents: DataFrame, existing: DataFrame) -> DataFrame:
    """Per source table: documents, blank ones, those that have a vector, those to embed.

    Keys of both sides are counted per value first, so the join sees each key once.
    """
    keys = ["source_table", "source_id"]
    wanted = documents.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~has_content("content")).alias("blank")
    )
    have = existing.select(*keys).distinct().withColumn("_have", F.lit(True))
    return (
        wanted.join(have, keys, "left")
        .groupBy("source_table")
        .agg(
            F.sum("n").alias("n_documents"),
            F.sum("blank").alias("n_blank"),
            F.sum(F.when(F.col("_have"), F.col("n") - F.col("blank")).otherwise(0)).alias("n_embedded"),
            F.sum(F.when(F.col("_have"), 0).otherwise(F.col("n") - F.col("blank"))).alias("n_to_embed"),
        )
    )


def append_audited(documents: DataFrame, existing: DataFrame, path: str, source_tables: list[str]) -> DataFrame:
    """Append the documents that have content and no vector yet to the table at ``path``, and return
    what :func:`load_audit` counts, per source table of the given ones.

    The counts are taken while the rows go by on their way to storage: nothing is read
    back, and no second pass is made. Other source tables are written but not counted.
    """
    keys = ["source_table", "source_id"]
    kinds = {
        "n_documents": F.lit(True),
        "n_blank": ~has_content("content"),
        "n_embedded": has_content("content") & F.col("_have"),
        "n_to_embed": has_content("content") & ~F.col("_have"),
    }
    have = existing.select(*keys).distinct().withColumn("_have", F.lit(True))
    marked = skew_join(documents, have, keys, how="left").withColumn("_have", F.coalesce("_have", F.lit(False)))
    seen = Observation()
    counts = [
        F.count_if((F.col("source_table") == name) & kind).alias(f"{n}_{column}")
        for n, name in enumerate(source_tables)
        for column, kind in kinds.items()
    ]
    todo = marked.observe(seen, *counts).where(kinds["n_to_embed"]).drop("_have")
    todo.select(*documents.columns).write.mode("append").parquet(path)
    rows = [(name, *[seen.get[f"{n}_{column}"] for column in kinds]) for n, name in enumerate(source_tables)]
    schema = "source_table string, " + ", ".join(f"{column} bigint" for column in kinds)
    return documents.sparkSession.createDataFrame(rows, schema)
