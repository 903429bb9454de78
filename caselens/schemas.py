"""Record tables: columns, keys and references.

Fixed values: the column names, types, keys and references that loaded data must have.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T


@dataclass(frozen=True)
class RecordTable:
    columns: dict[str, str]
    key: str
    references: dict[str, tuple[str, str]] = field(default_factory=dict)

    @property
    def schema(self) -> T.StructType:
        schema = T.StructType()
        for name, kind in self.columns.items():
            schema.add(name, kind)
        return schema


RECORD_TABLES: dict[str, RecordTable] = {
    "doctors": RecordTable(
        {
            "doctor_id": "string",
            "first_name": "string",
            "last_name": "string",
            "specialization": "string",
            "phone_number": "string",
            "years_experience": "integer",
            "hospital_branch": "string",
            "email": "string",
        },
        key="doctor_id",
    ),
    "patients": RecordTable(
        {
            "patient_id": "string",
            "first_name": "string",
            "last_name": "string",
            "gender": "string",
            "date_of_birth": "date",
            "contact_number": "string",
            "address": "string",
            "registration_date": "date",
            "insurance_provider": "string",
            "insurance_number": "string",
            "email": "string",
        },
        key="patient_id",
    ),
    "appointments": RecordTable(
        {
            "appointment_id": "string",
            "patient_id": "string",
            "doctor_id": "string",
            "appointment_date": "date",
            "appointment_time": "string",
            "reason_for_visit": "string",
            "status": "string",
        },
        key="appointment_id",
        references={
            "patient_id": ("patients", "patient_id"),
            "doctor_id": ("doctors", "doctor_id"),
        },
    ),
    "treatments": RecordTable(
        {
            "treatment_id": "string",
            "appointment_id": "string",
            "treatment_type": "string",
            "description": "string",
            "cost": "decimal(10,2)",
            "treatment_date": "date",
        },
        key="treatment_id",
        references={"appointment_id": ("appointments", "appointment_id")},
    ),
    "billing": RecordTable(
        {
            "bill_id": "string",
            "patient_id": "string",
            "treatment_id": "string",
            "bill_date": "date",
            "amount": "decimal(10,2)",
            "payment_method": "string",
            "payment_status": "string",
        },
        key="bill_id",
        references={
            "patient_id": ("patients", "patient_id"),
            "treatment_id": ("treatments", "treatment_id"),
        },
    ),
    "xray": RecordTable(
        {
            "xray_id": "string",
            "appointment_id": "string",
            "treatment_id": "string",
            "image_path": "string",
            "image_label": "string",
        },
        key="xray_id",
        references={
            "appointment_id": ("appointments", "appointment_id"),
            "treatment_id": ("treatments", "treatment_id"),
        },
    ),
}

# Times of day arrive as H:mm:ss or HH:mm:ss and are kept as HH:mm:ss text.
TIME_COLUMNS = {"appointment_time"}

# The vector table.
EMBEDDINGS_KEY = ["source_table", "source_id"]
EMBEDDINGS_NOT_NULL = ["source_table", "source_id", "content"]
EMBEDDINGS_SCHEMA = (
    T.StructType()
    .add("embedding_id", "string")
    .add("source_table", "string")
    .add("source_id", "string")
    .add("content", "string")
    .add("embedding", T.ArrayType(T.FloatType()))
    .add("metadata", "string")
    .add("created_at", "timestamp")
)
DEFAULT_TOP_K = 15
DEFAULT_BATCH = 20
