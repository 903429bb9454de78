"""From CSV files to the vector table, and from questions to answers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from caselens.operators import context, documents, embed, topk
from caselens.operators.quality import check_record_tables
from caselens.operators.skew import missing_from, skew_join
from caselens.schemas import DEFAULT_TOP_K, RECORD_TABLES
from caselens.scratch import shuffles_dropped, write_and_reread
from caselens.sources import csv_tables, images, vector_store

KEYS = ["source_table", "source_id"]


def load_tables(spark: SparkSession, csv_dir: str, target: str) -> dict[str, DataFrame]:
    """Append what is new in the CSV files to the tables below ``target`` (one folder
    each); rejected rows go to ``target/rejects/<table>``."""
    loaded = {}
    for name, spec in RECORD_TABLES.items():
        rows, rejects = csv_tables.read_record_table(spark, f"{csv_dir}/{name}.csv", name)
        csv_tables.append_new(rows, f"{target}/{name}", [spec.key])
        rejects.write.mode("overwrite").parquet(f"{target}/rejects/{name}")
        loaded[name] = csv_tables.existing_table(spark, f"{target}/{name}", spec.schema)
    return loaded


def described_images(
    xray: DataFrame,
    image_files: DataFrame,
    describer: Callable[[str, bytes], str],
    existing: DataFrame | None = None,
    **options,
) -> DataFrame:
    """The X-rays that have no vector yet, with ``description`` and ``describe_error``. A file is
    described once, however many X-rays name it and whatever is done with the result."""
    if existing is not None:
        have = existing.where(F.col("source_table") == "xray").select(F.col("source_id").alias("xray_id"))
        xray = missing_from(xray, have, ["xray_id"])
    xray = write_and_reread(xray, "new-images")
    described = images.described_files(
        image_files, xray, lambda files: embed.describe_images(files, describer, **options)
    )
    found = skew_join(xray, described, ["image_path"], how="left", salt_on=["xray_id"])
    missing = F.concat(F.lit("image not found: "), F.col("image_path"))
    nothing = F.col("description").isNull() & F.col("describe_error").isNull()
    return found.withColumn("describe_error", F.when(nothing, missing).otherwise(F.col("describe_error")))


def table_documents(
    tables: dict[str, DataFrame],
    image_files: DataFrame,
    describer: Callable[[str, bytes], str],
    existing: DataFrame | None = None,
    **options,
) -> DataFrame:
    """The documents of all six record tables; of X-rays only those ``existing`` does not hold,
    as each costs a call. ``options`` go to the image description."""
    pictures = described_images(tables["xray"], image_files, describer, existing, **options)
    return documents.all_documents(
        documents.doctor_documents(tables["doctors"]),
        documents.patient_documents(tables["patients"]),
        documents.appointment_documents(tables["appointments"]),
        documents.treatment_documents(tables["treatments"], tables["appointments"]),
        documents.billing_documents(tables["billing"]),
        documents.described_documents(pictures),
    )


def ingest(
    spark: SparkSession,
    csv_dir: str,
    target: str,
    embedder: embed.Embedder,
    describer: Callable[[str, bytes], str],
    **options,
) -> tuple[DataFrame, DataFrame]:
    """Load the tables, embed their new documents, append them to ``target/embeddings``.

    Returns (vector table, key and reference violations). A second run adds nothing.
    ``options`` (attempts, delay) go to the embedding and description calls.
    """
    store = f"{target}/embeddings"
    with shuffles_dropped(spark):
        tables = load_tables(spark, csv_dir, target)
        existing = vector_store.stored_vectors(spark, store)
        new = table_documents(tables, images.read_images(spark, csv_dir), describer, existing, **options)
        for part in embed.embedded_parts(new, embedder, existing, **options):
            vector_store.append_vectors(part, store)
    return vector_store.read_vectors(spark, store), check_record_tables(tables)


def embed_questions(questions: DataFrame, embedder: embed.Embedder, **options) -> DataFrame:
    """``questions`` (question_id, question) with embedding and embed_error, stored so that
    each question is embedded once."""
    return write_and_reread(embed.embed_texts(questions, "question", embedder, **options), "questions")


def retrieve(
    questions: DataFrame,
    store: DataFrame,
    embedder: embed.Embedder,
    *,
    width: int,
    k: int = DEFAULT_TOP_K,
    **options,
) -> DataFrame:
    """``questions`` -> (question_id, source_table, source_id, distance, rank, content,
    metadata). A filter on ``store`` applies before the search. Questions may come with
    their embedding; those without one find nothing."""
    if "embedding" not in questions.columns:
        questions = embed_questions(questions, embedder, **options)
    asked = questions.where(F.col("embedding").isNotNull())
    best = topk.nearest(store, asked, k, width=width)
    contents = store.select(*KEYS, "content", "metadata")
    return topk.fetch(best, contents, KEYS)


def prompts(questions: DataFrame, retrieved: DataFrame, **options) -> DataFrame:
    """Add the prompt of each question."""
    contexts = context.concat_context(context.context_chunks(retrieved))
    return context.build_prompts(questions, contexts, **options)


def answer(
    questions: DataFrame,
    store: DataFrame,
    embedder: embed.Embedder,
    models: list[tuple[str, Callable[[str], str]]],
    *,
    width: int,
    k: int = DEFAULT_TOP_K,
    **options,
) -> DataFrame:
    """(question_id, question, answer, model_used, error). A question that could not be
    embedded is not asked; its error says why. The answers are stored, so each question is
    asked once whatever is done with them. ``options`` go to the embedding calls."""
    embedded = embed_questions(questions.select("question_id", "question"), embedder, **options)
    ready = embedded.where(F.col("embedding").isNotNull())
    found = retrieve(ready, store, embedder, width=width, k=k)
    asked = prompts(ready.select("question_id", "question"), found)
    answers = embed.batch_answer(asked, models).drop("prompt")
    nothing = F.lit(None).cast("string")
    failed = embedded.where(F.col("embedding").isNull()).select(
        "question_id",
        "question",
        nothing.alias("answer"),
        nothing.alias("model_used"),
        F.col("embed_error").alias("error"),
    )
    return write_and_reread(answers.unionByName(failed), "answers")
