"""Context and prompts for many questions at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from caselens.functions.text import as_text, pretty_json, strip

# The chunk layout, its indentation, and what joins chunks.
CHUNK_INDENT = " " * 16
CHUNK_SEPARATOR = "\n\n---\n\n"
PROMPT_INDENT = " " * 12
PROMPT_HEADINGS = ("SEMANTIC RETRIEVAL CONTEXT:", "USER QUESTION:")

DEFAULT_INSTRUCTIONS = (
    "You answer questions about hospital records.",
    "",
    "Answer from the records below and from read-only SELECT queries on the record tables.",
    "Use SELECT queries for exact counts, sums, rankings and lookups.",
    "Use the records below for questions about what free text says.",
    "Never invent values. If neither source holds the answer, say that the available",
    "records do not contain enough information.",
)


def distance_text(distance: Column | str) -> Column:
    distance = F.col(distance) if isinstance(distance, str) else distance
    return F.when(F.isnan(distance), F.lit("nan")).otherwise(F.format_string("%.4f", distance))


def context_chunk() -> Column:
    """One retrieved record (source_table, source_id, distance, content, metadata) as text."""
    margin = F.lit("\n" + CHUNK_INDENT)
    gap = F.lit("\n\n" + CHUNK_INDENT)
    return strip(
        F.concat(
            F.lit("SOURCE TABLE: "), as_text("source_table"),
            margin, F.lit("SOURCE ID: "), as_text("source_id"),
            margin, F.lit("SIMILARITY DISTANCE: "), distance_text("distance"),
            gap, F.lit("CONTENT:"), margin, as_text("content"),
            gap, F.lit("METADATA:"), margin, pretty_json("metadata"),
        )
    )


def context_chunks(retrieved: DataFrame) -> DataFrame:
    return retrieved.withColumn("chunk", context_chunk())


def concat_context(chunks: DataFrame, question_id: str = "question_id") -> DataFrame:
    """(question id, context): the chunks of a question, nearest first. A question has
    at most k chunks."""
    return chunks.groupBy(question_id).agg(
        F.expr(f"listagg(chunk, '{CHUNK_SEPARATOR}') within group (order by rank)").alias("context"),
        F.count(F.lit(1)).alias("n_chunks"),
    )


def build_prompts(
    questions: DataFrame,
    contexts: DataFrame,
    question_id: str = "question_id",
    question: str = "question",
    instructions: tuple[str, ...] = DEFAULT_INSTRUCTIONS,
) -> DataFrame:
    """Add ``prompt``: instructions, context, question. A question nothing was found for
    has an empty context."""

    def line(text: str) -> str:
        return f"{PROMPT_INDENT}{text}\n" if text else "\n"

    heading_context, heading_question = PROMPT_HEADINGS
    opening = "\n" + "".join(line(t) for t in instructions) + "\n" + line(heading_context) + "\n"
    middle = "\n\n" + line(heading_question) + "\n"
    joined = questions.join(contexts.select(question_id, "context"), question_id, "left")
    return joined.withColumn(
        "prompt",
        F.concat(
            F.lit(opening),
            F.lit(PROMPT_INDENT), F.coalesce("context", F.lit("")),
            F.lit(middle),
            F.lit(PROMPT_INDENT), as_text(question),
            F.lit("\n" + PROMPT_INDENT),
        ),
    ).drop("context")
