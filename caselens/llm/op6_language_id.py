"""Language identification by Bayesian fusion of evidence.

For each language: the likelihood of the text's byte trigrams, the probability of the
declared language (markup, or a column), of the address suffix, and a prior from the host. The
text model is counted over all texts with a declared language. What a declaration or a
suffix says is measured by grouped aggregates against the language that the text alone suggests,
so an unreliable declaration weighs little. Host priors are smoothed upwards: a host by its
domain (the last two labels), the domain by all documents, each with the weight of
``KAPPA`` documents. A text's evidence counts as that of ``TRIGRAMS`` trigrams at most, as
trigrams of a text depend on each other.

One more hypothesis, ``und``, holds all trigrams equally likely. A document is rejected if it
has no trigram with letters, if ``und`` wins, or if the winner stays below ``LEAST``.

The tables that reach the driver have a row per language. Hosts, of which there may be any
number, are joined; texts are scored where they are read, twice, and not shuffled for it unless
the host table is too large to be broadcast.

Defined results: null and empty texts are rejected, their language is ``und``; null or malformed
declarations, suffixes and hosts are no evidence; without any declared language all is ``und``;
rows that repeat give the same result each; an empty table gives an empty result; rows keep
their own columns, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from caselens.llm import texts
from caselens.scratch import write_and_reread

BUCKETS = 1 << 14
TRIGRAMS = 200
BLOCK_BYTES = 1 << 18  # of text whose trigrams are held at once, at some 60 bytes each
KAPPA = 20.0
UNDETERMINED = "und"
UNDETERMINED_PRIOR = 1e-3
LEAST = 0.5


def declared_language(tag: Column) -> Column:
    """The primary subtag of a language tag, two or three letters; else null."""
    found = F.regexp_extract(F.lower(F.trim(tag)), r"^([a-z]{2,3})(?:[-_].*)?$", 1)
    return F.when(found != "", found)


def markup_language(html: Column) -> Column:
    return declared_language(F.regexp_extract(html, r"""(?i)<html[^>]*\slang\s*=\s*["']?([A-Za-z_-]+)""", 1))


def host_of(url: Column) -> Column:
    found = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1))
    return F.when(found != "", found)


def suffix_of(host: Column) -> Column:
    found = F.regexp_extract(host, r"\.([a-z]{2,})$", 1)
    return F.when(found != "", found)


def visible_text(html: Column) -> Column:
    text = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"(?s)<[^>]*>", " "), r"&[a-zA-Z]+;|&#[0-9]+;", " "))


_LETTERS = np.full(256, 32, np.uint64)
_LETTERS[97:123] = np.arange(97, 123)
_LETTERS[65:91] = np.arange(97, 123)
_LETTERS[128:] = np.arange(128, 256)


def trigrams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and bucket of every trigram of letters and spaces with two letters at least."""
    body, offsets = texts.raw(column)
    b = _LETTERS[body]
    if len(b) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    letters = (b != 32).astype(np.int8)
    row = np.repeat(np.arange(len(column)), np.diff(offsets))
    good = (letters[:-2] + letters[1:-1] + letters[2:] >= 2) & (row[:-2] == row[2:])
    code = (b[:-2] << np.uint64(16)) + (b[1:-1] << np.uint64(8)) + b[2:]
    bucket = (texts.mix(code) >> np.uint64(50)).astype(np.int64)
    return row[:-2][good], bucket[good]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for block in texts.blocks(batches, size=BLOCK_BYTES):
        row, bucket = trigrams(block.column(1))
        tags = np.array([t or "" for t in block.column(0).to_pylist()], object)
        for tag in set(tags.tolist()) - {""}:
            own = np.bincount(bucket[(tags == tag)[row]], minlength=BUCKETS)
            total[tag] = total.get(tag, 0) + own
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(total), pa.string()), pa.array([c.astype(np.float64).tobytes() for c in total.values()], pa.binary())], names=["tag", "body"]
    )


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        for tag, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            total[tag] = total.get(tag, 0) + np.frombuffer(body)
    for tag, counts in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([tag]), pa.array([counts.tobytes()])], names=["tag", "body"])


@dataclass
class TextModel:
    """Log probabilities of the buckets by language; the last language is ``und``."""

    languages: list[str]
    logs: np.ndarray

    def likelihoods(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(rows x languages) log likelihoods, lessened to ``TRIGRAMS``, and the numbers of trigrams."""
        row, bucket = trigrams(column)
        counts = np.bincount(row, minlength=len(column))
        out = np.stack([np.bincount(row, weights=log[bucket], minlength=len(column)) for log in self.logs], axis=1)
        return out * (np.minimum(counts, TRIGRAMS) / np.maximum(counts, 1))[:, None], counts


def text_model(rows: DataFrame) -> TextModel:
    """From ``_declared``, ``_text``."""
    counted = rows.select("_declared", "_text").mapInArrow(_renamed(_count), "tag string, body binary")
    summed = counted.repartition("tag").mapInArrow(_add, "tag string, body binary")
    found = {r["tag"]: np.frombuffer(r["body"]) for r in summed.collect()}
    languages = sorted(found)
    logs = [np.log((found[t] + 0.5) / (found[t].sum() + 0.5 * BUCKETS)) for t in languages]
    return TextModel([*languages, UNDETERMINED], np.array([*logs, np.full(BUCKETS, -np.log(BUCKETS))]))


def _renamed(function):
    def run(batches):
        return function(b.rename_columns([n if n != "_text" else "text" for n in b.schema.names]) for b in batches)

    return run


def _suggest(model):
    """The language of the text alone, as a number; null without trigrams or for ``und``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in texts.blocks(batches, text="_text", size=BLOCK_BYTES):
            logs, counts = model.value.likelihoods(block.column(block.schema.get_field_index("_text")))
            best = logs.argmax(axis=1)
            none = (counts == 0) | (best == len(model.value.languages) - 1)
            columns = [block.column(block.schema.get_field_index(c)) for c in ("_declared", "_suffix", "_host", "_domain")]
            yield pa.RecordBatch.from_arrays([*columns, texts.nullable(best, none, pa.int32())], names=["_declared", "_suffix", "_host", "_domain", "best"])

    return run


def _by(rows: DataFrame, key: str, n: int) -> DataFrame:
    counts = [F.sum((F.col("best") == i).cast("double")).alias(str(i)) for i in range(n)]
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.array(*counts).alias("n")) if n else None


def _smoothed(counts: Column, parent: Column) -> Column:
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    return F.zip_with(counts, parent, lambda c, p: (c + F.lit(KAPPA) * p) / (total + F.lit(KAPPA)))


def _evidence(values: DataFrame, key: str, overall: list[float]) -> DataFrame:
    """log P(value | language) per value of ``key``; the languages' totals are known."""
    total = F.array(*[F.lit(float(x)) for x in overall])
    n_values = max(1, values.count())
    logs = F.zip_with("n", total, lambda c, t: F.log((c + 0.5) / (t + 0.5 * n_values + 0.5)))
    return values.select(key, logs.alias(f"{key}_logs"))


FUSED = ["language", "confidence", "text_language", "accepted"]


def _fuse(model, columns: list[str], decide: bool):
    """Rows with their fused language, or, with ``decide``, only the accepted rows as they were."""
    extra = ["_prior", "_declared_logs", "_suffix_logs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages = model.value.languages
        for block in texts.blocks(batches, text="_text", size=BLOCK_BYTES):
            n = block.num_rows
            logs, counts = model.value.likelihoods(block.column(block.schema.get_field_index("_text")))
            only = np.where(counts > 0, logs.argmax(axis=1), len(languages) - 1)
            for name in extra:
                column = block.column(block.schema.get_field_index(name))
                own = np.zeros((n, len(languages) - 1))
                there = column.is_valid().to_numpy(zero_copy_only=False)
                if there.any():
                    own[there] = pc.list_flatten(column.filter(pa.array(there))).to_numpy(zero_copy_only=False).reshape(int(there.sum()), -1)
                logs[:, :-1] += own
                if name == "_prior":
                    logs[:, -1] += np.log(UNDETERMINED_PRIOR)
                elif len(languages) > 1:
                    logs[:, -1] += own.mean(axis=1)
            p = np.exp(logs - logs.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            best = np.where(counts > 0, p.argmax(axis=1), len(languages) - 1)
            sure = p[np.arange(n), best]
            accepted = (best < len(languages) - 1) & (sure >= LEAST)
            own = [block.column(block.schema.get_field_index(c)) for c in columns]
            if decide:
                yield pa.RecordBatch.from_arrays(own, names=columns).filter(pa.array(accepted))
            else:
                names = np.array(languages, object)
                fused = [pa.array(names[best], pa.string()), pa.array(sure), pa.array(names[only], pa.string()), pa.array(accepted)]
                yield pa.RecordBatch.from_arrays([*own, *fused], names=[*columns, *FUSED])

    return run


def _with_evidence(docs: DataFrame, kept: list[str], text: Column, declared: Column, host: Column, suffix: Column) -> tuple[DataFrame, TextModel]:
    # the row's own columns in one struct, where their names cannot clash with the ones made here
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_row"), F.coalesce(text, F.lit("")).alias("_text"), declared.alias("_declared"), suffix.alias("_suffix"),
        host.alias("_host"), F.substring_index(host, ".", -2).alias("_domain"),
    )
    model = text_model(rows)
    n = len(model.languages) - 1
    known = docs.sparkSession.sparkContext.broadcast(model)
    suggested = write_and_reread(
        rows.select("_declared", "_suffix", "_host", "_domain", "_text").mapInArrow(
            _suggest(known), "_declared string, _suffix string, _host string, _domain string, best int"
        ),
        "suggested",
    )
    if not n:
        empty = F.lit(None).cast("array<double>")
        return rows.withColumns({"_prior": empty, "_declared_logs": empty, "_suffix_logs": empty}), model
    per = {r["best"]: r["count"] for r in suggested.where("best IS NOT NULL").groupBy("best").count().collect()}
    overall = [float(per.get(i, 0)) for i in range(n)]
    everywhere = F.array(*[F.lit((c + 1) / (sum(overall) + n)) for c in overall])
    domains = _by(suggested, "_domain", n).select("_domain", _smoothed(F.col("n"), everywhere).alias("_p"))
    hosts = _by(suggested.where("_domain IS NOT NULL"), "_host", n).withColumn("_domain", F.substring_index("_host", ".", -2))
    priors = hosts.join(domains, "_domain").select("_host", F.transform(_smoothed(F.col("n"), F.col("_p")), lambda p: F.log(p)).alias("_prior"))
    rows = rows.join(_evidence(_by(suggested, "_declared", n), "_declared", overall), "_declared", "left")
    rows = rows.join(_evidence(_by(suggested, "_suffix", n), "_suffix", overall), "_suffix", "left")
    rows = rows.join(priors, "_host", "left")
    return rows.withColumn("_prior", F.coalesce("_prior", F.transform(everywhere, lambda p: F.log(p)))), model


def identify(docs: DataFrame, columns: list[str], text: Column, declared: Column, host: Column, suffix: Column) -> DataFrame:
    """``columns`` of the rows with ``language``, ``confidence``, ``text_language``, ``accepted``."""
    found = _fused(docs, columns, text, declared, host, suffix, False)
    return found.select(*[F.col("_row")[c].alias(c) for c in columns], *FUSED)


def accepted(docs: DataFrame, text: Column, declared: Column, host: Column, suffix: Column) -> DataFrame:
    """The accepted rows with all their columns."""
    return _fused(docs, docs.columns, text, declared, host, suffix, True).select("_row.*")


def _fused(docs: DataFrame, kept: list[str], text: Column, declared: Column, host: Column, suffix: Column, decide: bool) -> DataFrame:
    rows, model = _with_evidence(docs, kept, text, declared, host, suffix)
    known = docs.sparkSession.sparkContext.broadcast(model)
    needed = rows.select("_row", "_text", "_prior", "_declared_logs", "_suffix_logs")
    schema = StructType([needed.schema["_row"]])
    if not decide:
        schema = schema.add("language", "string").add("confidence", "double").add("text_language", "string").add("accepted", "boolean")
    return needed.mapInArrow(_fuse(known, ["_row"], decide), schema)


def document_evidence() -> dict[str, Column]:
    """For ``documents``: the declared language and, as host, the source; there is no address."""
    return {
        "text": F.col("text"), "declared": declared_language(F.col("lang")),
        "host": F.lower(F.col("source")), "suffix": F.lit(None).cast("string"),
    }


def page_evidence() -> dict[str, Column]:
    """For ``pages``: the markup's language, the address's host and suffix."""
    host = host_of(F.col("url"))
    return {"text": visible_text(F.col("html")), "declared": markup_language(F.col("html")), "host": host, "suffix": suffix_of(host)}
