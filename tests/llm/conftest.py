import pathlib

import duckdb
import pytest

SF = pathlib.Path("/root/testdata/sf0.001")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def rows():
    """All documents of the smallest table."""
    return duckdb.sql(f"SELECT doc_id, text, lang, source, n_chars FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()


BASE = "the quick brown fox jumps over the lazy dog and runs far away from every single other animal in that wide green field "
LONG = "".join(f"word{i % 7919}x{i % 31} " for i in range(60_000))

#: nulls, empty and very long texts, ties, repeated rows
ODD = [
    (1, BASE * 3 + "one", "en", "a", 1),
    (2, BASE * 3 + "one", "en", "a", None),
    (2, BASE * 3 + "one", "en", "a", None),
    (3, BASE.upper() * 3 + "One", None, None, 0),
    (4, None, "en", "b", None),
    (5, "", "", "b", 0),
    (6, " \t\n\x0b\x0c\r ", "en", None, 7),
    (7, LONG, "en", "c", len(LONG)),
    (8, LONG + "end", "en", "c", None),
    (9, "two words", "xx-YY", "c", 9),
    (None, "no id here", "en", "a", 1),
    (None, None, None, None, None),
    (10, "Élan vital ́x <|endoftext|> it's 1,234.5 #1 \U0001f600 \x00 nul", "fr", "d", 3),
    (11, "aaaa " * 300, "en", "d", 3),
    (7, "another text for a repeated id", "en", "c", 3),
]


@pytest.fixture(scope="session")
def odd(spark):
    """The odd rows with further columns named like ones the operators make."""
    extra = "size bigint, shard int, slot string, h bigint, language string, key string, n int, word string, `rid` int"
    return spark.createDataFrame([(*r, 1, 2, "x", 3, "l", "k", 4, "w", 5) for r in ODD], f"{DOCS}, {extra}").repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
