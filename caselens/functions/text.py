"""Text rendering that matches how Python prints records."""

from __future__ import annotations

import json
from decimal import Decimal
from string import Formatter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

# Fixed value: the characters Python's str.strip() removes, as a regex class body.
PYTHON_SPACE = (
    r"\t\n\x0B\f\r\x1C-\x1F\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)

# The same characters themselves.
PYTHON_SPACE_CHARS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def as_text(column: Column | str) -> Column:
    """The value as text, NULL as ``None``."""
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column.cast("string"), F.lit("None"))


def render(template: str) -> Column:
    """Turn ``"Bill of ${amount}"`` into one concatenation of literals and columns."""
    pieces: list[Column] = []
    for literal, name, _, _ in Formatter().parse(template):
        if literal:
            pieces.append(F.lit(literal))
        if name:
            pieces.append(as_text(name))
    return F.concat(*pieces)


def has_content(column: Column | str) -> Column:
    """True for text that is neither NULL nor only whitespace."""
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column.rlike(f"[^{PYTHON_SPACE}]"), F.lit(False))


def strip(column: Column | str) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return F.trim(column, F.lit(PYTHON_SPACE_CHARS))


def metadata_json(df: DataFrame, fields: dict[str, str]) -> Column:
    """JSON text with null-valued keys kept and dates as text.

    Keys come out shortest first, then by bytes: the order a binary JSON column
    gives them back in.
    """
    columns = []
    for key in sorted(fields, key=lambda k: (len(k.encode()), k.encode())):
        source = fields[key]
        is_date = isinstance(df.schema[source].dataType, (T.DateType, T.TimestampType))
        columns.append((as_text(source) if is_date else F.col(source)).alias(key))
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def _number(text: str) -> int | float:
    """A JSON number as a decimal column gives it back: ``1e3`` is 1000, ``1.50`` is 1.5."""
    plain = format(Decimal(text), "f")
    return float(plain) if "." in plain else int(plain)


def _in_order(value):
    """Keys by length, then bytes, at every depth: the order of a binary JSON column."""
    if isinstance(value, dict):
        return {k: _in_order(value[k]) for k in sorted(value, key=lambda k: (len(k.encode()), k.encode()))}
    return [_in_order(v) for v in value] if isinstance(value, list) else value


@F.arrow_udf(T.StringType())
def _pretty(texts: pa.Array) -> pa.Array:
    def one(text: str | None) -> str:
        if text is None:
            return "null"
        try:
            value = json.loads(text, parse_float=_number, parse_constant=_no_constant)
        except ValueError:
            value = text
        return json.dumps(_in_order(value), indent=2, ensure_ascii=False)

    return pa.array([one(t) for t in texts.to_pylist()], pa.string())


def _no_constant(name: str):
    raise ValueError(name)


def pretty_json(column: Column | str) -> Column:
    """JSON on lines indented by two per depth; text that is not JSON is quoted as it is."""
    return _pretty(F.col(column) if isinstance(column, str) else column)


def rows_as_json(df: DataFrame, name: str = "row_json") -> Column:
    """Every column of the row as one JSON object; dates and decimals become text."""
    stringly = (T.DateType, T.TimestampType, T.TimestampNTZType, T.DecimalType)

    def safe(field: T.StructField) -> Column:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, stringly):
            column = column.cast("string")
        return column.alias(field.name)

    columns = [safe(f) for f in df.schema.fields]
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias(name)
