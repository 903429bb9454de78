"""Filters on a JSON metadata column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F


def metadata_contains(column: Column | str, wanted: dict | list | str | float | bool | None) -> Column:
    """True where the JSON holds everything ``wanted`` holds.

    An object holds one whose every field it has, with a value that holds the wanted one. A list
    holds one of whose every element some element of it is a holder; their order and
    number do not count, and any list holds the empty one. Text, numbers, booleans and None are
    held by the same value of the same type. Only at the top a list also holds a bare value.
    """
    document = F.try_parse_json(F.col(column) if isinstance(column, str) else column)
    if not isinstance(wanted, (dict, list)):
        return _held(document, wanted) | _held(document, [wanted])
    return _held(document, wanted)


def _held(found: Column, wanted) -> Column:
    kind = F.schema_of_variant(found)
    if isinstance(wanted, dict):
        fields = [_held(F.try_variant_get(found, f"$[{_quoted(key)}]", "variant"), value) for key, value in wanted.items()]
        return _all(kind.startswith("OBJECT"), *fields)
    if isinstance(wanted, list):
        elements = F.try_variant_get(found, "$", "array<variant>")
        # each wanted element is looked for on its own, whatever its depth
        return _all(kind.startswith("ARRAY"), *[_some(elements, w) for w in wanted])
    if wanted is None:
        return _all(F.is_variant_null(found))
    if isinstance(wanted, bool):
        return _all(kind == "BOOLEAN", F.try_variant_get(found, "$", "boolean") == wanted)
    if isinstance(wanted, (int, float)):
        number = kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
        return _all(number, F.try_variant_get(found, "$", "double") == float(wanted))
    return _all(kind == "STRING", F.try_variant_get(found, "$", "string") == wanted)


def _some(elements: Column, wanted) -> Column:
    return F.exists(elements, lambda element: _held(element, wanted))


def _all(*conditions: Column) -> Column:
    return F.coalesce(reduce(lambda a, b: a & b, conditions), F.lit(False))


def _quoted(key: str) -> str:
    return '"' + key.replace("\\", "\\\\").replace('"', '\\"') + '"'
