"""Links and image references in HTML or text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

# A quoted or bare attribute value.
_VALUE = r"""("[^"]*"|'[^']*'|[^\s"'>]+)"""
ANCHOR = rf"(?is)<a(?=\s)[^>]*?\shref\s*=\s*{_VALUE}[^>]*>(.*?)</a\s*>"
IMAGE = r"(?is)<img(?=\s)[^>]*>"
IMAGE_SOURCE = rf"(?is)\ssrc\s*=\s*{_VALUE}"
IMAGE_ALT = rf"(?is)\salt\s*=\s*{_VALUE}"
CODE = r"(?is)<code(?:\s[^>]*)?>(.*?)</code\s*>"
# Fixed value: a Markdown link or image that is the whole code text.
CODE_LINK = r"\A!?\[([^\]]*)\]\(\s*(?:<([^>]+)>|([^\s)]+))\s*\)\z"
# Fixed value: the label of an image without one.
DEFAULT_LABEL = "Hospital X-ray"

_ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#039;", "'"), ("&amp;", "&")]


def unescape(text: Column) -> Column:
    return reduce(lambda c, e: F.replace(c, F.lit(e[0]), F.lit(e[1])), _ENTITIES, text)


def _plain(html: Column) -> Column:
    return F.trim(unescape(F.regexp_replace(html, "<[^>]*>", "")), F.lit(" \t\r\n"))


def _attribute(value: Column) -> Column:
    return unescape(F.regexp_replace(value, r"""\A["']|["']\z""", ""))


def extract_links(df: DataFrame, html: str, keep: list[str]) -> DataFrame:
    """(kept columns, kind, source, label): one row per ``a[href]``, ``img[src]`` and code
    text. For code text that is a Markdown link, source and label come from the link."""

    def found(kind: str, pattern: str, source, label) -> Column:
        matches = F.regexp_extract_all(html, F.lit(pattern), F.lit(0))
        return F.transform(
            matches,
            lambda m: F.struct(F.lit(kind).alias("kind"), source(m).alias("source"), label(m).alias("label")),
        )

    def code_text(m: Column) -> Column:
        return _plain(F.regexp_extract(m, CODE, 1))

    def code_source(m: Column) -> Column:
        text = code_text(m)
        parts = [F.nullif(F.regexp_extract(text, CODE_LINK, i), F.lit("")) for i in (2, 3)]
        return F.coalesce(*parts, text)

    every = F.concat(
        found(
            "a",
            ANCHOR,
            lambda m: _attribute(F.regexp_extract(m, ANCHOR, 1)),
            lambda m: _plain(F.regexp_extract(m, ANCHOR, 2)),
        ),
        found(
            "img",
            IMAGE,
            lambda m: _attribute(F.regexp_extract(m, IMAGE_SOURCE, 1)),
            lambda m: _attribute(F.regexp_extract(m, IMAGE_ALT, 1)),
        ),
        found("code", CODE, code_source, lambda m: F.regexp_extract(code_text(m), CODE_LINK, 1)),
    )
    links = df.select(*keep, F.explode(every).alias("l")).select(*keep, "l.*")
    return links.where(F.col("source") != "").withColumn(
        "label", F.coalesce(F.nullif("label", F.lit("")), F.lit(DEFAULT_LABEL))
    )
