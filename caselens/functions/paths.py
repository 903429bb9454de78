"""Image references resolved to a path in the image archive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# The archive folder, the data set folder and the image file endings.
ARCHIVE = "archive/"
DATASET = "chest_xray_60/"
IMAGE_NAME = r"(?i)\.(?:jpe?g|png|gif|webp|bmp|svg)$"

# Characters URI component encoding leaves alone but form encoding does not.
BARE = {"+": "%20", "%21": "!", "%27": "'", "%28": "(", "%29": ")", "%7E": "~"}
# Schemes whose URLs have a host and a path of segments.
SLASH_SCHEMES = ("http", "https", "file", "ftp", "ws", "wss")



def _url_path(df: DataFrame, source: str) -> DataFrame:
    """Add ``_path``: the path of a URL, or of a reference relative to the site root,
    still percent-encoded."""
    bare = F.regexp_replace(source, r"\A[\x00-\x20]+|[\x00-\x20]+\z|[\t\r\n]", "")
    bare = F.regexp_replace(bare, r"[?#][\s\S]*\z", "")
    scheme = F.lower(F.regexp_extract("_bare", r"\A([A-Za-z][A-Za-z0-9+.\-]*):", 1))
    rest = F.regexp_replace("_bare", r"\A[A-Za-z][A-Za-z0-9+.\-]*:", "")
    # other schemes without a slash have no segments to resolve
    opaque = ~F.col("_scheme").isin("", *SLASH_SCHEMES) & ~F.col("_rest").startswith("/")
    slashed = F.replace("_rest", F.lit("\\"), F.lit("/"))
    return (
        df.withColumn("_bare", bare)
        .withColumns({"_scheme": scheme, "_rest": rest})
        .withColumn("_opaque", opaque)
        .withColumn("_path", F.regexp_replace(slashed, r"\A//[^/]*", ""))
        .withColumn(
            "_path",
            F.when(F.col("_opaque"), F.col("_rest"))
            .when(F.col("_path").startswith("/"), F.col("_path"))
            .otherwise(F.concat(F.lit("/"), "_path")),
        )
    )


def _without_dots(path: Column) -> Column:
    """``.`` and ``..`` segments resolved, the way URLs resolve them: a dot segment at the
    end leaves the closing slash."""
    items = F.transform(
        F.split(F.regexp_replace(path, r"(?i)/((?:\.|%2e){1,2})\z", "/$1/"), "/", -1),
        lambda s: F.struct(s.alias("raw"), F.regexp_replace(s, "(?i)%2e", ".").alias("dots")),
    )

    def step(kept: Column, item: Column) -> Column:
        return (
            F.when(item["dots"] == ".", kept)
            .when(item["dots"] == "..", F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(1))))
            .otherwise(F.concat(kept, F.array(item["raw"])))
        )

    return F.array_join(F.aggregate(items, F.array().cast("array<string>"), step), "/")


def encode_segment(segment: Column) -> Column:
    encoded = F.url_encode(segment)
    for form, bare in BARE.items():
        encoded = F.replace(encoded, F.lit(form), F.lit(bare))
    return encoded


def with_archive_path(df: DataFrame, source: str, name: str = "path") -> DataFrame:
    """Add ``archive/chest_xray_60/...`` with encoded segments, or NULL if ``source`` does
    not name an image of the data set.

    Every step is a column of its own, so that none is computed more than once.
    """
    escaped = F.replace("_path", F.lit("+"), F.lit("%2B"))
    steps = _url_path(df.withColumn("_source", F.col(source)), "_source")
    steps = steps.withColumn("_path", F.when(F.col("_opaque"), F.col("_path")).otherwise(_without_dots(F.col("_path"))))
    steps = steps.withColumn("_plain", F.try_url_decode(escaped))
    # an escape that is incomplete or not UTF-8 leaves the source as it is
    broken = F.col("_path").rlike("%(?![0-9A-Fa-f]{2})") | (
        F.contains("_plain", F.lit("�"))
        & ~F.contains("_path", F.lit("�"))
        & ~F.contains(F.upper("_path"), F.lit("%EF%BF%BD"))
    )
    chosen = F.when(broken | F.col("_plain").isNull(), F.col("_source")).otherwise(F.col("_plain"))
    steps = steps.withColumn("_path", F.replace(chosen, F.lit("\\"), F.lit("/")))
    # greedy prefixes end at the last occurrence
    steps = steps.withColumns(
        {
            "_archived": F.regexp_extract("_path", rf"(?is)\A.*/{ARCHIVE}(.*)\z", 1),
            "_has_archive": F.contains(F.lower("_path"), F.lit("/" + ARCHIVE)),
            "_in_dataset": F.regexp_extract("_path", rf"(?is)\A.*({DATASET}.*)\z", 1),
        }
    )
    inside = F.when(F.col("_has_archive"), F.col("_archived")).otherwise(F.col("_in_dataset"))
    steps = steps.withColumn("_inside", inside).withColumn("_segments", F.split("_inside", "/", -1))
    valid = (
        F.lower("_inside").startswith(DATASET)
        & ~F.exists("_segments", lambda s: s.isin("", ".", ".."))
        & F.element_at("_segments", -1).rlike(IMAGE_NAME)
    )
    encoded = F.array_join(F.transform("_segments", encode_segment), "/")
    return steps.select(*df.columns, F.when(valid, F.concat(F.lit(ARCHIVE), encoded)).alias(name))
