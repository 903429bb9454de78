"""A table of merged rows by key, written by the batches of a stream.

Keys are dealt to buckets by hash. A batch writes one merged row per key it has, below the folders
of the buckets it touches, and then a manifest: which folders hold each bucket now. A
reader merges the folders of the last manifest. A bucket with more than ``compact_after`` folders
is merged into one; other buckets are left alone, so what a batch writes follows the batch and
not the table. A clear is a manifest without what was there before. Folders are removed when
neither the last manifest nor the one before it names them.

A manifest carries the tag of its batch. A batch that runs again after its manifest was written
changes nothing, one that runs again before replaces what it had written. One stream at a
time may write to a table.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from caselens.scratch import finished_numbers, numbers, read_text, remove, write_text

BUCKETS = 64
COMPACT_AFTER = 8
Part = tuple[str, int, int]  # kind, version, bucket


@dataclass(frozen=True)
class Manifest:
    version: int = -1
    tag: str = ""
    parts: list[Part] = field(default_factory=list)

    def of(self, bucket: int) -> list[Part]:
        return [p for p in self.parts if p[2] == bucket]


@dataclass(frozen=True)
class UpsertTable:
    """``merge`` names the aggregate function of each column beside the key; it has to give the
    same result in whatever groups rows are merged (max, min, sum, bitmap_or_agg, ...)."""

    path: str
    schema: T.StructType
    key: list[str]
    merge: dict[str, str]
    buckets: int = BUCKETS
    compact_after: int = COMPACT_AFTER

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def merged(self, rows: DataFrame) -> DataFrame:
        grouped = rows.groupBy(*self.key)
        if not self.merge:
            return rows.select(*self.key).distinct()
        return grouped.agg(*[F.expr(f"{name}(`{column}`)").alias(column) for column, name in self.merge.items()])

    def _manifest(self, spark: SparkSession, version: int) -> Manifest:
        told = json.loads(read_text(spark, f"{self.path}/manifest={version}/_SUCCESS"))
        return Manifest(version, told["tag"], [tuple(p) for p in told["parts"]])

    def last(self, spark: SparkSession) -> Manifest:
        versions = finished_numbers(spark, self.path, "manifest")
        return self._manifest(spark, versions[-1]) if versions else Manifest()

    def _read(self, spark: SparkSession, parts: list[Part]) -> DataFrame:
        stored = T.StructType(list(self.schema.fields)).add("kind", "string").add("version", "integer").add("bucket", "integer")
        if not parts:
            return spark.createDataFrame([], self.schema)
        paths = [f"{self.path}/kind={k}/version={v}/bucket={b}" for k, v, b in parts]
        return spark.read.schema(stored).option("basePath", self.path).parquet(*paths).drop("kind", "version")

    def _write(self, rows: DataFrame, kind: str, version: int) -> None:
        placed = rows.select(*self.schema.names, self.bucket().alias("bucket"))
        path = f"{self.path}/kind={kind}/version={version}"
        placed.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)

    def stored(self, spark: SparkSession, buckets: list[int] | None = None) -> DataFrame:
        """Rows as they were written, of the given buckets or of all: a key may have several."""
        parts = [p for p in self.last(spark).parts if buckets is None or p[2] in buckets]
        return self._read(spark, parts).select(*self.schema.names)

    def read(self, spark: SparkSession, buckets: list[int] | None = None) -> DataFrame:
        """One row per key, of the given buckets or of all."""
        return self.merged(self.stored(spark, buckets)).select(*self.schema.names)

    def upsert(self, rows: DataFrame, tag: str, cleared: bool = False) -> None:
        """Merge ``rows`` into the table; ``cleared`` deletes all that was there before."""
        spark = rows.sparkSession
        before = self.last(spark)
        if before.tag == tag:
            return
        version = before.version + 1
        self._write(self.merged(rows), "delta", version)
        touched = numbers(spark, f"{self.path}/kind=delta/version={version}", "bucket")
        parts = [] if cleared else list(before.parts)
        parts += [("delta", version, b) for b in touched]
        now = Manifest(version, tag, parts)
        due = [b for b in touched if len(now.of(b)) > self.compact_after]
        if due:
            self._write(self.merged(self._read(spark, [p for b in due for p in now.of(b)])), "base", version)
            now = Manifest(version, tag, [p for p in parts if p[2] not in due] + [("base", version, b) for b in due])
        # buckets x (compact_after + 1) parts at most
        write_text(spark, f"{self.path}/manifest={version}/_SUCCESS", json.dumps({"tag": tag, "parts": now.parts}))
        self._forget(spark, now, before)

    def _forget(self, spark: SparkSession, now: Manifest, before: Manifest) -> None:
        if before.version < 1:
            return
        older = self._manifest(spark, before.version - 1)
        needed = {*now.parts, *before.parts}
        for kind, version, bucket in {*older.parts, *[("delta", before.version, b) for b in range(self.buckets)]} - needed:
            remove(spark, f"{self.path}/kind={kind}/version={version}/bucket={bucket}")
        for kind, version in {p[:2] for p in older.parts} - {p[:2] for p in needed}:
            remove(spark, f"{self.path}/kind={kind}/version={version}")
        remove(spark, f"{self.path}/manifest={before.version - 1}")
