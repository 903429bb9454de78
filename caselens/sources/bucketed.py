"""Tables whose rows lie in buckets of a key, so joins and counts by it move nothing.

Tables that are appended with the same number of buckets of keys of the same type are
dealt alike. A join on these keys, a count per key and a check of references read both sides
bucket by bucket, without an exchange. The dealing is paid once, when rows are appended. Use
it for keys without a hot value: a bucket is read by one task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, types as T

BUCKETS = 64
BUCKET_ROWS = 1 << 20  # a task sorts a bucket of each side


def buckets_for(rows: DataFrame, least: int = 1) -> int:
    """Buckets for tables the larger of which has these rows, so that no bucket grows with them."""
    return max(least, -(-rows.count() // BUCKET_ROWS))


@dataclass(frozen=True)
class BucketedTable:
    """A table in the session's catalog under ``name``, stored at ``path``."""

    name: str
    path: str
    schema: T.StructType
    key: str
    buckets: int = BUCKETS

    def append(self, rows: DataFrame) -> None:
        """Append rows in the table's types. Each bucket is written by one task, as one sorted file."""
        typed = rows.select(*[rows[f.name].cast(f.dataType).alias(f.name) for f in self.schema.fields])
        self.open(rows.sparkSession)
        dealt = typed.repartition(self.buckets, self.key).sortWithinPartitions(self.key)
        writer = dealt.write.format("parquet").bucketBy(self.buckets, self.key).sortBy(self.key)
        writer.mode("append").saveAsTable(self.name)

    def open(self, spark: SparkSession) -> DataFrame:
        """The table; a session that does not know it yet learns where it is and how it is dealt."""
        if not spark.catalog.tableExists(self.name):
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.schema.fields)
            path = self.path.replace("'", "\\'")
            spark.sql(
                f"CREATE TABLE `{self.name}` ({columns}) USING parquet CLUSTERED BY (`{self.key}`) "
                f"SORTED BY (`{self.key}`) INTO {self.buckets} BUCKETS LOCATION '{path}'"
            )
        return spark.table(self.name)
