"""The keys a table holds, with a filter that answers for most new ones.

Keys are rows of an upsert table, so a look at some of them reads their buckets only. Beside it is
a Bloom filter in blocks of 32,768 bits, a row per block: a key's hash chooses the block and four
bits in it. Adding keys merges bitmaps of the blocks they fall in. A key with a bit that is not
set is not in the table, whatever its size; only the others are looked up exactly. When
more than ``FULL`` of the bits are set the filter is built anew with four times the blocks.

The filter is written before the keys: a batch that fails in between leaves bits too many, never
too few.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from caselens.operators.skew import fits_broadcast
from caselens.scratch import finished_numbers, remove, write_and_reread, write_text
from caselens.sources.upserts import Manifest, UpsertTable

BLOCK_BITS = 32_768  # of a bitmap of Spark's
BLOCKS = 1024
FULL = 0.4
_FILTER = T.StructType().add("block", "integer").add("bits", "binary")


@dataclass(frozen=True)
class KeyStore:
    path: str
    key: T.StructType
    blocks: int = BLOCKS
    buckets: int = 16
    compact_after: int = 8
    check_every: int = 8  # additions after which it is seen whether the filter is full

    @property
    def table(self) -> UpsertTable:
        return UpsertTable(f"{self.path}/keys", self.key, self.key.names, {}, self.buckets, self.compact_after)

    def last(self, spark: SparkSession) -> Manifest:
        return self.table.last(spark)

    def _filter(self, blocks: int) -> UpsertTable:
        return UpsertTable(f"{self.path}/filter/blocks={blocks}", _FILTER, ["block"], {"bits": "bitmap_or_agg"}, 4, self.compact_after)

    def _blocks(self, spark: SparkSession) -> int:
        """The blocks of the filter in use: the largest that was finished."""
        return max(finished_numbers(spark, f"{self.path}/filter", "blocks"), default=self.blocks)

    def _places(self, blocks: int) -> tuple[Column, list[Column]]:
        """The block of a key and its bits there."""
        bits = F.xxhash64(F.lit("bits"), *self.key.names)
        places = [F.shiftrightunsigned(bits, 15 * i).bitwiseAND(F.lit(BLOCK_BITS - 1)) for i in range(4)]
        return F.pmod(F.xxhash64(*self.key.names), F.lit(blocks)).cast("int"), places

    def _bitmaps(self, keys: DataFrame, blocks: int) -> DataFrame:
        block, places = self._places(blocks)
        bits = keys.select(block.alias("block"), F.explode(F.array(*places)).alias("bit"))
        return bits.groupBy("block").agg(F.expr("bitmap_construct_agg(bit)").alias("bits"))

    def add(self, keys: DataFrame, tag: str) -> None:
        """Add ``keys``, a stored table. Adding what is there already does no harm."""
        spark = keys.sparkSession
        if self.last(spark).tag == tag:
            return
        blocks = self._blocks(spark)
        self._filter(blocks).upsert(self._bitmaps(keys, blocks), tag)
        self._finish(spark, blocks)
        self.table.upsert(keys.select(*self.key.names), tag)
        if self.last(spark).version % self.check_every == 0 and self.density(spark) > FULL:
            self._grow(spark, blocks)

    def _finish(self, spark: SparkSession, blocks: int) -> None:
        folder = f"{self.path}/filter/blocks={blocks}"
        if blocks not in finished_numbers(spark, f"{self.path}/filter", "blocks"):
            write_text(spark, f"{folder}/_SUCCESS", "")

    def density(self, spark: SparkSession) -> float:
        """The share of bits that are set."""
        blocks = self._blocks(spark)
        found = self._filter(blocks).read(spark).agg(F.sum(F.expr("bitmap_count(bits)"))).first()[0]
        return (found or 0) / (blocks * BLOCK_BITS)

    def _grow(self, spark: SparkSession, blocks: int) -> None:
        """The filter of all keys with more blocks. Each key is read again after the table has
        grown about fourfold."""
        more = 4 * blocks
        self._filter(more).upsert(self._bitmaps(self.table.stored(spark), more), "grown")
        self._finish(spark, more)
        remove(spark, f"{self.path}/filter/blocks={blocks}")

    def maybe(self, asked: DataFrame) -> DataFrame:
        """Those of the keys that the filter does not rule out, stored."""
        spark = asked.sparkSession
        blocks = self._blocks(spark)
        block, places = self._places(blocks)
        known = asked.select(*self.key.names).dropna(how="any")
        tested = known.withColumns({"_block": block, "_places": F.array(*places)})
        filters = self._filter(blocks).read(spark)

        def is_set(place: Column) -> Column:
            byte = F.substring(F.col("bits"), (F.floor(place / 8) + 1).cast("int"), F.lit(1))
            return F.getbit(F.conv(F.hex(byte), 16, 10).cast("int"), (place % 8).cast("int")) == 1

        joined = tested.join(filters, F.col("_block") == F.col("block")).where(F.forall("_places", is_set))
        return write_and_reread(joined.select(*self.key.names), "maybe-held")

    def held(self, asked: DataFrame) -> DataFrame | None:
        """Those of the keys that the table holds, or None if no key file has to be read to know
        that there are none. A key with a NULL is never held."""
        spark = asked.sparkSession
        if self.last(spark).version < 0:
            return None
        maybe = self.maybe(asked)
        buckets = [r[0] for r in maybe.select(self.table.bucket().alias("b")).distinct().collect()]  # no more than there are
        if not buckets:
            return None
        side = F.broadcast(maybe) if fits_broadcast(maybe) else maybe
        return self.table.stored(spark, buckets).join(side, self.key.names, "left_semi").distinct()
