"""Sharding by fixed virtual slots.

Every record hashes into one of ``SLOTS`` virtual slots, whatever the number of shards. One
aggregate gives rows and bytes per slot; that is at most ``SLOTS`` rows, and all the driver
ever sees. A slot-to-shard map assigns slots to shards. It is stored in versions: version 1
gives each shard a run of slots, and rebalancing appends a version that moves only as many
slots as it takes to even out the bytes. Records are placed by a join with the map, which is
broadcast: it has ``SLOTS`` rows at any size of the input.

Defined results: a null text has no bytes; null ids hash with their text's checksum, as all
records do, so they spread as well; rows that repeat both id and text share a slot and take
consecutive places in their shard; an empty table gives an empty result and an even map;
columns beside the two named are not read.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from caselens.scratch import scratch_path, write_and_reread

SLOTS = 8192
ROW_BYTES = 16
MAP = "version int, virtual_slot int, shard int, bytes bigint, first_place bigint"


def into_slots(docs: DataFrame, slots: int = SLOTS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id``, ``size``, ``text_crc32``, ``virtual_slot`` of every record."""
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    sized = docs.select(
        F.col(id_column).alias("doc_id"),
        (F.octet_length(text) + ROW_BYTES).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    slot = F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(slots)).cast("int")
    return sized.withColumn("virtual_slot", slot)


def slot_totals(slotted: DataFrame, slots: int = SLOTS) -> tuple[list[int], list[int]]:
    """Bytes and rows per slot."""
    size, rows = [0] * slots, [0] * slots
    for r in slotted.groupBy("virtual_slot").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")).collect():
        size[r["virtual_slot"]], rows[r["virtual_slot"]] = r["b"], r["n"]
    return size, rows


def even_map(slots: int, shards: int) -> list[int]:
    """The first version: runs of slots."""
    return [slot * shards // slots for slot in range(slots)]


def rebalanced(current: list[int], size: list[int], shards: int) -> list[int]:
    """``current`` edited so that the shards hold nearly the same bytes.

    Shards above the mean give up slots that fit into their excess, largest first; these go
    to the lightest shards; then single moves and exchanges between the heaviest and the
    lightest shard follow for as long as they bring the two closer."""
    edited = list(current)
    held: list[list[tuple[int, int]]] = [[] for _ in range(shards)]
    for slot, shard in enumerate(edited):
        held[shard].append((size[slot], slot))
    load = [sum(b for b, _ in own) for own in held]
    mean = sum(load) / shards
    loose = []
    for shard, own in enumerate(held):
        own.sort()
        kept = []
        for b, slot in reversed(own):
            if b and load[shard] - b >= mean:
                loose.append((b, slot))
                load[shard] -= b
            else:
                kept.append((b, slot))
        held[shard] = kept[::-1]
    lightest = [(b, shard) for shard, b in enumerate(load)]
    heapq.heapify(lightest)
    for b, slot in sorted(loose, reverse=True):
        total, shard = heapq.heappop(lightest)
        edited[slot] = shard
        held[shard].append((b, slot))
        load[shard] = total + b
        heapq.heappush(lightest, (load[shard], shard))
    for own in held:
        own.sort()
    while True:
        high, low = max(range(shards), key=load.__getitem__), min(range(shards), key=load.__getitem__)
        gap, best = load[high] - load[low], None
        low_sizes = [(0, -1), *held[low]]
        for b, slot in held[high]:  # moved alone (against 0) or exchanged
            near = bisect_left(low_sizes, (b - gap / 2, -1))
            for other in low_sizes[max(0, near - 1) : near + 1]:
                shift = b - other[0]
                if 0 < shift < gap and (best is None or abs(gap - 2 * shift) < best[0]):
                    best = (abs(gap - 2 * shift), (b, slot), other)
        if best is None or best[0] > gap - max(1, gap // 100):
            return edited
        _, mine, other = best
        held[high].remove(mine)
        held[low].append(mine)
        edited[mine[1]] = low
        if other[1] >= 0:
            held[low].remove(other)
            held[high].append(other)
            edited[other[1]] = high
        held[high].sort()
        held[low].sort()
        load[high], load[low] = load[high] - mine[0] + other[0], load[low] + mine[0] - other[0]


def store_map(spark: SparkSession, path: str, version: int, shards_of: list[int], size: list[int], rows: list[int]) -> None:
    """Write one version; running it again replaces the version. ``first_place`` is the place
    of a slot's first record within its shard."""
    placed: dict[int, int] = {}
    table = []
    for slot, shard in enumerate(shards_of):
        table.append((version, slot, shard, size[slot], placed.get(shard, 0)))
        placed[shard] = placed.get(shard, 0) + rows[slot]
    spark.createDataFrame(table, MAP).coalesce(1).write.mode("overwrite").parquet(f"{path}/version={version}")


def load_map(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.schema(MAP).parquet(f"{path}/version={version}")


def place(slotted: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Adds ``shard`` and ``slot``, the record's place in its shard."""
    own = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    numbered = slotted.withColumn("_n", F.row_number().over(own))
    placed = numbered.join(F.broadcast(slot_map.select("virtual_slot", "shard", "first_place")), "virtual_slot")
    return placed.withColumn("slot", F.col("first_place") + F.col("_n") - 1).drop("_n", "first_place")


def shard(docs: DataFrame, shards: int, slots: int = SLOTS, path: str | None = None) -> DataFrame:
    """All records with their shard under a rebalanced map; the map's versions are in ``path``."""
    spark = docs.sparkSession
    path = path or scratch_path(spark, "slot-map")
    slotted = write_and_reread(into_slots(docs, slots), "slotted")
    size, rows = slot_totals(slotted, slots)
    first = even_map(slots, shards)
    store_map(spark, path, 1, first, size, rows)
    store_map(spark, path, 2, rebalanced(first, size, shards), size, rows)
    return place(slotted, load_map(spark, path, 2))
