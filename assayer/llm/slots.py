"""Sharding over fixed virtual slots.

Every record hashes into one of a fixed number of virtual slots, for ever. Bytes
and rows are summed per slot, and a small versioned table maps slots to shards.
Rebalancing never touches records: it edits the map and stores the result as
the next version, so a reader knows which map placed a row.

Only numbers are shuffled (id, size, checksum); texts stay in the scan. What
reaches the driver is one row per virtual slot, a number fixed beforehand.

Defined cases: a null text has 0 bytes and checksum 0; a null ``doc_id`` is an
ordinary record that hashes by its checksum; repeated rows are separate records
with separate places; an empty table gives an empty result; further columns
are ignored.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from assayer.llm.common import settle, shared_dir

#: Fixed for the life of a store: a record's slot never changes.
VIRTUAL_SLOTS = 8192
ROW_OVERHEAD = 8


def records(docs: DataFrame, virtual_slots: int = VIRTUAL_SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, virtual_slot) of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    sized = docs.select(
        "doc_id",
        (F.octet_length(text) + ROW_OVERHEAD).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
    )
    slot = F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(virtual_slots)).cast("int")
    return sized.withColumn("virtual_slot", slot)


def slot_loads(rows: DataFrame) -> DataFrame:
    """Bytes and rows per virtual slot; at most one row for each slot."""
    return rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))


@dataclass
class SlotMap:
    """One version of the slot-to-shard map."""

    version: int
    shards: int
    shard_of: list[int]

    @classmethod
    def balanced(cls, loads: list[int], shards: int) -> SlotMap:
        """First version: the heaviest slot goes to the shard that has least so far."""
        heap = [(0, shard) for shard in range(shards)]
        shard_of = [0] * len(loads)
        for slot in sorted(range(len(loads)), key=lambda s: (-loads[s], s)):
            load, shard = heapq.heappop(heap)
            shard_of[slot] = shard
            # An empty slot still takes its turn, so that later rows spread as well.
            heapq.heappush(heap, (load + max(loads[slot], 1), shard))
        return cls(1, shards, shard_of)

    def rebalanced(self, loads: list[int], tolerance: float = 0.01, shards: int | None = None) -> SlotMap:
        """Next version: the fewest slots that level the loads move, all others stay.

        With more ``shards`` the new ones start empty, and slots only move into them.
        """
        count = shards or self.shards
        if count < self.shards:
            raise ValueError("drain shards by moving their slots first; a map only grows")
        shard_of = list(self.shard_of)
        held: list[set[int]] = [set() for _ in range(count)]
        total = [0] * count
        for slot, shard in enumerate(shard_of):
            held[shard].add(slot)
            total[shard] += loads[slot]
        takers = range(self.shards, count) if count > self.shards else range(count)
        target = sum(total) / count
        for _ in range(len(loads)):
            low = min(takers, key=lambda s: total[s])
            high = max((s for s in range(count) if count == self.shards or s < self.shards), key=lambda s: total[s])
            gap = min((total[high] - total[low]) / 2, target - total[low] + tolerance * target)
            movable = [s for s in held[high] if 0 < loads[s] <= gap]
            if not movable or total[high] - total[low] <= tolerance * target:
                break
            slot = max(movable, key=lambda s: (loads[s], -s))
            held[high].remove(slot)
            held[low].add(slot)
            total[high] -= loads[slot]
            total[low] += loads[slot]
            shard_of[slot] = low
        return SlotMap(self.version + 1, count, shard_of)

    def frame(self, spark: SparkSession, rows_of: list[int]) -> DataFrame:
        """(version, virtual_slot, shard, start): ``start`` rows of the shard lie in earlier slots."""
        seen = [0] * self.shards
        start = []
        for slot, shard in enumerate(self.shard_of):
            start.append(seen[shard])
            seen[shard] += rows_of[slot]
        values = lambda numbers: F.split(F.lit(",".join(map(str, numbers))), ",")
        return spark.range(len(self.shard_of), numPartitions=1).select(
            F.lit(self.version).alias("version"),
            F.col("id").cast("int").alias("virtual_slot"),
            F.get(values(self.shard_of), F.col("id").cast("int")).cast("int").alias("shard"),
            F.get(values(start), F.col("id").cast("int")).cast("long").alias("start"),
        )


def save(spark: SparkSession, slot_map: SlotMap, rows_of: list[int], path: str) -> None:
    """Add a version to the stored maps; earlier versions stay readable."""
    slot_map.frame(spark, rows_of).write.mode("append").parquet(path)


def load(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A stored version of the map, the newest by default."""
    maps = spark.read.parquet(path)
    if version is None:
        version = maps.agg(F.max("version")).first()[0]
    return maps.where(F.col("version") == version)


def place(rows: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Shard and gapless place in the shard of every record.

    Numbering runs inside a virtual slot, so no task sees a whole shard; the map
    brings the number of rows that lie before the slot. It has one row per
    virtual slot, which bounds the broadcast.
    """
    inside = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size"))
    numbered = rows.withColumn("inside", inside)
    return numbered.join(F.broadcast(slot_map), "virtual_slot").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("inside") - 1).cast("long").alias("slot"),
        "virtual_slot", F.col("version").alias("map_version"),
    )


def shard(docs: DataFrame, shards: int, virtual_slots: int = VIRTUAL_SLOTS, path: str | None = None) -> DataFrame:
    """Spread documents over shards of near equal bytes; the map is stored at ``path``."""
    spark = docs.sparkSession
    rows = settle(records(docs, virtual_slots), "slot-records")
    loads, counts = [0] * virtual_slots, [0] * virtual_slots
    for row in slot_loads(rows).collect():  # at most virtual_slots rows
        loads[row.virtual_slot], counts[row.virtual_slot] = row.bytes, row.rows
    path = path or shared_dir(spark, "slot-map")
    save(spark, SlotMap.balanced(loads, shards), counts, path)
    return place(rows, load(spark, path))
