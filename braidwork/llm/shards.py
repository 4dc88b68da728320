"""Sharding through fixed virtual slots.

Records hash into thousands of slots; the bytes of each slot are summed; a
versioned table maps slots to shards. Rebalancing edits that table and moves
whole slots, so a record's slot never changes.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written

#: The number of slots is fixed for the life of a corpus; it bounds all that the driver holds.
SLOTS = 8192


@dataclass(frozen=True)
class SlotMap:
    """``shard[slot]`` for every slot, with the shard count and a version."""

    version: int
    shards: int
    shard: tuple[int, ...]

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(self.version, self.shards, s, x) for s, x in enumerate(self.shard)], "version int, shards int, vslot int, shard int")

    @staticmethod
    def read(table: DataFrame, version: int | None = None) -> SlotMap:
        """The newest version of a stored map, or the one asked for."""
        if version is None:
            version = table.agg(F.max("version")).first()[0]
        rows = sorted(table.where(F.col("version") == version).collect(), key=lambda r: r["vslot"])
        return SlotMap(version, rows[0]["shards"], tuple(r["shard"] for r in rows))


def slot_of(*cols: Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(slots)).cast("int")


def balanced(load: list[int], shards: int, version: int = 1) -> SlotMap:
    """A first map: slots from the heaviest, each to the lightest shard."""
    heap = [(0, s) for s in range(shards)]
    to = [0] * len(load)
    for slot in sorted(range(len(load)), key=lambda s: (-load[s], s)):
        if not load[slot]:  # spread what is empty so far evenly
            to[slot] = slot % shards
            continue
        held, shard = heapq.heappop(heap)
        to[slot] = shard
        heapq.heappush(heap, (held + load[slot], shard))
    return SlotMap(version, shards, tuple(to))


def rebalanced(old: SlotMap, load: list[int], tolerance: float = 0.02) -> SlotMap:
    """The next version: slots move from the fullest to the emptiest shard
    until none is ``tolerance`` above the mean or no move helps."""
    to, held = list(old.shard), [0] * old.shards
    own: list[list[int]] = [[] for _ in range(old.shards)]
    for slot, shard in enumerate(to):
        held[shard] += load[slot]
        own[shard].append(slot)
    mean = sum(load) / old.shards
    while max(held) > mean * (1 + tolerance):
        full, low = held.index(max(held)), held.index(min(held))
        gap = held[full] - held[low]
        slot = max((s for s in own[full] if 0 < load[s] < gap), key=lambda s: (min(load[s], gap - load[s]), -s), default=None)
        if slot is None:
            break
        own[full].remove(slot)
        own[low].append(slot)
        held[full] -= load[slot]
        held[low] += load[slot]
        to[slot] = low
    return SlotMap(old.version + 1, old.shards, tuple(to))


def grown(old: SlotMap, load: list[int]) -> SlotMap:
    """The next version with one more shard; slots move only into that one."""
    to, held = list(old.shard), [0] * old.shards
    own: list[list[int]] = [[] for _ in range(old.shards)]
    for slot, shard in enumerate(to):
        held[shard] += load[slot]
        own[shard].append(slot)
    mean, new = sum(load) / (old.shards + 1), 0
    for shard in sorted(range(old.shards), key=lambda s: -held[s]):
        for slot in sorted(own[shard], key=lambda s: (load[s], s), reverse=True):
            if load[slot] and held[shard] - load[slot] >= mean * 0.999 and new + load[slot] <= mean * 1.001:
                to[slot], held[shard], new = old.shards, held[shard] - load[slot], new + load[slot]
    return SlotMap(old.version + 1, old.shards + 1, tuple(to))


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """``docs`` with ``vslot``, ``size`` and ``text_crc32`` only, beside the id.

    A null text has no bytes, as an empty one. The slot hashes the id and the
    text's checksum, so rows without an id spread as well.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    out = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    return out.withColumn("vslot", slot_of(F.col("doc_id"), F.col("text_crc32"), slots=slots))


def slot_load(sizes: DataFrame, slots: int = SLOTS) -> tuple[list[int], list[int]]:
    """Bytes and rows of each slot: ``slots`` rows at most reach the driver."""
    load, rows = [0] * slots, [0] * slots
    for r in sizes.groupBy("vslot").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")).collect():
        load[r["vslot"]], rows[r["vslot"]] = int(r["b"]), int(r["n"])
    return load, rows


def shard_by_bytes(docs: DataFrame, shards: int = 40, slots: int = SLOTS) -> DataFrame:
    """One row a document: its shard and its place there (law ``bytes``).

    The slot map is written as version 1. ``slot`` counts a shard's rows from 0
    without gaps: the rows of the virtual slots before its own, then its place
    in its own slot. Repeated rows, null ids and null texts keep their rows; an
    empty table gives an empty result.
    """
    spark = docs.sparkSession
    sizes = written(sized(docs, slots=slots), "shard-sizes")
    load, rows = slot_load(sizes, slots)
    placed = balanced(load, shards)
    begin, first = [0] * shards, [0] * slots
    for s, shard in enumerate(placed.shard):
        first[s] = begin[shard]
        begin[shard] += rows[s]
    starts = spark.createDataFrame([(s, int(n)) for s, n in enumerate(first)], "vslot int, first long")
    stored = written(placed.frame(spark).join(F.broadcast(starts), "vslot").coalesce(1), "slot-map")
    within = Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size")
    return (
        sizes.withColumn("n", F.row_number().over(within))
        .join(F.broadcast(stored), "vslot")  # as many rows as there are slots
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + F.col("n") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.col("vslot").alias("virtual_slot"), F.col("version").alias("map_version"))
    )


def with_shard(docs: DataFrame, shards: int = 40, slots: int = SLOTS) -> DataFrame:
    """``docs`` with ``shard`` and ``virtual_slot`` added, without moving a text."""
    load, _ = slot_load(sized(docs, slots=slots), slots)
    placed = written(balanced(load, shards).frame(docs.sparkSession).coalesce(1), "slot-map").select(F.col("vslot").alias("virtual_slot"), "shard")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.drop("shard", "virtual_slot")
    keyed = docs.withColumn("virtual_slot", slot_of(F.col("doc_id"), F.crc32(F.encode(text, "UTF-8")), slots=slots))
    return keyed.join(F.broadcast(placed), "virtual_slot").select(*[F.col(f"`{c}`") for c in docs.columns], "shard", "virtual_slot")
