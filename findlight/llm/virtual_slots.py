"""Shards over fixed virtual slots: records are hashed into slots, and a versioned map says which shard each slot is in."""

from __future__ import annotations

import heapq
import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_dir, table

#: The number of slots never changes; the map has one entry for each, so it is bounded whatever the input.
SLOTS = 8192


@dataclass(frozen=True)
class SlotMap:
    """A version of the slot-to-shard map: ``shard_of[slot]``."""

    version: int
    shards: int
    shard_of: tuple[int, ...]

    def save(self, spark: SparkSession, path: str) -> None:
        """Writes this version beside the earlier ones; a version that is there already raises."""
        rows = spark.range(len(self.shard_of), numPartitions=1).select(F.col("id").cast("int").alias("slot"), F.get(_constant(self.shard_of, "int"), F.col("id").cast("int")).alias("shard"), F.lit(self.shards).alias("shards"))
        rows.write.mode("error").parquet(f"{path}/version={self.version:08d}")

    @staticmethod
    def load(spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
        """The version asked for, or the latest."""
        rows = spark.read.parquet(path).withColumn("version", F.col("version").cast("int"))
        at = rows.agg(F.max("version")).first()[0] if version is None else version
        got = sorted(rows.filter(F.col("version") == at).select("slot", "shard", "shards").collect())
        return SlotMap(at, got[0][2], tuple(r[1] for r in got))


def _constant(numbers: list[int] | tuple[int, ...], kind: str) -> Column:
    """A constant array, as one literal."""
    return F.split(F.lit(",".join(map(str, numbers))), ",").cast(f"array<{kind}>")


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The slot that a key is in for good; null keys share one."""
    return F.pmod(F.xxhash64(key), F.lit(slots)).cast("int")


def slot_sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> list[tuple[int, int, int]]:
    """``(slot, rows, bytes)`` of the slots that have rows: pre-aggregated where the rows lie, ``slots`` rows at most."""
    sized = docs.select(slot_of(F.col(id_col), slots).alias("slot"), record_size(F.col(text_col)).alias("size"))
    return [tuple(r) for r in sized.groupBy("slot").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).collect()]


def record_size(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) and one for its end."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def build(sizes: list[tuple[int, int, int]], shards: int, slots: int = SLOTS) -> SlotMap:
    """The first version: largest slots first, each to the shard with the fewest bytes so far (ties: the lower number)."""
    weight = {slot: size for slot, _, size in sizes}
    heap = [(0, s) for s in range(shards)]
    out = [0] * slots
    for slot in sorted(range(slots), key=lambda s: (-weight.get(s, 0), s)):
        load, shard = heapq.heappop(heap)
        out[slot] = shard
        heapq.heappush(heap, (load + weight.get(slot, 0), shard))
    return SlotMap(1, shards, tuple(out))


def rebalance(old: SlotMap, sizes: list[tuple[int, int, int]], shards: int | None = None) -> SlotMap:
    """The next version, with ``shards`` shards: slots leave closed shards and the fullest ones for the emptiest until no move evens them out; other slots stay."""
    shards = shards or old.shards
    weight = [0] * len(old.shard_of)
    for slot, _, size in sizes:
        weight[slot] = size
    out, load, held = list(old.shard_of), [0] * shards, [[] for _ in range(shards)]
    loose = []
    for slot, shard in enumerate(out):
        if shard < shards:
            load[shard] += weight[slot]
            held[shard].append(slot)
        else:
            loose.append(slot)
    for slot in sorted(loose, key=lambda s: (-weight[s], s)):
        to = min(range(shards), key=lambda s: (load[s], s))
        out[slot] = to
        load[to] += weight[slot]
        held[to].append(slot)
    for part in held:
        part.sort(key=lambda s: (weight[s], s))
    while True:
        full, spare = max(range(shards), key=lambda s: (load[s], -s)), min(range(shards), key=lambda s: (load[s], s))
        gap = load[full] - load[spare]
        fits = next((s for s in reversed(held[full]) if 0 < weight[s] < gap), None)
        if fits is None or gap <= 1:
            return SlotMap(old.version + 1, shards, tuple(out))
        held[full].remove(fits)
        held[spare].append(fits)
        held[spare].sort(key=lambda s: (weight[s], s))
        out[fits] = spare
        load[full] -= weight[fits]
        load[spare] += weight[fits]


def place(docs: DataFrame, slot_map: SlotMap, id_col: str = "doc_id") -> DataFrame:
    """``docs`` with ``virtual_slot`` and ``shard``; the map is a constant of one entry a slot, so no join is needed."""
    slot = slot_of(F.col(id_col), len(slot_map.shard_of))
    return docs.withColumns({"virtual_slot": slot, "shard": F.get(_constant(slot_map.shard_of, "int"), slot)})


def sharded(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS, slot_map: SlotMap | None = None) -> DataFrame:
    """One row for each of ``docs``: doc_id, size, text_crc32, shard, virtual_slot, and slot, its place in the shard from 0 without gaps.

    Sizes of shards are near equal: slots are dealt by their bytes (law ``bytes``), and a slot is small beside a
    shard because ids, not sources or texts, decide the slot. That takes ids that are nearly unique: rows that repeat
    an id share a slot, with places of their own, and a slot is never parted, so an id that a good part of all rows
    had would make its shard that much larger. A null text has size 1 and checksum 0; a null id has a slot like any
    id. An empty table gives no rows. Other columns of ``docs`` don't matter.
    """
    sizes = slot_sizes(docs, id_col, text_col, len(slot_map.shard_of) if slot_map else slots)
    slot_map = slot_map or build(sizes, shards, slots)
    rows, before, base = {slot: n for slot, n, _ in sizes}, [0] * slot_map.shards, []
    for slot, shard in enumerate(slot_map.shard_of):
        base.append(before[shard])
        before[shard] += rows.get(slot, 0)
    slim = docs.select(F.col(id_col).alias("doc_id"), record_size(F.col(text_col)).alias("size"), F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("text_crc32"))
    placed = place(slim, slot_map, "doc_id")
    within = Window.partitionBy("virtual_slot").orderBy("doc_id", "size", "text_crc32")
    return placed.withColumn("slot", F.get(_constant(base, "bigint"), F.col("virtual_slot")) + F.row_number().over(within) - 1)


def stored(docs: DataFrame, path: str, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> SlotMap:
    """The latest map below ``path``; where there is none, the first one is built and saved, and where it has another number of shards, an edited one."""
    spark = docs.sparkSession
    try:
        latest = SlotMap.load(spark, path)
    except AnalysisException:  # nothing there yet
        build(slot_sizes(docs, id_col, text_col, slots), shards, slots).save(spark, path)
        return SlotMap.load(spark, path)
    if latest.shards != shards:
        rebalance(latest, slot_sizes(docs, id_col, text_col, len(latest.shard_of)), shards).save(spark, path)
        return SlotMap.load(spark, path)
    return latest


def op10_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    made = sharded(docs, slot_map=stored(docs, f"{shared_dir(spark)}/slots-{uuid.uuid4().hex}", 8))
    return made.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")
