"""Helper structures: a Bloom filter, shards of ids, positions of keys, and bitmaps of words."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Words of 63 bits in a block of a Bloom filter (8 KB): a key's bits all lie in one block, so a look-up meets one row.
BLOCK_WORDS = 1024
#: Bits of a filter up to which its blocks are broadcast (64 MB). Those of a larger one are joined by a shuffle.
BROADCAST_BITS = 1 << 29


class Bloom:
    """A filter of ``bits`` bits and ``hashes`` hashes, built by one aggregation; no false negatives.

    Its blocks stay a table, a row each, which the driver doesn't see. Its size is chosen by its maker, not by the
    rows: 10 bits an item for one false positive in a hundred.
    """

    def __init__(self, bits: int = 1024, hashes: int = 3, table: DataFrame | None = None):
        self.bits, self.hashes, self.table = bits, hashes, table
        self.blocks = -(-bits // (63 * BLOCK_WORDS))
        self.words = BLOCK_WORDS if self.blocks > 1 else -(-bits // 63)

    @staticmethod
    def sized(items: int, false_positives: float = 0.01) -> Bloom:
        bits = max(64, math.ceil(-items * math.log(false_positives) / math.log(2) ** 2))
        return Bloom(bits, max(1, round(bits / max(1, items) * math.log(2))))

    def _block(self, c: Column) -> Column:
        return F.pmod(F.xxhash64(F.lit("block"), c), F.lit(self.blocks).cast("long"))

    def _places(self, c: Column) -> Column:
        """A key's bits within its block. Each has a hash of its own: sums of two hashes repeat too soon in a block, and overflow."""
        return F.array(*[F.pmod(F.xxhash64(F.lit(k), c), F.lit(63 * self.words).cast("long")) for k in range(self.hashes)])

    def of(self, df: DataFrame, column: str) -> Bloom:
        """With a column's values in it; nulls aren't."""
        c = F.col(column)
        places = df.filter(c.isNotNull()).select(self._block(c).alias("k"), F.explode_outer(self._places(c)).alias("p"))
        set_bits = places.groupBy((F.col("k") * self.words + F.expr("p div 63")).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(p % 63 AS INT))")).alias("b"))
        every = df.sparkSession.range(self.blocks * self.words).select(F.col("id").alias("w"), F.lit(0).cast("long").alias("b"))
        whole = set_bits.unionByName(every).groupBy("w").agg(F.bit_or("b").alias("b"))
        blocks = whole.groupBy(F.expr(f"w div {self.words}").alias("_block")).agg(F.transform(F.array_sort(F.collect_list(F.struct("w", "b"))), lambda x: x["b"]).alias("_bloom"))
        return Bloom(self.bits, self.hashes, blocks)

    def keep(self, df: DataFrame, column: str) -> DataFrame:
        """The rows of ``df`` whose value may be in the filter: all that are, and few others."""
        bit = lambda p: F.get("_bloom", F.floor(p / 63).cast("int")).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(p, F.lit(63)).cast("int"))) != 0
        c = df[column]
        table = F.broadcast(self.table) if self.bits <= BROADCAST_BITS else self.table
        return df.join(table, c.isNotNull() & (self._block(c) == F.col("_block")) & F.forall(self._places(c), bit)).drop("_block", "_bloom")


def stable_shard(id: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(id), F.lit(n)).cast("int")


def positions(keys: DataFrame, column: str, order: str) -> DataFrame:
    """``(key, position)`` from 0 in ``order``: the place within a range of the order, and the rows of the ranges before.

    The ranges are drawn from a sample, so they are written once, to the shared folder, before they are counted.
    """
    from pyspark.sql import Window

    from ..sources.store import scratch

    spark, path = keys.sparkSession, scratch(keys.sparkSession)
    ranged = keys.select(F.col(column).alias("key"), F.col(order).alias("_o")).repartitionByRange("_o")
    ranged.withColumn("_part", F.spark_partition_id()).write.parquet(path)
    parts = spark.read.parquet(path)
    counts = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.select(F.col("_part").alias("_p"), (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # a row for each range
    placed = parts.withColumn("_in", F.row_number().over(Window.partitionBy("_part").orderBy("_o")))
    return placed.join(F.broadcast(before), F.col("_part") == F.col("_p")).select("key", (F.col("_before") + F.col("_in") - 1).cast("long").alias("position"))


def bitmap_of(df: DataFrame, id_col: str) -> DataFrame:
    """Ids (0 and up) as bitmaps: ``(bucket, bitmap)``; and / or of them by ``bitmap_and`` and ``bitmap_or``."""
    return df.groupBy(F.bitmap_bucket_number(F.col(id_col)).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col(id_col))).alias("bitmap"))


def bitmap_or(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).groupBy("bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))


def bitmap_and(a: DataFrame, b: DataFrame) -> DataFrame:
    both = a.join(b.select("bucket"), "bucket", "left_semi").unionByName(b.join(a.select("bucket"), "bucket", "left_semi"))
    return both.groupBy("bucket").agg(F.expr("bitmap_and_agg(bitmap)").alias("bitmap"))


def bitmap_count(bitmaps: DataFrame) -> DataFrame:
    return bitmaps.agg(F.coalesce(F.sum(F.bitmap_count("bitmap")), F.lit(0)).alias("n"))
