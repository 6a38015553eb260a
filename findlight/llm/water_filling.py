"""Mixing sources to target weights by capped water-filling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import beside, cut, fresh, table, word_count

#: Slices of a source's hash range at most (a power of two), and rows that a slice has at least; only the slice where a source's fraction ends is ordered row by row.
SLICE_BITS = 20
SLICE_ROWS = 512
SEED = "mix-1"


def water_level(sources: DataFrame, budget: float) -> float:
    """The level L at which the sum of min(cap, L * weight) over ``sources (weight, cap)`` is ``budget``, or infinity if the caps hold less.

    Clamps the sources whose share is above their cap and shares the rest among the others, by weight, until
    none is above. Each round is one aggregation that returns a single row.
    """
    level = 0.0
    while True:
        over = F.col("cap") <= F.lit(level) * F.col("weight")
        held, free, n = sources.agg(F.sum(F.when(over, F.col("cap")).otherwise(0.0)), F.sum(F.when(over, 0.0).otherwise(F.col("weight"))), F.sum(F.when(over, 0).otherwise(1))).first()
        if not n or not free:
            return float("inf")
        risen = max(level, (budget - held) / free)
        if risen <= level * (1 + 1e-12):
            return level
        level = risen


def weigh_in_turn(sources: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0)) -> DataFrame:
    """``sources (source, ...)`` with ``weight``: in code point order, null last, the weights in turn.

    The place of a source in that order is its place in its range partition and the sources in those before.
    """
    parts = cut(sources.repartitionByRange(F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last()).withColumn("_part", F.spark_partition_id()))
    before = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    before = before.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    within = Window.partitionBy("_part").orderBy(F.col("source").asc_nulls_last())
    place = F.col("_before") + F.row_number().over(within) - 1
    picked = F.get(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(place, F.lit(len(weights))).cast("int"))
    return parts.join(before, "_part").withColumn("weight", picked).drop("_part", "_before")


def _fill(edge: DataFrame, passes: int = 3) -> DataFrame:
    """The rows of ``edge (_s, _hash, _id, _size, bulk, need)`` that are taken: in hash order until the next doesn't fit, then the largest that still fit."""
    source = Window.partitionBy("_s")
    order = source.orderBy("_hash", "_id", "_size")
    edge = edge.withColumn("_in", F.sum("bulk").over(order) <= F.col("need"))
    for _ in range(passes):
        edge = edge.withColumn("_left", F.col("need") - F.sum(F.when(F.col("_in"), F.col("bulk")).otherwise(0)).over(source))
        fits = ~F.col("_in") & (F.col("bulk") <= F.col("_left"))
        by_size = source.orderBy(F.when(fits, F.col("bulk")).desc_nulls_last(), "_hash", "_id", "_size").rowsBetween(Window.unboundedPreceding, 0)
        edge = edge.withColumn("_in", F.col("_in") | (fits & (F.sum(F.when(fits, F.col("bulk")).otherwise(0)).over(by_size) <= F.col("_left"))))
    return edge.filter("_in").select("_s", "_hash", "_id", "_size")


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", max_epochs: float = 3.0, total: float = 1.0, weights: tuple[float, ...] = (1.0, 2.0, 3.0), seed: str = SEED) -> DataFrame:
    """``docs`` with one more column ``mixed``: a struct of size, source_size, target, repetitions and taken.

    (The column is ``_mixed`` if ``docs`` has a ``mixed``.) Size is the number of words; targets share ``total`` of
    all sizes by weight and stop at ``max_epochs`` times the source's size, and the excess is shared anew. A
    source is taken as many whole times as its target holds, and a fraction of it once more: rows in the order of
    a seeded hash until the next one doesn't fit, then, of the rows in the same slice of the hash range, the
    largest that still fit. No text is cut. Reruns agree, whatever the partitions.

    A null text has size 0. Rows of null source are a source, the last. Rows that repeat id, source and size are
    taken alike. A source without words has target 0. An empty table gives no rows.
    """
    name, size_, hash_, d_, x_ = fresh(docs, "mixed", "_size", "_hash", "_d", "_x")
    size = word_count(F.col(text_col))
    key = docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("_s"), size.alias("_size"))
    key = key.withColumn("_hash", F.xxhash64(F.lit(seed), "_id", "_s", "_size"))
    units = cut(key.groupBy("_s", "_hash", "_id", "_size").agg((F.count("*") * F.col("_size")).alias("bulk")))
    sources = units.groupBy(F.col("_s").alias("source")).agg(F.sum("bulk").alias("source_size"), F.count("*").alias("n"))
    sources = cut(weigh_in_turn(sources)).withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
    everything = sources.agg(F.sum("source_size")).first()[0] or 0
    level = water_level(sources.filter("source_size > 0").select("weight", "cap"), everything * total)
    target = F.col("cap") if level == float("inf") else F.least(F.col("cap"), F.col("weight") * F.lit(level))
    sources = sources.withColumn("target", F.when(F.col("source_size") > 0, target).otherwise(0.0))
    sources = sources.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + F.lit(1e-9))).otherwise(0).cast("int"))
    sources = sources.withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size")))
    # Slices of the hash range: a power of two of them, each with some hundred rows at least.
    per = F.greatest(F.lit(0), F.least(F.lit(SLICE_BITS), F.floor(F.log2(F.col("n") / F.lit(SLICE_ROWS))).cast("int")))
    sources = cut(sources.withColumn("_div", F.pow(F.lit(2), F.lit(SLICE_BITS) - per).cast("int"))).withColumnRenamed("source", "_src")
    slice_of = lambda h, div: F.floor(F.pmod(h, F.lit(1 << SLICE_BITS)) / div).cast("int")

    sliced = beside(units, sources.select("_src", "_div", "rest"), F.col("_s").eqNullSafe(F.col("_src"))).withColumn("_slice", slice_of(F.col("_hash"), F.col("_div")))
    coarse = sliced.groupBy("_src", "_slice").agg(F.sum("bulk").alias("bulk"), F.first("rest").alias("rest"))
    coarse = coarse.withColumn("_from", F.sum("bulk").over(Window.partitionBy("_src").orderBy("_slice")) - F.col("bulk"))
    edges = coarse.filter((F.col("_from") <= F.col("rest")) & (F.col("_from") + F.col("bulk") > F.col("rest")))
    edges = edges.groupBy(F.col("_src").alias("_esrc")).agg(F.min("_slice").alias("_edge"), F.min_by(F.col("rest") - F.col("_from"), "_slice").alias("need"))
    dealt = cut(sources.join(edges, F.col("_src").eqNullSafe(F.col("_esrc")), "left").drop("_esrc"))

    edge = beside(units, dealt.select("_src", "_edge", "_div", "need"), F.col("_s").eqNullSafe(F.col("_src"))).filter(slice_of(F.col("_hash"), F.col("_div")) == F.col("_edge"))
    extra = cut(_fill(edge.select("_s", "_hash", "_id", "_size", "bulk", "need")))

    rows = docs.withColumns({size_: size}).withColumn(hash_, F.xxhash64(F.lit(seed), F.col(id_col), F.col(source_col), F.col(size_)))
    part = lambda whole, *names: [F.col(f"{whole}.{n}") for n in names]
    of_source = dealt.select(F.struct("_src", "source_size", "target", "whole", "_edge", "_div").alias(d_))
    source, source_size, target, whole, at_edge, div = part(d_, "_src", "source_size", "target", "whole", "_edge", "_div")
    rows = beside(rows, of_source, docs[source_col].eqNullSafe(source))
    h, i, s, z = part(x_, "_hash", "_id", "_s", "_size")
    match = (F.col(hash_) == h) & docs[id_col].eqNullSafe(i) & docs[source_col].eqNullSafe(s) & (F.col(size_) == z)
    rows = beside(rows, extra.select(F.struct("*").alias(x_)), match, "left")
    more = F.when(F.col(x_).isNotNull(), 1).when(at_edge.isNotNull() & (slice_of(F.col(hash_), div) < at_edge), 1).otherwise(0)
    times = (whole + more).cast("int")
    made = F.struct(F.col(size_).alias("size"), source_size.alias("source_size"), target.alias("target"), times.alias("repetitions"), (F.col(size_) * times).alias("taken"))
    return rows.withColumn(name, made).select(*docs.columns, name)


def op6_water_filling(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = mix(table(spark, sf_dir, "documents"))
    return made.select("doc_id", "mixed.size", "mixed.source_size", "mixed.target", "mixed.taken", "source", "mixed.repetitions")
