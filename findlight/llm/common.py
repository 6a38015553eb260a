"""Helpers that several operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that parts words, as a character class of Java's and Python's regular expressions.
SPACE = r"\x20\x09-\x0D"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` below ``sf_dir``, read by Spark whatever store it lies in."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``df``, dealt to all cores by its ids where its files have fewer parts than there are cores: texts cost more to look at than to move."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, id_col) if df.rdd.getNumPartitions() < cores else df


def let(value: Column, body) -> Column:
    """``body`` over a variable that holds ``value``, so that lambdas in it don't compute ``value`` again for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    """The words of a text as an array; none for null and for white space only."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), "")


def word_count(text: Column) -> Column:
    """How many words a text has; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")


def each(values: Column) -> Column:
    """``values`` one by one, and one null for an empty array, which the caller drops.

    An inner explode of a computed array is computed twice: once more for a filter on its size that the optimizer
    puts before it.
    """
    return F.explode_outer(values)


def ascii_lower(text: Column) -> Column:
    """A-Z lowered, all else kept."""
    return F.translate(text, _UPPER, _LOWER)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where that is unset and all run on one machine (tests in local mode)."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        context = spark.sparkContext._jsc.sc()
        if context.getCheckpointDir().isEmpty():
            if not context.isLocal():
                raise RuntimeError("spark.checkpoint.dir isn't set: a cluster needs a folder that all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="findlight-"))
        at = context.getCheckpointDir().get()
    return at.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder, where the loss of executors doesn't reach it."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def kept_table(df: DataFrame, *parts: str) -> DataFrame:
    """``df`` written as a table in the shared folder, in directories by ``parts``, and read from there."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").partitionBy(*parts).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a narrow table up to which it is broadcast (some 10 MB).
BROADCAST_ROWS = 200_000


def beside(big: DataFrame, small: DataFrame, on: Column, how: str = "inner") -> DataFrame:
    """``big`` joined with the narrow table ``small``, which is broadcast if it has few rows, counted first, and shuffled otherwise."""
    return big.join(F.broadcast(small) if small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else small, on, how)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Each name, or where ``df`` has it already (whatever its case) the name with underscores in front."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def first_of(docs: DataFrame, rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The first row of ``docs`` of each root of ``rows (doc_id, text_hash, root)``; text_hash is of the text, null being empty. Of rows with the same id and text any one."""
    keys = rows.groupBy("root", "doc_id", "text_hash").agg(F.count("*").alias("n"))
    least = keys.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash", "n")).alias("first"))
    i, h = fresh(docs, "id", "hash")
    chosen = cut(least.select(F.col("first.doc_id").alias(i), F.col("first.text_hash").alias(h), F.col("first.n").alias("n")))
    hashed = F.xxhash64(F.coalesce(docs[text_col], F.lit("")))
    same = docs[id_col].eqNullSafe(F.col(i)) & (hashed == F.col(h))
    once = beside(docs, chosen.filter("n = 1").drop("n"), same, "left_semi")
    repeated = chosen.filter("n > 1").drop("n")
    if repeated.isEmpty():
        return once
    return once.unionByName(beside(docs, repeated, same, "left_semi").withColumn(h, hashed).dropDuplicates([id_col, h]).drop(h))
