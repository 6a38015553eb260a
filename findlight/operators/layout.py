"""How a table is laid out so that searches read little of it: normalised columns, token columns, sorting and buckets."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import normalize
from ..plans.schema import Schema


def normalized(df: DataFrame, schema: Schema, *names: str) -> tuple[DataFrame, Schema]:
    """``df`` with a ``<field>__norm`` column for each keyword field named (all if none is), and the schema that uses them.

    Equality, sets and prefixes are then comparisons of bare columns, which Parquet's statistics, dictionaries
    and Bloom filters can answer.
    """
    made, fields = {}, []
    for f in schema.fields:
        if f.kind == "keyword" and not f.multi and (not names or f.name in names):
            made[f"{f.name}__norm"] = normalize.value(F.col(f.source).cast("string"), f.normalizer, f.lowercase)
            f = replace(f, norm=f"{f.name}__norm")
        fields.append(f)
    return df.withColumns(made), replace(schema, fields=tuple(fields))


def dealt(df: DataFrame, id_col: str) -> DataFrame:
    """Rows whose columns cost more to look at than to move, dealt to all cores where the files have fewer parts."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, id_col) if df.rdd.getNumPartitions() < cores else df


def write(df: DataFrame, path: str, sort_by: tuple[str, ...] = (), bloom: tuple[str, ...] = (), partition_by: tuple[str, ...] = (), files: int | None = None) -> None:
    """Parquet by ranges of ``sort_by``, so that row groups hold narrow ranges, with Bloom filters on columns that are looked up."""
    if sort_by:
        df = (df.repartitionByRange(files, *sort_by) if files else df.repartitionByRange(*sort_by)).sortWithinPartitions(*sort_by)
    writer = df.write
    for c in bloom:
        writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def bucketed(df: DataFrame, table: str, buckets: int, *keys: str) -> None:
    """A table in hash buckets of its keys: joins and lookups by all of them need no shuffle."""
    df.write.bucketBy(buckets, *keys).sortBy(*keys).mode("overwrite").saveAsTable(table)
