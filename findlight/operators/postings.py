"""Stored token tables: for each token lists of the rows that have it and how often, sorted by token, so that words are found and ranked without reading the texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.compiler import _Compiler
from ..plans.schema import Schema
from .layout import dealt, write
from .ranking import B, K1, _length, idf

#: Tokens up to which rows are counted together, so that a task holds few at a time. One longer row is counted by itself.
TOKENS_AT_ONCE = 1_000_000


def lists(rows: DataFrame, at_once: int = TOKENS_AT_ONCE) -> DataFrame:
    """``(token, ids, tfs, dls)`` of rows ``(id, t)``: for each token the rows whose arrays have it, how often, and how long these are.

    Rows are gathered where they lie, ``at_once`` tokens at a time, so a token has a list for each such slice: what is
    moved and sorted later are lists, not occurrences.
    """

    def of_few(ids, arrays):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        row, tokens = pc.list_parent_indices(arrays), arrays.flatten()
        there = tokens.is_valid()
        coded, n = tokens.filter(there).dictionary_encode(), len(arrays)
        found, tf = np.unique(coded.indices.to_numpy().astype(np.int64) * n + row.filter(there).to_numpy(), return_counts=True)
        token, at = found // n, pa.array(found % n)
        starts = np.flatnonzero(np.diff(token, prepend=-1))
        ends = pa.array(np.append(starts, len(token)).astype(np.int32))
        listed = [pa.ListArray.from_arrays(ends, x) for x in (ids.take(at), pa.array(tf.astype(np.int32)), arrays.value_lengths().take(at))]
        return pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(token[starts])), *listed], names=["token", "ids", "tfs", "dls"])

    def work(batches):
        import numpy as np

        for batch in batches:
            ends = np.cumsum(batch.column(1).value_lengths().fill_null(0).to_numpy().astype(np.int64))
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + at_once, "right")))
                yield of_few(batch.column(0).slice(at, to - at), batch.column(1).slice(at, to - at))
                at = to

    return rows.mapInArrow(work, f"token string, ids array<{rows.schema['id'].dataType.simpleString()}>, tfs array<int>, dls array<int>")


def of(live: DataFrame, schema: Schema) -> DataFrame:
    """``(field, token, ids, tfs, dls)``: lists of the tokens of texts, and of whole normalised values of keywords, for which tf and dl are 1."""
    compiler, parts = _Compiler(schema), []
    for f in schema.fields:
        if not f.strings:
            continue
        if f.words:
            rows = live.select(F.col(schema.id).alias("id"), compiler._tokens(f).alias("t"))
        else:
            values = live.select(F.col(schema.id).alias("id"), compiler._value(f, compiler._col(f)).alias("value")).filter("value <> ''")
            rows = values.select("id", F.array("value").alias("t"))
        parts.append(lists(rows).select(F.lit(f.name).alias("field"), "token", "ids", "tfs", "dls"))
    return reduce(DataFrame.unionByName, parts)


def totals(live: DataFrame, schema: Schema) -> DataFrame:
    """``(field, n, mean)``: all rows, and the mean number of tokens of those that have the field; one row a field."""
    compiler = _Compiler(schema)
    fields = [f for f in schema.fields if f.strings]
    length = lambda f: _length(compiler, f) if f.words else F.lit(1)
    sums = live.agg(F.count("*").alias("n"), *[F.struct(F.sum(length(f)).alias("l"), F.count(F.col(f.source)).alias("k")).alias(f"f{i}") for i, f in enumerate(fields)])
    mean = lambda i, f: F.greatest(F.col(f"f{i}.l") / F.greatest(F.col(f"f{i}.k"), F.lit(1)), F.lit(1e-9)) if f.words else F.lit(1.0)
    return sums.select(F.explode(F.array(*[F.struct(F.lit(f.name).alias("field"), F.col("n"), mean(i, f).cast("double").alias("mean")) for i, f in enumerate(fields)])).alias("t")).select("t.*")


def save(live: DataFrame, schema: Schema, path: str) -> None:
    """Both tables below ``path``; the first by ranges of tokens, with a Bloom filter on them, so that a search reads few row groups."""
    live = dealt(live, schema.id)
    write(of(live, schema), f"{path}/postings", sort_by=("token", "field"), bloom=("token",))
    totals(live, schema).write.parquet(f"{path}/totals")


def bm25(spark: SparkSession, path: str, words: tuple[str, ...], limit: int | None = None) -> DataFrame:
    """``(id, score)`` of the rows that hold each of ``words`` in some field, as a search for them ranks; only their tokens are read.

    A word's postings are reduced where they lie: df is one row for each field and word, and rows meet by id.
    """
    wanted = sorted({w.lower() for w in words})
    listed = spark.read.parquet(f"{path}/postings").filter(F.col("token").isin(wanted))
    found = listed.select("field", "token", F.explode_outer(F.arrays_zip("ids", "tfs", "dls")).alias("p")).select("field", "token", F.col("p.ids").alias("id"), F.col("p.tfs").alias("tf"), F.col("p.dls").alias("dl"))
    df = listed.groupBy(F.col("field").alias("_f"), F.col("token").alias("_t")).agg(F.sum(F.size("ids")).alias("df"))
    stats = df.join(F.broadcast(spark.read.parquet(f"{path}/totals")), F.col("_f") == F.col("field")).drop("field")  # a row for each field
    rows = found.join(F.broadcast(stats), (F.col("field") == F.col("_f")) & (F.col("token") == F.col("_t")))  # a row for each field and word
    times = F.element_at(F.create_map(*[x for w in wanted for x in (F.lit(w), F.lit(float(sum(v.lower() == w for v in words))))]), F.col("token"))
    weight = times * idf(F.col("n"), F.col("df")) * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1.0 - B + B * F.col("dl") / F.col("mean")))
    out = rows.groupBy("id").agg(F.sum(weight).alias("score"), F.countDistinct("token").alias("k")).filter(F.col("k") == len(wanted)).select("id", "score")
    return out if limit is None else out.orderBy(F.col("score").desc(), "id").limit(limit)
