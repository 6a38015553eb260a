"""Bulk and incremental loads into stored generations."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..operators.mutations import latest, split_valid, upsert
from ..plans.schema import Schema
from .store import Checkpoint, Store


@dataclass(frozen=True)
class LoadStats:
    seen: int
    indexed: int
    skipped: int
    seconds: float

    @property
    def rows_per_second(self) -> float:
        return self.seen / self.seconds if self.seconds else 0.0


class MissingId(ValueError):
    pass


def load(source: DataFrame, store: Store, schema: Schema, seq_col: str | None = None, resume: Checkpoint | None = None, name: str = "load", skip_bad: bool = True, append: bool = False, progress: Callable[[LoadStats], None] | None = None, **layout) -> LoadStats:
    """``source`` into a new generation. With ``resume``, rows up to the saved ``seq_col`` are passed over and what is there stays.

    Rows without an id, or with a bad vector, are skipped and counted, or raise. What was seen is counted
    while the rows are written, in the same job. ``append``: versions aren't reduced to the last.
    """
    began = time.perf_counter()
    if resume is not None and seq_col:
        done = resume.load(name).get("seq")
        if done is not None:
            source = source.filter(F.col(seq_col) > F.lit(done))
    good, bad = split_valid(source, schema)
    if not skip_bad and bad.limit(1).count():
        raise MissingId("a row can't be loaded")
    seen = Observation()
    ok = F.col(schema.id).isNotNull()
    top = F.max(seq_col) if seq_col else F.lit(None)
    watched = source.observe(seen, F.count("*").alias("seen"), F.count(F.when(ok, 1)).alias("with_id"), top.alias("seq"))
    rows, _ = split_valid(watched, schema)
    if resume is not None and store.current() is not None:
        rows = store.read().unionByName(rows, allowMissingColumns=True)
    if not append and seq_col:
        rows = latest(rows, schema.id, seq_col)
    before = store.manifest().rows if resume is not None and store.current() is not None else 0
    made = store.save(rows, **layout)
    got = seen.get
    if resume is not None and got["seq"] is not None:
        resume.save(name, seq=got["seq"])
    stats = LoadStats(got["seen"], made.rows - before if append or not seq_col else got["with_id"], got["seen"] - got["with_id"], time.perf_counter() - began)
    if progress:
        progress(stats)
    return stats


def newer(source: DataFrame, mark: dict, time_col: str = "updated_at", id_col: str = "id") -> DataFrame:
    """The rows past a high-water mark (updated_at, id)."""
    if not mark:
        return source
    t, i = F.lit(mark["updated_at"]).cast(source.schema[time_col].dataType), F.lit(mark["id"]).cast(source.schema[id_col].dataType)
    return source.filter((F.col(time_col) > t) | ((F.col(time_col) == t) & (F.col(id_col) > i)))


def high_water(rows: DataFrame, time_col: str = "updated_at", id_col: str = "id") -> dict:
    top = rows.agg(F.max(F.struct(F.col(time_col).alias("t"), F.col(id_col).alias("i"))).alias("m")).first().m
    return {"updated_at": str(top.t), "id": top.i} if top else {}


def incremental(source: DataFrame, store: Store, schema: Schema, checkpoint: Checkpoint, name: str = "incremental", time_col: str = "updated_at") -> int:
    """Merges what is new since the last call and moves the mark; returns how many rows that was.

    What is new is written once, into the store's own folder, and read from there: the source may move on meanwhile.
    """
    folder = f"increments/{uuid.uuid4().hex}"
    newer(source, checkpoint.load(name), time_col, schema.id).write.parquet(f"{store.root}/{folder}")
    rows = store.spark.read.parquet(f"{store.root}/{folder}")
    n = rows.count()
    if n:
        store.save(upsert(store.read(), rows, schema.id, time_col) if store.current() is not None else latest(rows, schema.id, time_col))
        checkpoint.save(name, **high_water(rows, time_col, schema.id))
    store.files.delete(folder)
    return n


def partitioned(df: DataFrame, rows_per_partition: int, id_col: str, base: str = "p") -> DataFrame:
    """``df`` with a ``part`` column ``<base>-p000000`` and on, by ranges of the id of about that many rows."""
    n = max(1, -(-df.count() // rows_per_partition))
    return df.repartitionByRange(n, id_col).withColumn("part", F.format_string(f"{base}-p%06d", F.spark_partition_id()))
