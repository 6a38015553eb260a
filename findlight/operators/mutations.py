"""Upserts, deletes, expiry and the checks on what is written, over a table of versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import normalize, vectors
from ..plans.schema import Schema


class ConstraintError(ValueError):
    pass


def latest(versions: DataFrame, id_col: str, seq_col: str) -> DataFrame:
    """The last version of each id. A hot id is reduced where its rows lie before they meet."""
    best = versions.groupBy(id_col).agg(F.max_by(F.struct("*"), F.col(seq_col)).alias("_v"))
    return best.select("_v.*")


#: Ids up to which a batch is broadcast (some 20 MB), so that the table stays where it is.
BROADCAST_IDS = 500_000


def _ids(rows: DataFrame, id_col: str) -> DataFrame:
    """``_id`` of some rows, to be broadcast if they are few, counted first."""
    ids = rows.select(F.col(id_col).alias("_id")).distinct()
    return F.broadcast(ids) if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else ids


def beside_ids(table: DataFrame, rows: DataFrame, id_col: str) -> DataFrame:
    """The rows of ``table`` whose ids are in ``rows``; the table stays where it is if these are few."""
    return table.join(_ids(rows, id_col), F.col(id_col) == F.col("_id"), "left_semi")


def upsert(table: DataFrame, batch: DataFrame, id_col: str, seq_col: str) -> DataFrame:
    """``table``, which has one row for each id, with the rows of ``batch`` in place of those of the same id; of several versions the last counts. Rows of the batch without an id are passed over.

    Only rows whose ids are in the batch are moved: beside a small batch the table isn't shuffled.
    """
    new = batch.filter(F.col(id_col).isNotNull())
    ids = _ids(new, id_col)
    met = table.join(ids, F.col(id_col) == F.col("_id"), "left_semi")
    rest = table.join(ids, F.col(id_col) == F.col("_id"), "left_anti")
    return rest.unionByName(latest(met.unionByName(new, allowMissingColumns=True), id_col, seq_col), allowMissingColumns=True)


def delete(table: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """``table`` without the rows whose ids are in ``ids``; an id that isn't there does nothing."""
    return table.join(_ids(ids, id_col), F.col(id_col) == F.col("_id"), "left_anti")


def apply_changes(table: DataFrame, changes: DataFrame, id_col: str, seq_col: str, op_col: str = "op", deletes: tuple[str, ...] = ("delete",)) -> DataFrame:
    """``table`` after an ordered log of upserts and deletes: the last change of each id decides. ``op_col`` isn't among the table's columns."""
    last = latest(changes.filter(F.col(id_col).isNotNull()), id_col, seq_col)
    kept = delete(table, last, id_col)
    return kept.unionByName(last.filter(~F.col(op_col).isin(*deletes)).drop(op_col), allowMissingColumns=True)


def alive(expires: Column, now: float) -> Column:
    """Whether a row counts at ``now`` (seconds): it has no expiry, or one not over 0, or one not yet past."""
    return F.coalesce((expires <= 0) | (F.lit(now) <= expires), F.lit(True))


def live(table: DataFrame, schema: Schema, now: float | None = None, deleted_col: str | None = None) -> DataFrame:
    """The rows that searches see: not deleted, and not expired at ``now``."""
    out = table if deleted_col is None else table.filter(~F.coalesce(F.col(deleted_col), F.lit(False)))
    for f in schema.fields:
        if f.ttl and now is not None:
            out = out.filter(alive(_seconds(out, f.source), now))
    return out


def _seconds(df: DataFrame, name: str) -> Column:
    """A number of seconds, or a time, as seconds since 1970; a time without a zone is taken as UTC."""
    kind = dict(df.dtypes)[name]
    if kind == "timestamp_ntz":
        return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{name}`)") / 1e6
    return F.unix_micros(F.col(name)) / 1e6 if kind == "timestamp" else F.col(name).cast("double")


def violations(table: DataFrame, schema: Schema) -> DataFrame:
    """``(field, value, ids)`` for each value of a unique field that more than one id has."""
    out = None
    for f in schema.fields:
        if f.unique:
            value = normalize.value(F.col(f.source).cast("string"), f.normalizer, f.lowercase)
            found = table.select(F.col(schema.id).alias("id"), value.alias("value")).filter("value <> ''").groupBy("value").agg(F.countDistinct("id").alias("ids")).filter("ids > 1")
            found = found.select(F.lit(f.name).alias("field"), "value", "ids")
            out = found if out is None else out.union(found)
    return out if out is not None else table.sparkSession.createDataFrame([], "field string, value string, ids long")


def require_unique(table: DataFrame, schema: Schema) -> DataFrame:
    bad = violations(table, schema).limit(1).collect()
    if bad:
        raise ConstraintError(f"{bad[0].field}: {bad[0].value!r} belongs to {bad[0].ids} ids")
    return table


def split_valid(batch: DataFrame, schema: Schema) -> tuple[DataFrame, DataFrame]:
    """(rows that may be written, rows that may not): an id is needed, and vectors of the right length made of numbers."""
    ok = F.col(schema.id).isNotNull()
    for f in schema.fields:
        if f.kind == "vector":
            ok = ok & (F.col(f.source).isNull() | vectors.valid(F.col(f.source), f.dim))
    return batch.filter(ok), batch.filter(~ok)


def first_version(table: DataFrame, id_col: str, seq_col: str) -> DataFrame:
    """The first version of each id, as an append-only table keeps it; reduced where its rows lie before they meet."""
    return table.groupBy(id_col).agg(F.min_by(F.struct("*"), F.col(seq_col)).alias("_v")).select("_v.*")
