"""Change streams: upserts and deletes, kept as deltas beside a stored generation and folded into the next one now and then."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.mutations import apply_changes, beside_ids, latest
from ..sources.store import Store

DELTAS = "deltas"


def pending(store: Store) -> list[str]:
    """The deltas that aren't folded in yet, oldest first."""
    return [x for x in store.files.list(DELTAS) if x.startswith("batch-")]


def merged(store: Store, id_col: str, seq_col: str, op_col: str = "op", deletes: tuple[str, ...] = ("delete",)) -> DataFrame:
    """The table as it is now: the current generation after the deltas. The last change of each id decides, and one that is older than what is stored doesn't count."""
    names = pending(store)
    if not names:
        return store.read()
    changes = latest(store.spark.read.parquet(*[f"{store.root}/{DELTAS}/{n}" for n in names]).filter(F.col(id_col).isNotNull()), id_col, seq_col)
    if store.current() is None:
        return apply_changes(changes.drop(op_col).limit(0), changes, id_col, seq_col, op_col, deletes)
    table = store.read()
    seen = beside_ids(table.select(id_col, seq_col), changes, id_col).groupBy(F.col(id_col).alias("_known")).agg(F.max(seq_col).alias("_seen"))
    fresh = changes.join(seen, F.col(id_col) == F.col("_known"), "left").filter(F.col("_seen").isNull() | (F.col(seq_col) >= F.col("_seen"))).drop("_known", "_seen")
    return apply_changes(table, fresh, id_col, seq_col, op_col, deletes)


def fold(store: Store, id_col: str, seq_col: str, op_col: str = "op", deletes: tuple[str, ...] = ("delete",), keep: int = 2) -> None:
    """The deltas into the next generation. Run again after a failure it changes nothing."""
    names = pending(store)
    if names:
        store.save(merged(store, id_col, seq_col, op_col, deletes))
        for n in names:
            store.files.delete(f"{DELTAS}/{n}")
        store.compact(keep)


def merge_stream(changes: DataFrame, store: Store, checkpoint: str, id_col: str, seq_col: str, op_col: str = "op", deletes: tuple[str, ...] = ("delete",), available_now: bool = True, keep: int = 2, every: int = 16) -> StreamingQuery:
    """Writes each micro-batch of ``changes`` beside the current generation, and folds the deltas into the next one when there are ``every`` of them.

    A batch costs what it holds, not what the table holds; ``merged`` reads both. A batch that is run again
    after a failure overwrites itself.
    """

    def put(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{store.root}/{DELTAS}/batch-{batch_id:012d}")
        if len(pending(store)) >= every:
            fold(store, id_col, seq_col, op_col, deletes, keep)

    writer = changes.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
