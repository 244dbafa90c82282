"""A change log as a stream: each micro-batch is folded into a collection and published as a new version."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.changes import fold
from ..sources.store import Store


def upsert_stream(log: DataFrame, store: Store, name: str, key: list[str], sequence: list[str], checkpoint: str, deleted: str | None = None):
    """A started query that keeps a collection at the log's state.

    Records keep their sequence, and a change only wins over a smaller one; late and repeated
    micro-batches therefore do no harm. Deletes stay as rows marked by the column `deleted`, until
    `forget` drops those that no late change can precede. A micro-batch writes only the files that hold its keys.
    """

    def merge(batch: DataFrame, _: int) -> None:
        rows = batch.withColumn("deleted", F.coalesce(F.col(deleted), F.lit(False)) if deleted else F.lit(False))
        rows = fold(rows, key, sequence).persist()
        try:
            store.merge(name, rows, key, sequence)
        finally:
            rows.unpersist()

    return log.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def forget(store: Store, name: str, old: F.Column) -> None:
    """Drops the marks of deletes for which old holds; no change before them may still come."""
    rows = store[name]
    store.put(name, rows.df.where(~(F.col("deleted") & F.coalesce(old, F.lit(False)))), rows.key)
