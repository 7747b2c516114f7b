"""Streaming ingest into a stored collection."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.changes import fold
from ..sources.store import Store


def ingest(changes: DataFrame, store: Store, checkpoint: str, on_failures: Callable[[DataFrame, int], None] | None = None, error=None, available_now: bool = True) -> StreamingQuery:
    """Append each micro-batch of (seq, action, id, vector, sparse, meta) to the log.

    A batch that is delivered again is appended again; as the last seq of an
    id wins, the folded outcome is the same.  With ``error`` (a Column, null
    for good rows) the others go to ``on_failures`` and leave no trace.
    """

    def write(batch: DataFrame, number: int) -> None:
        good = batch
        if error is not None:
            marked = batch.withColumn("error", error).persist()
            good = marked.where("error is null or action = 'DELETE'").drop("error")
            if on_failures is not None:
                on_failures(marked.where("error is not null and action <> 'DELETE'").select("id", "error"), number)
            store.append(good)
            marked.unpersist()
            return
        store.append(good)

    writer = changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def fold_stream(changes: DataFrame, path: str, checkpoint: str, id_col: str, seq_col: str, action_col: str) -> StreamingQuery:
    """Append the entries of a stream to a table whose fold is its final state."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("append").parquet(path)

    return changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def final_state(path_table: DataFrame, id_col: str, seq_col: str, action_col: str) -> DataFrame:
    """The live rows of the appended table; entries that came twice count once."""
    return fold(path_table.dropDuplicates([seq_col]) if seq_col else path_table, id_col, seq_col, action_col)

