"""Documents and deletions that arrive as streams, each micro-batch one batch of the index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..engine import Index


def ingest(stream: DataFrame, index: Index, checkpoint: str, content: str = "content", id_col: str = "doc_id", seconds: int = 5, once: bool = False) -> StreamingQuery:
    """Append a stream of documents (id_col, content) to an index.

    A micro-batch that is run again after a failure adds no document twice: the
    index notes the last one of each checkpoint with its batch.  Ids of live
    documents are left out; they are looked up within the micro-batch's range of
    ids, so that files and row groups are pruned.
    """

    def write(batch: DataFrame, number: int) -> None:
        store = index.store
        store.refresh()
        if store.manifest["streams"].get(checkpoint, -1) >= number:
            return
        rows = batch.select(batch[id_col].cast("string").alias("doc_id"), batch[content].alias("content")).dropDuplicates(["doc_id"])
        first, last = rows.agg(F.min("doc_id"), F.max("doc_id")).first()
        if first is None:
            return
        have = store.live("doc_stats").where(F.col("doc_id").between(first, last)).select("doc_id")
        fresh = rows.join(have, "doc_id", "left_anti")
        if not fresh.isEmpty():
            store.append(fresh, index.analyzer, True, (checkpoint, number))

    trigger = {"availableNow": True} if once else {"processingTime": f"{seconds} seconds"}
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def delete_stream(stream: DataFrame, index: Index, checkpoint: str, id_col: str = "doc_id", seconds: int = 5, once: bool = False) -> StreamingQuery:
    """Delete the documents whose ids a stream brings."""

    def write(batch: DataFrame, _: int) -> None:
        index.store.delete(batch.select(batch[id_col].cast("string").alias("doc_id")))

    trigger = {"availableNow": True} if once else {"processingTime": f"{seconds} seconds"}
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger).start()
