"""Streams of rows into a graph: each micro-batch is written once and appended as one change."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from weftline.graph import Graph


def stream_inserts(graph: Graph, type_name: str, rows: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Insert what a stream brings; triggers, rewrites and policies apply to each micro-batch.

    ``folder`` holds the batches as Parquet; a batch that is run again after a failure overwrites its own files. A graph
    with a folder keeps the number of its last batch with its tables, so that a batch is inserted once, whenever the
    stream is stopped and started again on the same checkpoint.
    """

    def add(batch: DataFrame, number: int) -> None:
        if number <= graph.batches.get(checkpoint, -1):
            return
        path = f"{folder}/batch={number}"
        batch.write.mode("overwrite").parquet(path)
        before, graph.batches = graph.batches, {**graph.batches, checkpoint: number}
        try:
            graph.insert_rows(type_name, batch.sparkSession.read.schema(batch.schema).parquet(path))
        except BaseException:
            graph.batches = before
            raise

    return rows.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).start()
