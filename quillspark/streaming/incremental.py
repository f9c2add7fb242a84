"""Incremental indexing: each micro-batch of passages appends its postings and lengths.

Batches are written under their number, so a batch that is tried again replaces its own files and no posting
counts twice. Statistics and document frequencies are sums over the batches, taken when a query runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import index


def append_batch(docs: DataFrame, number: int, path: str) -> None:
    passages = docs.select("doc_id", "pid", F.size(index.tokenize(F.col("text"))).alias("length"))
    passages.write.mode("overwrite").parquet(f"{path}/passages/batch={number}")
    index.postings(docs).sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(f"{path}/postings/batch={number}")


def index_stream(docs: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Starts indexing a stream of (doc_id, pid, text) with unique doc_id until what is there is read."""
    return docs.writeStream.foreachBatch(lambda batch, n: append_batch(batch, n, path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
