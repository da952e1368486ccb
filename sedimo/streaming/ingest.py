"""Streams of mutations into a store, and a live view over a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sedimo.operators.merge import as_versions
from sedimo.sources.store import Store


def ingest(stream: DataFrame, store: Store, checkpoint: str, name: str = "ingest", once: bool = False) -> StreamingQuery:
    """Commit each micro-batch of a stream ``(seq, op, key, value)`` as a run.

    A batch that Spark delivers again after a failure is known by its number in
    the manifest and left out, so the store has each row's effect once.
    """

    def commit(batch: DataFrame, number: int) -> None:
        store.append(batch, batch=(name, number))

    writer = stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).queryName(name)
    return (writer.trigger(availableNow=True) if once else writer).start()


def live_changes(stream: DataFrame) -> DataFrame:
    """The newest version of each key as a streaming aggregate: ``key, seq, deleted, value``.

    For the update mode: each trigger gives the keys that changed.  Late and
    repeated mutations change nothing, since the larger ``seq`` stays; the state
    holds one row for each key.
    """
    newest = F.max_by(F.struct("seq", "deleted", "value"), "seq").alias("v")
    return as_versions(stream).groupBy("key").agg(newest).select("key", "v.*")
