"""Streams into a document store, once for each micro-batch, and windowed counts over streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sparkseek.operators.placement import Placement
from sparkseek.operators.store import DocumentStore


def ingest(docs: DataFrame, store: DocumentStore, checkpoint: str, owned: Callable[[DataFrame], DataFrame] | None = None, arrival: Column | None = None, poll: str | None = None) -> StreamingQuery:
    """Upserts a stream of documents into the store. ``owned`` keeps the documents of this writer and is asked for each batch, so it may read the newest placement.

    The checkpoint keeps what was read; the store skips a batch that it has, so each batch counts once. Without
    ``poll`` the query takes what is there and ends.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        own = owned(batch) if owned else batch
        store.upsert(own, arrival, batch_id)

    writer = docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=poll) if poll else writer.trigger(availableNow=True)
    return writer.start()


def owned_by(placement: Callable[[], Placement], group: int) -> Callable[[DataFrame], DataFrame]:
    """The filter of one group; a placement that cannot be read leaves the last one in force."""
    last: list[Placement] = []

    def own(batch: DataFrame) -> DataFrame:
        try:
            last[:] = [placement()]
        except (OSError, ValueError):
            if not last:
                raise
        return last[0].owned(batch, group)

    return own


def evict_unowned(store: DocumentStore, placement: Placement, group: int) -> int:
    """Maintenance: drops documents of virtual shards that other groups own; how many."""
    docs = store.read()
    own = placement.owned(docs, group)
    n = docs.count() - own.count()
    if n:
        store.replace_all(own)
    return n


def windowed_counts(events: DataFrame, time: str, window: str, *by: str, late: str = "10 minutes") -> DataFrame:
    """window_start, by..., count: tumbling counts with a watermark. time may be a timestamp without zone, read as UTC."""
    stamped = events.withColumn("_t", F.col(time).cast("timestamp"))
    stamped = stamped.withWatermark("_t", late) if events.isStreaming else stamped
    out = stamped.groupBy(F.window("_t", window).alias("_w"), *by).agg(F.count("*").alias("count"))
    return out.select(F.col("_w.start").alias("window_start"), *by, "count")
