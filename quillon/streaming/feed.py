"""Feeds into a ring and queries over it as it grows."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.windows import rolling
from ..sources.arrow_ipc import ArrowFileSource, arrow_to_table
from .ring import SEQ, Ring


def poll_arrow(spark: SparkSession, path: str, ring: Ring, checkpoint: str, interval: str | None = "100 milliseconds", on_batch: Callable[[int], None] | None = None) -> StreamingQuery:
    """Adds Arrow files of a folder to the ring as they come, each once. interval None: what is there
    now, then end. stop() of the returned query ends the feed."""
    spark.dataSource.register(ArrowFileSource)
    stream = spark.readStream.format("arrow_ipc").load(path)
    return ring.attach(stream, checkpoint, on_batch=on_batch, **({"processingTime": interval} if interval else {"availableNow": True}))


def feed_stream(source, ring: Ring, on_batch: Callable[[int], None] | None = None) -> int:
    """Adds the record batches of an Arrow IPC stream to the ring as they come, until its end, and returns the rows
    committed. source: bytes, a buffer or any readable object, such as a socket's file or a pipe; one batch at
    a time is held. on_batch gets the rows committed after each."""
    committed = ring.committed_rows()
    with pa.ipc.open_stream(source) as reader:
        for batch in reader:
            if not batch.num_rows:
                continue
            committed = ring.append(arrow_to_table(ring.spark, pa.Table.from_batches([batch])))
            if on_batch:
                on_batch(committed)
    return committed


def continuous_sma(ring: Ring, column: str, size: int) -> DataFrame | None:
    """The moving average over the ring's rows of now, or None while it has fewer than size."""
    if ring.num_rows() < size:
        return None
    return rolling(ring.snapshot(with_seq=True), SEQ, [("SMA", column, size, "sma")])


def latest(df: DataFrame, order: str = SEQ) -> DataFrame:
    return df.orderBy(F.desc(order)).limit(1)
