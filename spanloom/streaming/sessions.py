"""Streams: gap sessions with late data, and annotating documents as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_sessions(stream: DataFrame, key: str, time: str, gap: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """SEG7 on a stream: counts of sessions that a gap of at least ``gap`` ends.

    State is dropped once the watermark has passed a session's end, so it is
    bounded by the keys active within ``late``.  Session windows end at a gap of
    exactly ``gap``; ``segment.gap_sessions`` is strict and goes on there.
    """
    window = F.session_window(time, gap)
    return stream.withWatermark(time, late).groupBy(window.alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def annotate_stream(stream: DataFrame, annotate: Callable[[DataFrame], DataFrame], path: str, checkpoint: str):
    """Micro-batches of documents through an annotator, each written once under its batch number.

    A batch that is retried after a failure overwrites its own folder, so rows
    are never written twice.
    """

    def write(batch: DataFrame, number: int) -> None:
        annotate(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()
