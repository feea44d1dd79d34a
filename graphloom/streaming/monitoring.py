"""Streams: watchers over arriving triples, and windowed counts with late data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from graphloom.graph import Graph
from graphloom.operators.lifecycle import Monitor


def watch_stream(triples: DataFrame, load: Callable[[], Graph], monitor: Monitor, on_result: Callable[[dict], None], checkpoint: str, interval: str = "30 seconds", once: bool = False) -> StreamingQuery:
    """Run the monitor for every micro-batch of a streaming (s, p, o) frame over load() plus the batch; skipped without watchers."""

    def each(batch: DataFrame, _: int) -> None:
        if monitor.watchers:
            on_result(monitor.run(load().add(batch))[0])

    writer = triples.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()


def windowed_counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes", time_col: str = "ts", key: str = "event_type", value: str = "value") -> DataFrame:
    """(start, key, n, total) of tumbling windows; events later than the watermark are left out of a stream's results."""
    ts = F.col(time_col).cast("timestamp")
    timed = events.withColumn("__ts", ts)
    if timed.isStreaming:
        timed = timed.withWatermark("__ts", late)
    return timed.groupBy(F.window("__ts", window).alias("w"), key).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), key, "n", "total")
