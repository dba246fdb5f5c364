"""Group sums over a stream of counts: the grouped sum is the one operator whose state is small enough to keep."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def sums_by_cluster(counts: DataFrame, cells: DataFrame) -> DataFrame:
    """(feature_id, z, n) of a stream of counts (feature_id, cell_id, n) with fixed labels; negative counts take back."""
    return counts.join(cells.select("cell_id", "z"), "cell_id").groupBy("feature_id", "z").agg(F.sum("n").alias("n"))


def windowed_counts(events: DataFrame, time: str, window: str, late: str) -> DataFrame:
    """(start, feature_id, cell_id, n) of a stream of events that each count one, by time window; events later than
    `late` are dropped, and windows that are past it leave the state."""
    w = events.withWatermark(time, late).groupBy(F.window(time, window), "feature_id", "cell_id").agg(F.count("*").alias("n"))
    return w.select(F.col("window.start").alias("start"), "feature_id", "cell_id", "n")


def to_table(stream: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> StreamingQuery:
    """Run a stream over what there is now, into an in-memory table."""
    return stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
