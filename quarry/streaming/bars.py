"""Price bars on a tick stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bar_stream(ticks: DataFrame, width: str = "1 minute", lateness: str = "1 hour") -> DataFrame:
    """Bars per symbol and window for append output.

    A window is emitted when the watermark has passed its end; ticks later than
    `lateness` are dropped. Windows that are still open stay unemitted.
    """
    timed = ticks.withColumn("time", F.col("time").cast("timestamp")).withWatermark("time", lateness)
    bars = timed.groupBy(F.window("time", width).alias("w"), "symbol").agg(
        F.min_by("price", "time").alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", "time").alias("close"),
        F.sum("volume").alias("volume"),
    )
    return bars.select("symbol", F.col("w.start").alias("time"), "open", "high", "low", "close", "volume")


def write_bars(bars: DataFrame, path: str, checkpoint: str, once: bool = True):
    writer = bars.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    writer = writer.outputMode("append")
    query = (writer.trigger(availableNow=True) if once else writer).start()
    if once:
        query.awaitTermination()
    return query
