"""Fixed windows over event streams: the streaming form of fixed segments. An extension; batch gives the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

FIGURES = ("n", "mean", "low", "high")


def _figures() -> list[Column]:
    return [c.alias(n) for n, c in zip(FIGURES, (F.count("*"), F.avg("value"), F.min("value"), F.max("value")), strict=True)]


def windowed(events: DataFrame, keys: list[str], window: str = "5 minutes", step: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Aggregates of `value` by key and window of `ts`. On a stream, rows later than `late` are dropped."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        rows = rows.withWatermark("ts", late)
    per = rows.groupBy(*keys, F.window("ts", window, step) if step else F.window("ts", window)).agg(*_figures())
    return per.select(*keys, F.col("window.start").alias("start"), F.col("window.end").alias("end"), *FIGURES)


def sessions(events: DataFrame, keys: list[str], gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """The same aggregates over sessions that end after a gap."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        rows = rows.withWatermark("ts", late)
    per = rows.groupBy(*keys, F.session_window("ts", gap)).agg(*_figures())
    return per.select(*keys, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *FIGURES)


def write_by_day(stream: DataFrame, path: str, checkpoint: str, column: str = "start") -> StreamingQuery:
    """Each batch rewrites the days it holds whole windows of, so a batch that is run again leaves nothing twice."""

    def put(batch: DataFrame, number: int) -> None:
        rows = batch.withColumns({"date": F.to_date(column), "batch": F.lit(number)})
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date", "batch").parquet(path)

    return stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(put).start()
