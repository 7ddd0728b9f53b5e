"""Streams: detection and rewriting are stateless, so a stream is a batch that goes on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.detect import detect, redact, sanitize


def sanitize_stream(stream: DataFrame, text_col: str = "text", mode: str = "redact", **options) -> DataFrame:
    """sanitize() on a streaming DataFrame; every document stands for itself."""
    return sanitize(stream, text_col, mode, **options)


def redact_stream(stream: DataFrame, text_col: str = "text", **options) -> DataFrame:
    return redact(detect(stream, text_col, **options), text_col)


def counts_by_window(
    stream: DataFrame, time_col: str, kind_col: str, width: str = "5 minutes", late: str = "10 minutes"
) -> DataFrame:
    """Rows by tumbling window and kind; rows later than the watermark are left out."""
    rows = stream.withWatermark(time_col, late) if stream.isStreaming else stream
    rows = rows.groupBy(F.window(time_col, width).alias("w"), kind_col).agg(F.count("*").alias("n"))
    return rows.select(F.col("w.start").alias("window_start"), kind_col, "n")


def write_stream(stream: DataFrame, path: str, checkpoint: str, trigger: str | None = None) -> StreamingQuery:
    """Append to Parquet files, exactly once; without a trigger, what is there now is written and the query ends."""
    w = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=trigger) if trigger else w.trigger(availableNow=True)).start()
