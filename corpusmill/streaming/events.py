"""Streams over logs and arriving documents. Extensions: windows with watermarks, states of jobs, replace-by-document ingest."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.quality import with_quality

#: How late an event may be.
LATE = "1 hour"


def _timed(events: DataFrame, late: str) -> DataFrame:
    own = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return own.withWatermark("ts", late) if events.isStreaming else own


def windowed(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = LATE, value_col: str = "value") -> DataFrame:
    """(window_start, event_type, n, total) of tumbling windows, or sliding ones; the same for a stream and a table."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    out = _timed(events, late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(value_col).alias("total"))
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = LATE) -> DataFrame:
    """(user_id, session_start, session_end, n): events of a user not more than gap apart."""
    out = _timed(events, late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("session_start"), F.col("w.end").cast("timestamp_ntz").alias("session_end"), "n")


def ingest(documents: DataFrame, write: Callable[[DataFrame], None], checkpoint: str, text_col: str = "text"):
    """A query that scores arriving documents and hands each batch to write, for example Store.replace; once for what is there."""

    def batch(frame: DataFrame, _: int) -> None:
        write(with_quality(frame, text_col))

    return documents.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
