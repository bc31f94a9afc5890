"""Gap clusters of a stream: an extension of the batch operator, not a parity claim."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def gap_sessions(events: DataFrame, gap: str = "6 hours", late: str = "1 day", ts: str = "ts", key: str = "user_id", value: str = "value") -> DataFrame:
    """Runs of a key's events no further apart than ``gap``: start, end, count, sum.

    Works on batch and streaming frames; on a stream, sessions close ``late`` behind
    the newest event and state is kept only for open ones.
    """
    e = events.withColumn("__t", F.col(ts).cast("timestamp"))
    if e.isStreaming:
        e = e.withWatermark("__t", late)
    g = e.groupBy(key, F.session_window("__t", gap).alias("w")).agg(F.min("__t").alias("start"), F.max("__t").alias("end"), F.count("*").alias("n"), F.sum(value).alias("total"))
    return g.select(key, "start", "end", "n", "total")
