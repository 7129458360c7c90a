"""Extensions for streams; none of them stands for something that the batch operators leave out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, ts: str, kind: str, value: str, *, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """start, kind, n, total by event-time window; events later than ``late`` are left out of a stream."""
    w = F.window(ts, window)
    return events.withWatermark(ts, late).groupBy(w.alias("w"), kind).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), kind, "n", "total")


def sessions(events: DataFrame, ts: str, user: str, *, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """user, start, end, n of runs of events less than ``gap`` apart."""
    w = F.session_window(ts, gap)
    return events.withWatermark(ts, late).groupBy(w.alias("w"), user).agg(F.count("*").alias("n")).select(user, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
