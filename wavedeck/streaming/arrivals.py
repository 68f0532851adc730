"""Arriving calls against the prepared snapshots: a stream-static join, and counts by event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import normalize as N


def enriched(arrivals: DataFrame, static: DataFrame, call: str = "call") -> DataFrame:
    """A stream (or table) of calls with the static side's columns; the static side is read anew by each batch."""
    return arrivals.withColumn("_call", N.callsign(F.col(call))).join(static.withColumnRenamed(call, "_call"), "_call", "left").drop("_call")


def lookups_per_window(arrivals: DataFrame, at: str = "ts", late: str = "10 minutes", length: str = "5 minutes") -> DataFrame:
    """Lookups by window of event time and call; a window is closed once the watermark has passed it."""
    return arrivals.withWatermark(at, late).groupBy(F.window(at, length), "call").agg(F.count("*").alias("lookups"))
