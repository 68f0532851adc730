"""Broadcasts behind a check of the side's size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows, and bytes of them as JSON, up to which a dimension is broadcast.
MOST_ROWS, MOST_BYTES = 50_000, 16 << 20


def broadcast_if_small(df: DataFrame, most: int = MOST_ROWS) -> DataFrame:
    """The side with a broadcast hint if it has at most `most` rows of MOST_BYTES together, else as it is, for a shuffled join."""
    found = df.limit(most + 1).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0)).alias("size")).head()
    return F.broadcast(df) if found.n <= most and found.size <= MOST_BYTES else df
