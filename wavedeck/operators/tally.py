"""Tallies of calls by country: runs of consecutive equal countries, totals, and differences between tallies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def islands(rows: DataFrame, part: str = "part") -> DataFrame:
    """rows(call, country, part) in call order -> runs of consecutive rows of one country: run_no, country,
    calls, first_call, last_call. part: a prefix of the call that orders as the call does; windows run within
    parts, and runs that touch at a part's border are joined over a table of runs."""
    w = W.partitionBy(part).orderBy("call")
    new = F.coalesce((F.col("country") != F.lag("country").over(w)).cast("int"), F.lit(1))
    marked = rows.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    runs = marked.groupBy(part, "_run", "country").agg(F.count("*").alias("calls"), F.min("call").alias("first_call"), F.max("call").alias("last_call"))
    # only the first run of a part can go on from the part before
    edges = runs.groupBy(part).agg(F.max_by("country", "_run").alias("_end"))
    before = edges.select(F.col(part), F.lag("_end").over(W.orderBy(part)).alias("_before"))
    starts = runs.join(before, part).withColumn("_starts", F.when((F.col("_run") == 1) & (F.col("country") == F.col("_before")), 0).otherwise(1))
    totals = starts.groupBy(part).agg(F.sum("_starts").alias("_n"))
    offsets = totals.select(part, (F.sum("_n").over(W.orderBy(part)) - F.col("_n")).alias("_offset"))
    numbered = starts.join(offsets, part).withColumn("run_no", F.col("_offset") + F.sum("_starts").over(W.partitionBy(part).orderBy("_run")))
    return numbered.groupBy("run_no", "country").agg(F.sum("calls").alias("calls"), F.min("first_call").alias("first_call"), F.max("last_call").alias("last_call"))


def totals(runs: DataFrame) -> DataFrame:
    """Runs added up by country: runs, calls, and the last run's last call."""
    return runs.groupBy("country").agg(F.count("*").alias("runs"), F.sum("calls").alias("calls"), F.max_by("last_call", "run_no").alias("last_call"))


def differences(left: DataFrame, right: DataFrame, keys: tuple[str, ...] = ("country",)) -> DataFrame:
    """Full outer difference of two tallies: their calls, 0 where one lacks the key, and the delta."""
    both = left.select(*keys, F.col("calls").alias("left_calls")).join(right.select(*keys, F.col("calls").alias("right_calls")), list(keys), "full")
    filled = both.select(*keys, *(F.coalesce(c, F.lit(0)).alias(c) for c in ("left_calls", "right_calls")))
    return filled.withColumn("delta", F.col("left_calls") - F.col("right_calls"))


def largest_gaps(diffs: DataFrame, k: int) -> DataFrame:
    return diffs.orderBy(F.abs("delta").desc(), "country").limit(k)
