"""Prefix, range and interval joins as equi-joins with a residual condition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sizes import broadcast_if_small


def range_matches(call: Column, start: Column, end: Column) -> Column:
    """A rule with start = end is a prefix; another compares the first w characters, w: the longer bound's length,
    at most the call's."""
    w = F.least(F.greatest(F.length(start), F.length(end)), F.length(call))
    head = lambda c: F.substring(c, F.lit(1), w)
    return F.when(start == end, call.startswith(start)).otherwise((head(call) >= head(start)) & (head(call) <= head(end)))


def ranked(rules: DataFrame, *before: str) -> DataFrame:
    """rules(start, end, line_no, ...) with rule_rank: longer starts first, then by start, then as listed."""
    order = F.struct(*before, (-F.length("start")).alias("longest"), "start", "line_no")
    return rules.withColumn("rule_rank", order)


def classify(calls: DataFrame, rules: DataFrame, call: str = "call") -> DataFrame:
    """Each distinct call with the fields of its first matching rule, null without one.

    Rules are spread over the first characters they can match, so a call meets a few by an equi-join; the first by
    rank is a partial aggregate.
    """
    fields = [c for c in rules.columns if c not in ("start", "end", "line_no", "rule_rank")]
    first = F.sequence(F.ascii("start"), F.greatest(F.ascii("end"), F.ascii("start")))
    spread = rules.withColumn("first", F.explode(F.when(F.col("start") == F.col("end"), first).otherwise(F.concat(F.array(F.lit(-1)), first))))
    wanted = calls.select(F.col(call).alias("call")).distinct().withColumn("first", F.when(F.col("call") == "", -1).otherwise(F.ascii("call")))
    met = wanted.join(broadcast_if_small(spread), "first").where(range_matches(F.col("call"), F.col("start"), F.col("end")))
    best = met.groupBy("call").agg(F.min(F.struct("rule_rank", *fields)).alias("best")).select("call", *(F.col(f"best.{f}").alias(f) for f in fields))
    return wanted.select("call").join(best, "call", "left").withColumnRenamed("call", call)


def containing(points: DataFrame, intervals: DataFrame, at: str, start: str, end: str, width: int = 65_536) -> DataFrame:
    """points joined to the intervals [start, end) that hold `at`: both by buckets of `width`, an interval in
    every bucket that it touches; points without one stay, with nulls."""
    spread = intervals.withColumn("_b", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor((F.greatest(F.col(end), F.col(start) + 1) - 1) / width))))
    on = (F.col("_p") == F.col("_b")) & (F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))
    return points.withColumn("_p", F.floor(F.col(at) / width)).join(spread, on, "left").drop("_p", "_b")


def within(points: DataFrame, starts: DataFrame, at: str, start: str, reach: int) -> DataFrame:
    """points joined to the records that start in [at, at + reach): two buckets a point."""
    b = F.floor(F.col(at) / reach)
    spread = points.withColumn("_p", F.explode(F.array(b, b + 1)))
    on = (F.col("_p") == F.col("_b")) & (F.col(start) >= F.col(at)) & (F.col(start) < F.col(at) + reach)
    return spread.join(starts.withColumn("_b", F.floor(F.col(start) / reach)), on).drop("_p", "_b")
