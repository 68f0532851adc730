"""Ordered merge of several sources' records into one: the first non-empty value wins, with exceptions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_filled(c: str, seq: Column) -> Column:
    """The value with the lowest seq that is neither null nor empty."""
    good = F.col(c).isNotNull() & (F.col(c) != "")
    return F.min_by(F.when(good, F.col(c)), F.when(good, seq))


def merged_last_name(seq: Column) -> tuple[list[Column], Column]:
    """Aggregates and the result: a later record with a last name and a first or middle name replaces the
    last name, once a first name was seen up to it; else the first one stays. The last such record decides
    whether there is any, as both conditions are lower bounds of seq."""
    filled = lambda c: F.col(c).isNotNull() & (F.col(c) != "")
    renames = filled("last_name") & (filled("first_name") | filled("middle_name"))
    parts = [
        first_filled("last_name", seq).alias("_last"), F.max_by("last_name", F.when(renames, seq)).alias("_late"), F.max(F.when(renames, seq)).alias("_late_at"),
        F.min(F.when(filled("first_name"), seq)).alias("_first_at"), F.min(seq).alias("_begin"),
    ]
    late = (F.col("_late_at") > F.col("_begin")) & (F.col("_late_at") >= F.col("_first_at"))
    return parts, F.when(late, F.col("_late")).otherwise(F.col("_last"))


def merge(records: DataFrame, keys: Sequence[str], seq: str, fields: Sequence[str], arrays: Sequence[str] = (), maps: Sequence[str] = (), sources: str | None = None) -> DataFrame:
    """One record per key, in one partial aggregation: fields and non-empty arrays from the first record that
    has them, maps' entries from the last one, sources as a sorted set.

    last_name follows its own rule where first_name, middle_name and last_name are among the fields; a
    jurisdiction among the fields is filled only while it is unknown.
    """
    at = F.col(seq)
    aggregates, picked = [], []
    for c in fields:
        if c == "last_name" and {"first_name", "middle_name"} <= set(fields):
            parts, result = merged_last_name(at)
            aggregates += parts
            picked.append(result.alias(c))
        elif c == "jurisdiction":
            good = F.col(c) != "unknown"
            aggregates.append(F.coalesce(F.min_by(F.when(good, F.col(c)), F.when(good, at)), F.lit("unknown")).alias(c))
            picked.append(F.col(c))
        else:
            aggregates.append(first_filled(c, at).alias(c))
            picked.append(F.col(c))
    for c in arrays:
        good = F.size(F.coalesce(F.col(c), F.array().cast(records.schema[c].dataType))) > 0
        aggregates.append(F.min_by(F.when(good, F.col(c)), F.when(good, at)).alias(c))
        picked.append(F.col(c))
    for c in maps:
        # a group has one row per source record of one call and year: a handful
        entries = F.flatten(F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct(at.alias("s"), F.map_entries(c).alias("e"))))), lambda x: x["e"]))
        aggregates.append(entries.alias(c))
        keys_of = F.array_distinct(F.transform(F.col(c), lambda e: e["key"]))
        last = F.transform(keys_of, lambda k: F.struct(k.alias("key"), F.element_at(F.filter(F.col(c), lambda e: e["key"] == k), -1)["value"].alias("value")))
        picked.append(F.map_from_entries(last).alias(c))
    if sources:
        aggregates.append(F.array_sort(F.collect_set(sources)).alias(sources))
        picked.append(F.col(sources))
    return records.groupBy(*keys).agg(*aggregates).select(*keys, *picked)
