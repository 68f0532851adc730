"""Batch lookups: many calls at once against current records, the text index and the inverted index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import normalize as N
from .merge import merge
from .rangejoin import containing, within
from .sizes import broadcast_if_small


def exact(calls: DataFrame, current: DataFrame, how: str = "left") -> DataFrame:
    """calls(call) joined to current records by normalised key; how: left, left_semi (exists), left_anti (missing)."""
    keyed = current.withColumn("_key", N.lookup_key(F.col("callsign")))
    return calls.join(keyed, F.upper("call") == F.col("_key"), how).drop("_key")


def call_run(calls: DataFrame, index: DataFrame) -> DataFrame:
    """All index entries of each call, bare and with a year: an equi-join on the key's call, which leaves out
    neighbours such as CALL/1 and CALLX. seq orders a call's entries: without a year first."""
    own = index.withColumn("call", N.key_call(F.col("key"))).withColumn("vintage", N.key_vintage(F.col("key")))
    found = calls.select("call").distinct().join(own, "call")
    return found.withColumn("seq", F.row_number().over(W.partitionBy("call").orderBy(F.asc_nulls_first("vintage"), "key", "dat_offset")))


def next_offsets(index: DataFrame) -> DataFrame:
    """Each distinct key's offset and that of the next greater key.

    Keys are ordered by their first character's group, and a group's last key takes the next group's first, so no
    window spans the whole index.
    """
    keys = index.groupBy("key").agg(F.min("dat_offset").alias("dat_offset")).withColumn("g", F.substring("key", 1, 2))
    heads = keys.groupBy("g").agg(F.min(F.struct("key", "dat_offset")).alias("head"))  # at most 65536 rows
    follows = heads.select("g", F.lead("head.dat_offset").over(W.orderBy("g")).alias("beyond"))
    own = keys.withColumn("next", F.lead("dat_offset").over(W.partitionBy("g").orderBy("key")))
    return own.join(broadcast_if_small(follows, 1 << 16), "g").select("key", "dat_offset", F.coalesce("next", "beyond").alias("next_offset"))


def first_key_at_least(index: DataFrame, key: str) -> DataFrame:
    return index.where(F.col("key") >= key).agg(F.min(F.struct("key", "line_start")).alias("r")).select("r.*")


def slices(entries: DataFrame, size: int) -> DataFrame:
    """entries with the end of their slice: the next key's offset, at most the file's size; those that begin beyond are left out."""
    end = F.least(F.coalesce("next_offset", F.lit(size)), F.lit(size))
    return entries.withColumn("slice_end", end).where((F.col("dat_offset") < size) & (F.col("slice_end") >= F.col("dat_offset")))


def expand_keys(calls: DataFrame, years: list[int]) -> DataFrame:
    """The index keys to try per call, in order: CALL, CALL without its first character, then both with each year."""
    short = F.substring("call", 2, 100)
    plain = F.array(F.col("call"), short)
    dated = F.flatten(F.transform(F.array(*(F.lit(str(y)) for y in sorted(years))).cast("array<string>"), lambda y: F.array(F.concat("call", F.lit(":"), y), F.concat(short, F.lit(":"), y))))
    return calls.select("call", F.posexplode(F.concat(plain, dated)).alias("key_no", "key"))


def probe(keys: DataFrame, postings: DataFrame) -> DataFrame:
    """Postings of expanded keys, the first of each record offset per call, in order of key, entry, posting and offset."""
    # by a shuffle: the planner sees the size of the calls before they are expanded, and would broadcast all their keys
    found = keys.join(postings.withColumnRenamed("header_key", "key").hint("merge"), "key")
    order = F.struct("key_no", "ordinal", "posting_no")
    first = found.groupBy("call", "dat_offset").agg(F.min(F.struct(order.alias("o"), "key")).alias("m"))
    return first.select("call", "dat_offset", "m.key", F.row_number().over(W.partitionBy("call").orderBy("m.o", "dat_offset")).cast("long").alias("seq"))


def resolve_records(postings: DataFrame, records: DataFrame) -> DataFrame:
    """Each posting's record: the one that starts at its offset, else the one that holds it; how says which."""
    found = containing(postings, records, "dat_offset", "rec_start", "rec_end")
    return found.withColumn("how", F.when(F.col("rec_start") == F.col("dat_offset"), "posting_start").when(F.col("rec_start").isNotNull(), "containing").otherwise("none"))


#: Window sizes that are tried in turn after a posting without a matching record: complete records, then
#: in the last one any; fixed values.
WINDOWS = (1024, 2048, 4096, 8192)


def window_fallback(postings: DataFrame, records: DataFrame) -> DataFrame:
    """postings(call, dat_offset) with the matching records of the first window that has one: records of the same call
    that start in it and, but for the widest window, also end in it."""
    near = within(postings, records.withColumnRenamed("callsign", "rec_call"), "dat_offset", "rec_start", WINDOWS[-1]).where("rec_call = call")
    tier = F.when(F.lit(False), 0)
    for i, n in enumerate(WINDOWS[:-1]):
        tier = tier.when(F.col("rec_end") <= F.col("dat_offset") + n, i)
    tiered = near.withColumn("tier", tier.otherwise(len(WINDOWS) - 1))
    best = tiered.groupBy("call", "dat_offset").agg(F.min("tier").alias("tier"))
    return tiered.join(best, ["call", "dat_offset", "tier"])


def batch(calls: DataFrame, snapshots: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """One row per distinct call: status, the merged current record, the merged history by vintage, sorted.

    snapshots(callsign, vintage, seq, source, fields): all sources' records, seq: their precedence. A vintage of null
    is the current record. The join is shuffled once on the call and both merges are partial aggregates.
    """
    wanted = calls.select(F.col("call").alias("callsign")).distinct()
    met = snapshots.join(wanted, "callsign", "left_semi")
    merged = merge(met, ["callsign", "vintage"], "seq", fields, sources="source")
    body = F.struct("vintage", *fields, F.col("source").alias("sources"))
    grouped = merged.groupBy("callsign").agg(
        F.max(F.when(F.col("vintage").isNull(), body)).alias("current"), F.array_sort(F.collect_list(F.when(F.col("vintage").isNotNull(), body))).alias("history")
    )  # a call has a record per publication year at most
    out = wanted.join(grouped, "callsign", "left")
    history = F.coalesce("history", F.array().cast(grouped.schema["history"].dataType))
    return out.select(F.col("callsign").alias("call"), N.status(F.col("current").isNotNull(), F.size(history) > 0).alias("status"), "current", history.alias("history"))


def enumerate_calls(index: DataFrame, current: DataFrame) -> DataFrame:
    """All calls of the index and of the current records, once each; calls that only the inverted index has aren't
    among them. valid: whether a lookup would take it."""
    from_index = index.select(N.statistics_call(F.col("key")).alias("call")).where("call is not null")
    own = current.select(F.upper(N.trim_unicode(F.col("callsign"))).alias("call"))
    return from_index.unionByName(own).distinct().withColumn("valid", N.callsign(F.col("call")).isNotNull())
