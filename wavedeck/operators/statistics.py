"""Whole-corpus statistics: partial aggregates and distinct counts, never a collected group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import normalize as N

JURISDICTIONS = ("united_states", "canada", "international", "unknown")


def by_jurisdiction(rows: DataFrame, prefix: str) -> list[Column]:
    return [F.count_if(F.col("jurisdiction") == j).alias(f"{prefix}_{j}") for j in JURISDICTIONS]


def record_statistics(index: DataFrame, current: DataFrame) -> DataFrame:
    """index(call, vintage, jurisdiction), current(call): distinct current calls by jurisdiction, the index's before the
    current records', which count as United States; archive rows by jurisdiction; their sum as total."""
    listed = index.where("vintage is null").select("call", "jurisdiction", F.lit(0).alias("src"))
    both = listed.unionByName(current.select("call", F.lit("united_states").alias("jurisdiction"), F.lit(1).alias("src")))
    first = both.groupBy("call").agg(F.min_by("jurisdiction", "src").alias("jurisdiction"))
    now = first.agg(F.count("*").alias("current_total"), *by_jurisdiction(first, "current"))
    old = index.where("vintage is not null")
    then = old.agg(F.count("*").alias("archive_total"), *by_jurisdiction(old, "archive"))
    both = now.unionByName(then, allowMissingColumns=True).agg(*(F.coalesce(F.max(c), F.lit(0)).alias(c) for c in [*now.columns, *then.columns]))
    return both.withColumn("total", F.col("current_total") + F.col("archive_total"))


def archive_years(index: DataFrame) -> DataFrame:
    old = index.where("vintage is not null")
    return old.groupBy("vintage").agg(F.count("*").alias("rows_"), *by_jurisdiction(old, "archive"))


def posting_statistics(postings: DataFrame) -> DataFrame:
    """postings(header_key, year, dat_offset) of call headers: postings and distinct offsets, per year and over all years
    (a distinct count over all isn't the sum of the years'), and of current headers."""
    calls = postings.where(N.is_call_header(F.col("header_key"))).withColumn("archive", F.col("year").isNotNull())
    kept = calls.where("not archive or year between 1900 and 2099")
    sets = kept.groupingSets([["archive", "year"], ["archive"]], "archive", "year").agg(F.grouping_id("archive", "year").alias("g"), F.count("*").alias("postings"), F.countDistinct("dat_offset").alias("offsets"))
    return sets.where("g = 0 and archive or g = 1").select(F.when(F.col("g") == 0, F.col("year")).alias("year"), "archive", "postings", "offsets")


def marketed_years(per_year: DataFrame, years: tuple[int, ...]) -> DataFrame:
    return per_year.where(F.col("year").isin(*years)).agg(F.coalesce(F.sum("offsets"), F.lit(0)).alias("offsets"))


def interest_statistics(records: DataFrame, catalog: DataFrame) -> DataFrame:
    """records(call, vintage, codes array): distinct current calls with codes and with known codes, and snapshots with them."""
    known = catalog.select("code").distinct().withColumn("known", F.lit(True))
    each = records.where(F.size("codes") > 0).select("call", "vintage", "pos", F.explode("codes").alias("code")).join(known, "code", "left")
    per = each.groupBy("call", "vintage", "pos").agg(F.coalesce(F.bool_or("known"), F.lit(False)).alias("known"))
    return per.agg(
        F.countDistinct(F.when(F.col("vintage").isNull(), F.col("call"))).alias("current_calls"), F.countDistinct(F.when(F.col("vintage").isNull() & F.col("known"), F.col("call"))).alias("current_known"),
        F.count("*").alias("snapshots"), F.count_if("known").alias("snapshots_known"), F.count_if(F.col("vintage").isNotNull()).alias("archive_snapshots"),
    )


def first_distinct(rows: DataFrame, group: str, value: str, order: str, n: int = 3) -> DataFrame:
    """Per group the first n distinct values by order, joined by a bar: values are made distinct first, and only
    ranks up to n leave a partition."""
    once = rows.groupBy(group, value).agg(F.min(order).alias("_at"))
    ranked = once.withColumn("_r", F.row_number().over(W.partitionBy(group).orderBy("_at", value))).where(F.col("_r") <= n)
    return ranked.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", F.col(value).alias("v")))), lambda x: x["v"]), "|").alias("samples"))


def unknown_codes(records: DataFrame, catalog: DataFrame, n: int = 3) -> DataFrame:
    """Codes that the catalog lacks: occurrences in all, current and archive records, and the first calls that have them."""
    each = records.select("call", "vintage", "pos", F.explode("codes").alias("code")).join(catalog.select("code").distinct(), "code", "left_anti")
    counts = each.groupBy("code").agg(F.count("*").alias("total"), F.count_if(F.col("vintage").isNull()).alias("current"), F.count_if(F.col("vintage").isNotNull()).alias("archive"))
    return counts.join(first_distinct(each, "code", "call", "pos", n), "code")


def search_code(records: DataFrame, code: str) -> DataFrame:
    """Calls and vintages that have a code, once each; current: whether it is the current record."""
    return records.where(F.array_contains("codes", code)).select("call", "vintage", F.col("vintage").isNull().alias("current")).distinct()


def tag_statistics(tags: DataFrame, n: int = 3) -> DataFrame:
    """tags(tag, value, vintage, pos): occurrences, in current and archive records, and the first distinct values."""
    counts = tags.groupBy("tag").agg(F.count("*").alias("occurrences"), F.count_if(F.col("vintage").isNull()).alias("current"), F.count_if(F.col("vintage").isNotNull()).alias("archive"))
    return counts.join(first_distinct(tags, "tag", "value", "pos", n), "tag", "left").withColumn("field", N.tag_name(F.col("tag")))


def posting_starts(postings: DataFrame, records: DataFrame, size: int, n: int = 20) -> tuple[DataFrame, DataFrame]:
    """How many postings stand on a record's start, elsewhere, or beyond the file; and the first n that don't stand on one."""
    starts = records.select(F.col("rec_start").alias("dat_offset")).distinct().withColumn("starts", F.lit(True))
    told = postings.join(starts, "dat_offset", "left").withColumn("kind", F.when(F.col("dat_offset") >= size, "out_of_bounds").when(F.col("starts"), "record_start").otherwise("elsewhere"))
    return told.groupBy("kind").agg(F.count("*").alias("postings")), told.where("kind <> 'record_start'").orderBy("ordinal", "posting_no", "dat_offset").limit(n)


def monotonic(rows: DataFrame, order: str, key: str, offset: str, part: str) -> DataFrame:
    """Rows whose key isn't above, or whose offset is below, the row before. part: a coarse group of the order, so that no
    window spans all rows; the first row of a part is compared with the last of the part before."""
    w = W.partitionBy(part).orderBy(order)
    own = rows.select(part, order, key, offset, F.lag(key).over(w).alias("_key"), F.lag(offset).over(w).alias("_off"))
    lasts = rows.groupBy(part).agg(F.max_by(F.struct(F.col(key).alias("k"), F.col(offset).alias("o")), order).alias("last"))
    before = lasts.select(part, F.lag("last").over(W.orderBy(part)).alias("before"))
    full = own.join(before, part).select(key, offset, F.coalesce("_key", "before.k").alias("_key"), F.coalesce("_off", "before.o").alias("_off"))
    return full.agg(F.count("*").alias("rows_"), F.count_if(F.col(key) <= F.col("_key")).alias("key_order_violations"), F.count_if(F.col(offset) < F.col("_off")).alias("offset_violations"), F.min(key).alias("lowest"), F.max(key).alias("highest"))


def index_verification(index: DataFrame) -> DataFrame:
    """The text index's checks: monotonic keys and offsets, non-ASCII characters, lines that don't parse.
    index(line_no, key, dat_offset, line, parsed)."""
    parts = index.withColumn("part", F.floor(F.col("line_no") / 65_536))
    rest = index.agg(F.sum(F.length(F.regexp_replace("line", r"[\x00-\x7F]", ""))).alias("non_ascii"), F.count_if(~F.col("parsed")).alias("unparsed"))
    good = monotonic(parts.where("parsed"), "line_no", "key", "dat_offset", "part")
    return good.withColumn("one", F.lit(1)).join(rest.withColumn("one", F.lit(1)), "one").drop("one")


def entry_lengths(entries: DataFrame) -> DataFrame:
    """The inverted index's checks: entries(ordinal, hci_offset, raw_len, terminated)."""
    parts = entries.withColumn("part", F.floor(F.col("ordinal") / 65_536))
    order = monotonic(parts, "ordinal", "ordinal", "hci_offset", "part").select(F.col("offset_violations"))
    rest = entries.agg(F.count("*").alias("entries"), F.count_if(F.col("raw_len") == 0).alias("empty"), F.count_if(F.col("raw_len").isNull()).alias("out_of_bounds"), F.min("raw_len").alias("shortest"), F.max("raw_len").alias("longest"))
    return rest.withColumn("one", F.lit(1)).join(order.withColumn("one", F.lit(1)), "one").drop("one")
