"""Country rules, their classification with fallback and centroids, and the catalog's statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import normalize as N
from .rangejoin import classify, ranked
from .sizes import broadcast_if_small


def parse_rules(lines: DataFrame, source: str) -> DataFrame:
    """lines(line_no, line) -> start, end (upper case), the country's fields, source, line_no. Comment lines, short lines
    and lines without start, end or name are left out. A name ends at the first of !@#$%^ or before a blank and a bracket."""
    rest = N.trim_unicode(F.substring("line", 13, 100_000))
    name = N.trim_unicode(F.regexp_extract(rest, r"\A(.*?)(?: \[|[!@#$%^]|\z)", 1))
    cut = lines.where((F.length("line") >= 12) & ~F.col("line").startswith("#")).select(
        "line_no", F.upper(N.trim_unicode(F.substring("line", 1, 6))).alias("start"), F.upper(N.trim_unicode(F.substring("line", 7, 6))).alias("end"), name.alias("name"), N.blank_to_null(N.trim_unicode(F.regexp_extract(rest, r"\A.*? \[([^\]]*)\]", 1))).alias("code"),
        N.tag_int(rest, "!").alias("itu"), N.tag_int(rest, "@").alias("cq"), N.tag_value(rest, "#").alias("continent"), N.tag_float(rest, "$").alias("lat"), N.tag_float(rest, "%").alias("lon"), N.tag_int(rest, "^").alias("number"),
    )
    good = cut.where("start <> '' and end <> '' and name <> ''")
    return good.withColumn("cleaned_name", N.clean_label(F.col("name"))).withColumn("source", F.lit(source)).withColumn("jurisdiction", N.rule_jurisdiction(F.col("code"), F.col("name")))


def parse_centroids(lines: DataFrame) -> DataFrame:
    """`NAME (lat, lon)` lines: name in upper case, lat, lon within their ranges; of equal names the last."""
    last = r"\A(.*)\(([^()]*),([^(),]*)\)[^()]*\z"
    got = lines.select("line_no", F.upper(N.trim_ascii(F.regexp_extract("line", last, 1))).alias("name"), N.number(N.trim_ascii(F.regexp_extract("line", last, 2))).alias("lat"), N.number(N.trim_ascii(F.regexp_extract("line", last, 3))).alias("lon"))
    good = got.where("name <> '' and lat between -90 and 90 and lon between -180 and 180")
    return good.groupBy("name").agg(F.max_by("lat", "line_no").alias("lat"), F.max_by("lon", "line_no").alias("lon"))


def country_info(calls: DataFrame, primary: DataFrame, fallback: DataFrame | None = None, centroids: DataFrame | None = None, call: str = "call") -> DataFrame:
    """Each distinct call with its country: by the primary rules, else by the fallback's; missing coordinates from the centroids."""
    rules = primary.withColumn("src", F.lit(0))
    if fallback is not None:
        rules = rules.unionByName(fallback.withColumn("src", F.lit(1)))
    found = classify(calls, ranked(rules, "src").drop("src"), call)
    if centroids is None:
        return found
    at = broadcast_if_small(centroids.select(F.upper(F.trim("name")).alias("_name"), F.col("lat").alias("_lat"), F.col("lon").alias("_lon")))
    joined = found.join(at, F.upper(F.trim("name")) == F.col("_name"), "left")
    return joined.withColumn("lat", F.coalesce("lat", "_lat")).withColumn("lon", F.coalesce("lon", "_lon")).drop("_name", "_lat", "_lon")


def catalog_statistics(rules: DataFrame) -> DataFrame:
    """Per source: rules, ranges among them, distinct raw and cleaned labels, rules with coordinates."""
    return rules.groupBy("source").agg(
        F.count("*").alias("rules"), F.count_if(F.col("start") != F.col("end")).alias("ranges"), F.countDistinct("name").alias("raw_labels"),
        F.countDistinct(N.grouping_label(F.col("cleaned_name"), F.col("name"))).alias("cleaned_labels"), F.count_if(F.col("lat").isNotNull() & F.col("lon").isNotNull()).alias("located"),
    )


def apply_country(records: DataFrame, primary: DataFrame) -> DataFrame:
    """records(callsign, country, state_or_province, postal_code) with country filled and jurisdiction: a missing country
    comes from the primary rules; without a rule, a state and a postal code mean the United States."""
    rules = country_info(records.where("country is null").select(F.col("callsign").alias("call")), primary)
    found = records.join(rules.select(F.col("call").alias("callsign"), F.col("name").alias("_name"), F.col("jurisdiction").alias("_jurisdiction")), "callsign", "left")
    own = N.record_jurisdiction(F.col("country"))
    american = F.col("state_or_province").isNotNull() & F.col("postal_code").isNotNull()
    told = F.coalesce(own, F.when(F.col("country").isNull(), F.col("_jurisdiction")), F.when(american, "united_states"), F.lit("unknown"))
    return found.withColumn("jurisdiction", told).withColumn("country", F.coalesce("country", "_name")).drop("_name", "_jurisdiction")
