"""Station profiles: a star of left joins around looked-up calls, and the files that belong to a call."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import normalize as N
from .sizes import broadcast_if_small

#: Order of asset kinds; fixed values.
KINDS = ("biography", "photo", "flag", "map", "sidecar_data")


def kind_rank(kind):
    return F.array_position(F.array(*(F.lit(k) for k in KINDS)), kind)


def resolve_codes(records: DataFrame, catalog: DataFrame) -> DataFrame:
    """records(call, codes) -> call, interests: the catalog's entries of the codes it knows, in the codes' order."""
    each = records.select("call", F.posexplode("codes").alias("no", "code"))
    found = each.join(broadcast_if_small(catalog.dropDuplicates(["code"])), "code")
    return found.groupBy("call").agg(F.transform(F.array_sort(F.collect_list(F.struct("no", "code", "category", "label"))), lambda x: F.struct(x["code"].alias("code"), x["category"].alias("category"), x["label"].alias("label"))).alias("interests"))


def counts(calls: DataFrame, slots: DataFrame) -> DataFrame:
    """calls with their lookup count: stored keys are compared as they stand with the call in upper case."""
    first = slots.groupBy("key").agg(F.min_by(F.struct("count", "updated", "status"), "slot_no").alias("s")).select("key", "s.*")
    return calls.join(first, F.upper(F.trim("call")) == F.col("key"), "left").drop("key")


def searchable_slots(slots: DataFrame) -> DataFrame:
    """slots(slot_no, key, ...) that a lookup can reach: all, or those between the sentinels where slot 0 is blank, slot 2
    all `!` and the last all `z`."""
    ends = slots.agg(F.max("slot_no").alias("n"), F.max(F.when(F.col("slot_no") == 0, F.col("key") == "")).alias("a"), F.max(F.when(F.col("slot_no") == 2, F.col("key").rlike(r"\A!+\z"))).alias("b"), F.max_by(F.col("key").rlike(r"\Az+\z"), "slot_no").alias("c")).head()
    marked = bool(ends.a and ends.b and ends.c)
    return slots.where((F.col("slot_no") >= 3) & (F.col("slot_no") < ends.n)) if marked else slots


def star(calls: DataFrame, status: DataFrame, country: DataFrame, count_slots: DataFrame, history: DataFrame, interests: DataFrame) -> DataFrame:
    """One row per call: status, country, count, interests, and its history's size and distinct sorted vintages."""
    years = history.groupBy("call").agg(F.count("*").alias("history_rows"), F.array_sort(F.collect_set("vintage")).alias("vintages"))
    joined = calls.select("call").distinct().join(status, "call", "left").join(country, "call", "left").join(interests, "call", "left").join(years, "call", "left")
    return counts(joined, count_slots).withColumn("history_rows", F.coalesce("history_rows", F.lit(0)))


def call_assets(calls: DataFrame, files: DataFrame) -> DataFrame:
    """files(path) of calls: biographies by their whole stem, photos by the start of it, upper case.

    The prefix join is an equi-join: a file's stem is spread over its prefixes.
    """
    stem = F.upper(F.regexp_extract("path", r"([^/]*?)(\.[^./]*)?\z", 1))
    kind = F.when(F.col("path").rlike(r"(?i)(^|/)bios/"), "biography").when(F.col("path").rlike(r"(?i)(^|/)photos/"), "photo")
    own = files.withColumn("kind", kind).where("kind is not null").withColumn("stem", stem).where("stem <> ''")
    prefixes = F.transform(F.sequence(F.lit(1), F.length("stem")), lambda n: F.substring("stem", F.lit(1), n))
    spread = own.withColumn("call", F.explode(F.when(F.col("kind") == "biography", F.array("stem")).otherwise(prefixes)))
    return spread.join(calls.select("call").distinct(), "call").select("call", "kind", "path", N.media_type(F.col("path")).alias("media_type"))


def country_assets(codes: DataFrame, files: DataFrame) -> DataFrame:
    """Flags and maps by country code: the stem before its first dash, upper case."""
    code = F.upper(F.split_part(F.regexp_extract("path", r"([^/]*?)(\.[^./]*)?\z", 1), F.lit("-"), F.lit(1)))
    kind = F.when(F.col("path").rlike(r"(?i)(^|/)flags/"), "flag").when(F.col("path").rlike(r"(?i)(^|/)maps/"), "map")
    own = files.withColumn("kind", kind).where("kind is not null").withColumn("code", code)
    return own.join(codes.select("code").distinct(), "code").select("code", "kind", "path", N.media_type(F.col("path")).alias("media_type"))


def in_order(assets: DataFrame) -> DataFrame:
    """assets(call, kind, path, ...), once each, with seq: a call's by the rank of their kind, then by path."""
    w = W.partitionBy("call").orderBy(kind_rank(F.col("kind")), "path")
    return assets.dropDuplicates(["call", "kind", "path"]).withColumn("seq", F.row_number().over(w).cast("long"))


def _located(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Manifest entries with a file (columns kept) and the path of each photo that they name: photos/<file> itself; only
    where that isn't there, any photo that has the name or, for a file with folders, ends with these parts, in any case."""
    photos = files.where(F.col("path").rlike(r"\Aphotos/")).select("path", F.lower("path").alias("_low"))
    name = F.regexp_extract("_low", r"([^/]*)\z", 1)
    wanted = manifest.where("file is not null").withColumn("_file", F.lower("file")).withColumn("_direct", F.concat(F.lit("photos/"), "file"))
    direct = wanted.join(photos.select("path"), F.col("_direct") == F.col("path"))
    rest = wanted.join(photos.select("path"), F.col("_direct") == F.col("path"), "left_anti")
    met = rest.withColumn("_name", F.regexp_extract("_file", r"([^/]*)\z", 1)).join(photos.withColumn("_name", name), "_name")
    found = met.where(F.concat(F.lit("/"), "_low").endswith(F.concat(F.lit("/"), F.col("_file"))))
    return direct.select(*manifest.columns, "path").unionByName(found.select(*manifest.columns, "path"))


def manifest_photos(calls: DataFrame, manifest: DataFrame, files: DataFrame) -> DataFrame:
    """call, kind, path, media_type of the photos that the manifest names for calls."""
    own = manifest.join(calls.select("call").distinct(), "call", "left_semi")
    return _located(own, files).select("call", F.lit("photo").alias("kind"), "path").distinct().withColumn("media_type", N.media_type(F.col("path")))


def parse_manifest(lines: DataFrame) -> DataFrame:
    """The photo manifest: call, then the first non-empty token; separators are white space, commas and bars; # comments."""
    tokens = F.filter(F.split("line", r"[\t\n\f\r ,|]+"), lambda t: t != "")
    return lines.where(~N.trim_ascii(F.col("line")).startswith("#")).withColumn("t", tokens).where(F.size("t") > 0).select("line_no", F.upper(F.col("t")[0]).alias("call"), N.safe_path(F.get("t", F.lit(1))).alias("file"))


def ranked_photos(photos: DataFrame, manifest: DataFrame) -> DataFrame:
    """photos(call, path), once each, with their rank: listed ones by their first place in the manifest, then the others by path."""
    once = photos.dropDuplicates(["call", "path"]).withColumn("name", F.lower(F.regexp_extract("path", r"([^/]*)\z", 1)))
    listed = manifest.where("file is not null").groupBy("call", F.lower(F.regexp_extract("file", r"([^/]*)\z", 1)).alias("name")).agg(F.min("line_no").alias("listed"))
    joined = once.join(listed, ["call", "name"], "left")
    w = W.partitionBy("call").orderBy(F.asc_nulls_last("listed"), "path")
    return joined.select("call", "path", "listed", F.row_number().over(w).cast("long").alias("photo_rank"))


def manifest_diagnostics(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Entries, those with a file, and those whose file is found or missing."""
    there = _located(manifest, files).select("line_no").distinct().withColumn("found", F.lit(True))
    told = manifest.join(there, "line_no", "left")
    return told.agg(F.count("*").alias("entries"), F.count("file").alias("with_file"), F.count_if("found").alias("found"), F.count_if(F.col("file").isNotNull() & F.col("found").isNull()).alias("missing"))
