"""One object over a station directory's files: every question takes many calls at once and gives a DataFrame."""

from __future__ import annotations

import functools
from collections.abc import Iterable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import normalize as N
from .functions.normalize import FIELDS
from .operators import country, layers, lookup, profile, statistics, tally
from .sources import files, tables
from .sources.records import read_postings, read_slices, read_windows


class DataPathNotFound(FileNotFoundError):
    pass


class NoDataFiles(FileNotFoundError):
    pass


class InvalidCallsign(ValueError):
    pass


#: Files of the layout by what they hold; fixed values.
LAYOUT = {
    "index": "hamcall.idx", "records": "hamcall.dat", "inverted": "hciindex.dat", "entries": "hci.dat", "current": "usa.csv.zip", "rules": "countrys", "rules_other": "gcmcountrys", "rules_fallback": "COUNTRYS.PC",
    "centroids": "countrys.nam", "interests": "interest", "counts": "counts.dat", "world": "wc.dat", "county": "cb.dat", "us_county": "USCOUN.DAT", "state": "state.dat", "manifest": "photos/PHOTOS.TXT",
}


#: Calls that are looked up one by one in the files instead of by joins with all records.
FEW_CALLS = 64


class Directory:
    """open(spark, path): the folder itself or one that has it as ham0 or HAM0. The index and the records must be there,
    all else may be missing."""

    def __init__(self, spark: SparkSession, path: str):
        tables.register(spark)
        self.spark = spark
        path = files.qualified(spark, path)
        store, at = files.filesystem(path)
        if store.get_file_info(at).type.name == "NotFound":
            raise DataPathNotFound(path)
        folders = [path, f"{path}/ham0", f"{path}/HAM0"]
        self.path = next((p for p in folders if all(self._there(f"{p}/{LAYOUT[x]}") for x in ("index", "records"))), None)
        if self.path is None:
            raise NoDataFiles(path)

    open = classmethod(lambda cls, spark, path: cls(spark, path))

    @staticmethod
    def _there(path: str) -> bool:
        store, at = files.filesystem(path)
        return store.get_file_info(at).type.name == "File"

    def sidecar_files(self) -> DataFrame:
        """The layout's files and whether each is there."""
        return self.spark.createDataFrame([(kind, name, self._there(f"{self.path}/{name}")) for kind, name in LAYOUT.items()], "kind string, path string, present boolean")

    def _load(self, source: str, kind: str, **options: str) -> DataFrame | None:
        path = f"{self.path}/{LAYOUT[kind]}"
        return self.spark.read.format(source).options(path=path, **options).load() if self._there(path) else None

    def _lines(self, kind: str) -> DataFrame:
        found = self._load("numbered_lines", kind)
        return found if found is not None else self.spark.createDataFrame([], "path string, line_no long, line string")

    def _calls(self, calls: DataFrame | str | Iterable[str]) -> DataFrame:
        if isinstance(calls, DataFrame):
            return calls.select(N.callsign(F.col("call")).alias("call")).where("call is not null")
        rows = [calls] if isinstance(calls, str) else list(calls)
        found = self.spark.createDataFrame([(c,) for c in rows], "raw string").withColumn("call", N.callsign(F.col("raw")))
        if isinstance(calls, str) and found.head().call is None:
            raise InvalidCallsign(calls)
        return found.where("call is not null").select("call")

    # --- relations -----------------------------------------------------------------------------------
    @cached_property
    def index(self) -> DataFrame:
        return self._load("text_index", "index")

    @property
    def record_path(self) -> str:
        return f"{self.path}/{LAYOUT['records']}"

    @cached_property
    def records(self) -> DataFrame:
        return self._load("tagged_records", "records")

    @cached_property
    def inverted(self) -> DataFrame:
        entries = f"{self.path}/{LAYOUT['entries']}"
        found = self._load("inverted_index", "inverted", entries=entries) if self._there(entries) else None
        return found if found is not None else self.spark.createDataFrame([], "path string, ordinal long, hci_offset long, raw_len long, header_key string, year int, header_len int, terminated boolean, postings array<struct<posting_no: long, dat_offset: long, position: int>>")

    @cached_property
    def postings(self) -> DataFrame:
        full = F.when(F.col("year").isNull(), F.col("header_key")).otherwise(F.concat("header_key", F.lit(":"), F.col("year").cast("string")))
        return self.inverted.select("ordinal", full.alias("full_key"), "header_key", "year", F.explode("postings").alias("p")).select("ordinal", "full_key", "header_key", "year", "p.*")

    @cached_property
    def current(self) -> DataFrame:
        path = f"{self.path}/{LAYOUT['current']}"
        if self._there(path):
            return tables.current_records(self.spark, path)
        return self.spark.createDataFrame([], "key string, " + ", ".join(f"{c} string" for c in tables.CURRENT))

    @cached_property
    def rules(self) -> tuple[DataFrame, DataFrame]:
        """The primary rules, of which only one file counts, and the fallback's."""
        kind = "rules" if self._there(f"{self.path}/{LAYOUT['rules']}") else "rules_other"
        return country.parse_rules(self._lines(kind), LAYOUT[kind]), country.parse_rules(self._lines("rules_fallback"), "countrys_pc")

    @cached_property
    def interest_catalog(self) -> DataFrame:
        return layers.parse_interests(self._lines("interests"))

    @cached_property
    def lookup_counts(self) -> DataFrame:
        found = self._load("lookup_counts", "counts")
        return profile.searchable_slots(found) if found is not None else self.spark.createDataFrame([], "path string, slot_no long, key string, count long, updated int, status string")

    def snapshots_of(self, calls: list[str]) -> DataFrame:
        """The snapshots of a few calls: index lines by binary search, then only the bytes that these and the calls' postings
        stand for."""
        index = self._load("text_index", "index", calls=" ".join(calls))
        keyed = index.where("parsed").withColumn("call", N.key_call(F.col("key")))
        starts = lookup.slices(lookup.next_offsets(keyed), files.files(self.record_path)[0][1])
        by_index = self._by_index(starts.where(N.key_call(F.col("key")).isin(calls)))
        heads = sorted({k for c in calls for k in (c, c[1:])})
        found = self.inverted.where(F.col("header_key").isin(heads)).select("header_key", "ordinal", F.explode("postings").alias("p")).select("header_key", "ordinal", "p.posting_no", "p.dat_offset")
        order = F.struct(F.lit(2).alias("s"), F.col("ordinal").alias("k"), F.col("posting_no").alias("p")).alias("seq")
        by_posting = read_postings(found, self.record_path).where(F.col("callsign").isin(calls)).select("callsign", "vintage", *FIELDS, F.lit("hci").alias("source"), order)
        us = self._by_current().where(F.col("callsign").isin(calls))
        return us.unionByName(country.apply_country(by_index.unionByName(by_posting), self.rules[0]), allowMissingColumns=True)

    def _by_current(self) -> DataFrame:
        return tables.as_snapshots(self.current).withColumn("source", F.lit("us_csv")).withColumn("seq", F.struct(F.lit(0).alias("s"), F.lit(0).cast("long").alias("k"), F.lit(0).cast("long").alias("p")))

    def _by_index(self, starts: DataFrame) -> DataFrame:
        order = F.struct(F.lit(1).alias("s"), F.coalesce(N.key_vintage(F.col("key")), F.lit(0)).cast("long").alias("k"), (F.col("dat_offset") * 65_536 + F.col("slice_no")).alias("p")).alias("seq")
        return read_slices(starts, self.record_path).select("callsign", "vintage", *FIELDS, F.lit("dat_idx").alias("source"), order)

    @cached_property
    def snapshots(self) -> DataFrame:
        """All sources' records of a call with their precedence: current records, then the index's, then the inverted index's."""
        us = self._by_current()
        body = [*FIELDS]
        keyed = self.index.where("parsed").withColumn("call", N.key_call(F.col("key")))
        by_index = self._by_index(lookup.slices(lookup.next_offsets(keyed), files.files(self.record_path)[0][1]))
        posted = lookup.resolve_records(self.postings.select("full_key", "header_key", "ordinal", "posting_no", "dat_offset"), self.records)
        own = posted.where("callsign = header_key or substring(callsign, 2, 100) = header_key")
        # a posting whose record isn't the call's: the first window behind it that has one
        missed = self.postings.join(own.select("ordinal", "posting_no"), ["ordinal", "posting_no"], "left_anti").select(F.col("header_key").alias("call"), "ordinal", "posting_no", "dat_offset")
        near = lookup.window_fallback(missed, self.records).withColumnRenamed("rec_call", "callsign")
        order = F.struct(F.lit(2).alias("s"), F.col("ordinal").alias("k"), F.col("posting_no").alias("p")).alias("seq")
        by_posting = own.select("callsign", "vintage", *body, F.lit("hci").alias("source"), order).unionByName(near.select("callsign", "vintage", *body, F.lit("hci").alias("source"), order))
        both = country.apply_country(by_index.unionByName(by_posting), self.rules[0])
        return us.unionByName(both, allowMissingColumns=True)

    # --- questions -----------------------------------------------------------------------------------
    def lookup(self, calls) -> DataFrame:
        """call, status, current, history of each distinct call: a batch, also for a single call. A few calls by name read only
        what belongs to them."""
        asked, found = self._calls(calls), None
        if not isinstance(calls, DataFrame) and len(names := [r.call for r in asked.distinct().limit(FEW_CALLS + 1).collect()]) <= FEW_CALLS:
            found = self.snapshots_of(names)
        found = self.snapshots if found is None else found
        return lookup.batch(asked, found, tuple(c for c in found.columns if c in (*FIELDS, "jurisdiction")))

    batch_lookup = lookup

    def country_info(self, calls) -> DataFrame:
        primary, fallback = self.rules
        return country.country_info(self._calls(calls), primary, fallback, country.parse_centroids(self._lines("centroids")))

    country = country_info

    def lookup_count(self, calls) -> DataFrame:
        return profile.counts(self._calls(calls), self.lookup_counts)

    def profile(self, calls) -> DataFrame:
        asked = self._calls(calls)
        found = self.lookup(asked)
        info = self.country_info(asked).select("call", F.col("name").alias("country_name"), "code")
        history = found.select("call", F.explode("history").alias("h")).select("call", "h.vintage")
        codes = found.select("call", N.interest_codes(F.coalesce("current.interest_codes", F.lit(""))).alias("codes"))
        slots = self.lookup_counts.withColumnRenamed("status", "status_byte").withColumn("status", F.col("status_byte"))
        return profile.star(asked, found.select("call", F.col("status").alias("call_status"), "current"), info, slots, history, profile.resolve_codes(codes, self.interest_catalog))

    def map_svg(self, calls, drawn: tuple[str, ...] = ("world",), most_segments: int | None = None) -> DataFrame:
        """call, svg: the layers in `drawn` (of world, county, us_county, state) with at most most_segments segments each, and
        the call's place; null if there is neither. most_segments=512 makes a preview."""
        places = self.lookup(calls)
        rows = places.select("call", F.lit(None).cast("int").alias("vintage"), F.lit(1).alias("pos"), "current.latitude", "current.longitude").unionByName(places.select("call", F.posexplode("history").alias("pos", "h")).select("call", "h.vintage", "pos", "h.latitude", "h.longitude"))
        at = places.select("call").join(layers.best_location(rows), "call", "left")
        return layers.station_svg(at, layers.layer_svg(self.map_points().where(F.col("layer").isin(*drawn)), most_segments) if drawn else None, drawn)

    def map_points(self) -> DataFrame:
        keep = ("layer", "segment_no", "point_no", "lon", "lat")
        parts = [tables.parse_boundaries(self._lines(k), k).withColumnRenamed("kind", "layer").select(*keep) for k in ("world", "county")]
        parts.append(tables.parse_counties(self._lines("us_county")).where("lon is not null").withColumn("layer", F.lit("us_county")).select(*keep))
        vectors = self._load("state_vectors", "state")
        if vectors is not None:
            each = layers.paths(vectors, "point_no").select("segment_no", F.posexplode("points").alias("point_no", "p"))
            parts.append(each.select(F.lit("state").alias("layer"), "segment_no", F.col("point_no").cast("long").alias("point_no"), "p.lon", "p.lat"))
        return functools.reduce(DataFrame.unionByName, parts)

    def layer_statistics(self) -> DataFrame:
        """Segments and points of each layer whose file is there."""
        return layers.layer_statistics(self.map_points())

    def search_interest(self, code: str) -> DataFrame:
        if not (len(code.strip()) == 4 and code.strip().isdecimal()):
            raise ValueError(f"not an interest code: {code}")
        return statistics.search_code(self._interest_records(), code.strip())

    @cached_property
    def record_tags(self) -> DataFrame:
        """All records with their keys and tags as they stand: what the scans over all records count."""
        return self._load("record_tags", "records")

    def _interest_records(self) -> DataFrame:
        """Records with codes: of a record's d5 tags the last one counts."""
        raw = F.try_element_at(F.filter("tags", lambda t: t["tag"] == "d5"), F.lit(-1))["value"]
        found = self.record_tags.where(F.exists("tags", lambda t: t["tag"] == "d5"))
        made = found.select(N.scan_key_call(F.col("key")).alias("call"), N.scan_key_vintage(F.col("key")).alias("vintage"), F.col("rec_start").alias("pos"), N.interest_codes(N.trim_record(raw)).alias("codes"))
        return made.where("call is not null and size(codes) > 0")

    def entries(self) -> DataFrame:
        return lookup.enumerate_calls(self.index.where("parsed"), self.current)

    # --- files ---------------------------------------------------------------------------------------
    def asset_files(self) -> DataFrame:
        """Paths below the asset folders, relative to the directory; the files' contents aren't read."""
        store, _ = files.filesystem(self.path)
        there = [f"{self.path}/{d}" for d in ("bios", "photos", "flags", "maps") if store.get_file_info(files.filesystem(f"{self.path}/{d}")[1]).type.name == "Directory"]
        if not there:
            return self.spark.createDataFrame([], "path string")
        found = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(there)
        cut = F.regexp_extract("path", r"/((?:bios|photos|flags|maps)/.*)\z", 1)
        return found.select(cut.alias("path")).where("path not like '%PHOTOS.TXT'")

    @cached_property
    def photo_manifest(self) -> DataFrame:
        return profile.parse_manifest(self._lines("manifest"))

    def callsign_assets(self, calls) -> DataFrame:
        """Biographies and photos of calls; photos by their rank in the manifest, then by path."""
        found = profile.call_assets(self._calls(calls), self.asset_files())
        ranks = profile.ranked_photos(found.where("kind = 'photo'"), self.photo_manifest)
        return found.join(ranks.drop("listed"), ["call", "path"], "left")

    def country_assets(self, calls) -> DataFrame:
        info = self.country_info(calls).where("code is not null")
        found = profile.country_assets(info.select("code"), self.asset_files())
        return info.select("call", "code").join(found, "code")

    def manifest_photos(self, calls) -> DataFrame:
        """The photos that the manifest names for calls, wherever they are found."""
        return profile.manifest_photos(self._calls(calls), self.photo_manifest, self.asset_files())

    def assets(self, calls) -> DataFrame:
        """call, kind, path, media_type: biographies, photos, the country's flags and maps, by kind, then path. seq: the order."""
        asked = self._calls(calls)
        columns = ("call", "kind", "path", "media_type")
        own = self.callsign_assets(asked).select(*columns).unionByName(self.manifest_photos(asked).select(*columns)).unionByName(self.country_assets(asked).select(*columns))
        return profile.in_order(own)

    def manifest_diagnostics(self) -> DataFrame:
        """Which asset folders and how many of the layout's files there are, and the photo manifest's entries. A manifest that
        can't be read is an error here; profiles do without it."""
        store, _ = files.filesystem(self.path)
        there = {d: store.get_file_info(files.filesystem(f"{self.path}/{d}")[1]).type.name == "Directory" for d in ("bios", "photos", "flags", "maps")}
        found = profile.manifest_diagnostics(self.photo_manifest, self.asset_files())
        sidecars = sum(self._there(f"{self.path}/{name}") for kind, name in LAYOUT.items() if kind not in ("index", "records"))
        return found.select(F.lit(sidecars).alias("sidecar_files"), *(F.lit(on).alias(f"{d}_present") for d, on in there.items()), "*")

    # --- the current records in order ------------------------------------------------------------------
    def current_catalog(self) -> DataFrame:
        """The current records in the order of their keys' bytes."""
        return self.current.orderBy("key")

    def current_at(self, n: int) -> DataFrame:
        """The n-th current record (from 0), or none."""
        return self.current_catalog().limit(n + 1).offset(n)

    def interest_at(self, n: int) -> DataFrame:
        return self.interest_catalog.where(F.col("ordinal") == n)

    def sample_call(self) -> str | None:
        """The first valid call of the current records."""
        return self.current.where(N.callsign(F.col("key")).isNotNull()).agg(F.min("key").alias("k")).head().k

    # --- diagnostics ---------------------------------------------------------------------------------
    def interest_statistics(self) -> DataFrame:
        return statistics.interest_statistics(self._interest_records(), self.interest_catalog)

    def unknown_codes(self) -> DataFrame:
        return statistics.unknown_codes(self._interest_records(), self.interest_catalog)

    def record_statistics(self) -> DataFrame:
        """Distinct current calls and archive rows by jurisdiction: the index's keys by the primary rules, then the current
        records, which are of the United States."""
        keys = self.index.where("parsed").select(N.statistics_call(F.col("key")).alias("call"), N.key_vintage(F.col("key")).alias("vintage")).where("call is not null")
        info = country.country_info(keys, self.rules[0]).select("call", F.coalesce("jurisdiction", F.lit("unknown")).alias("jurisdiction"))
        return statistics.record_statistics(keys.join(info, "call"), self.current.select(F.col("key").alias("call")))

    def catalog_sizes(self) -> DataFrame:
        """Entries of the small catalogs."""
        parts = {"primary_rules": self.rules[0], "fallback_rules": self.rules[1], "centroids": country.parse_centroids(self._lines("centroids")), "interests": self.interest_catalog, "current_records": self.current}
        made = [df.agg(F.count("*").alias("entries")).select(F.lit(name).alias("catalog"), "entries") for name, df in parts.items()]
        return functools.reduce(DataFrame.unionByName, made)

    def inverted_entry(self, ordinal: int, length: int = 160) -> DataFrame:
        """One entry of the inverted index: its header, postings and decoded bytes with previews."""
        one = self.inverted.where(F.col("ordinal") == ordinal)
        path = f"{self.path}/{LAYOUT['entries']}"
        raw = read_windows(one.where("raw_len is not null").select(F.col("hci_offset").alias("dat_offset")), path, length).withColumnRenamed("dat_offset", "hci_offset")
        return one.join(raw, "hci_offset", "left")

    def raw_records(self, calls) -> DataFrame:
        """Decoded bytes of the slices that the index's entries of calls stand for."""
        run = self.index_trace(calls).where("slice_end is not null")
        longest = run.agg(F.max(F.col("slice_end") - F.col("dat_offset"))).head()[0] or 0
        raw = read_windows(run.select("dat_offset"), self.record_path, int(longest)).select("dat_offset", "raw").distinct()
        cut = run.join(raw, "dat_offset").orderBy("call", "seq")
        return cut.select("call", "key", F.substring(F.col("raw"), F.lit(1), (F.col("slice_end") - F.col("dat_offset")).cast("int")).alias("raw"))

    def posting_statistics(self) -> DataFrame:
        return statistics.posting_statistics(self.postings)

    def tag_statistics(self) -> DataFrame:
        """Per tag byte: every value that isn't blank counts, repeated ones and those of unknown tags too; a record whose
        key isn't one counts as current."""
        vintage = F.when(N.scan_key_call(F.col("key")).isNotNull(), N.scan_key_vintage(F.col("key")))
        each = self.record_tags.select(vintage.alias("vintage"), "rec_start", F.posexplode("tags").alias("no", "t"))
        tags = each.select(F.col("t.tag").alias("tag"), N.trim_record(F.col("t.value")).alias("value"), "vintage", F.struct("rec_start", "no").alias("pos")).where("value <> ''")
        return statistics.tag_statistics(tags)

    def verify_index(self) -> DataFrame:
        return statistics.index_verification(self.index.withColumn("line_no", F.col("line_start")))

    def verify_inverted(self) -> DataFrame:
        return statistics.entry_lengths(self.inverted)

    def posting_invariant(self) -> tuple[DataFrame, DataFrame]:
        size = self.records.agg(F.coalesce(F.max("rec_end"), F.lit(0))).head()[0]
        return statistics.posting_starts(self.postings, self.records, size)

    def tally(self) -> DataFrame:
        found = self.entries().where("valid")
        info = self.country_info(found).select("call", F.coalesce("name", F.lit("")).alias("country"))
        return tally.totals(tally.islands(info.withColumn("part", F.substring("call", 1, 2))))

    def publication_years(self) -> list[int]:
        """The years of the inverted index: a hundred or two at most."""
        return sorted(r.year for r in self.inverted.where("year is not null").select("year").distinct().limit(65_536).collect())

    def trace(self, calls) -> DataFrame:
        """How a call is found: the keys tried, their postings in order, and the records that these lead to."""
        found = lookup.probe(lookup.expand_keys(self._calls(calls), self.publication_years()), self.postings.select(F.col("full_key").alias("header_key"), "ordinal", "posting_no", "dat_offset"))
        return lookup.resolve_records(found, self.records.select("rec_start", "rec_end", "callsign", "vintage"))

    def raw(self, offsets: DataFrame, length: int = 256) -> DataFrame:
        """Decoded bytes behind record offsets, with previews."""
        return read_windows(offsets, self.record_path, length)

    def index_trace(self, calls) -> DataFrame:
        """The index entries of calls, with the slices that they stand for."""
        run = lookup.call_run(self._calls(calls), self.index.where("parsed"))
        size = files.files(self.record_path)[0][1]
        return run.join(lookup.slices(lookup.next_offsets(self.index.where("parsed")), size).select("key", "slice_end"), "key", "left")

    def stats(self) -> DataFrame:
        counts = {"index_lines": self.index, "records": self.records, "inverted_entries": self.inverted, "current_records": self.current}
        parts = [df.agg(F.count("*").alias("rows_")).select(F.lit(name).alias("relation"), "rows_") for name, df in counts.items()]
        return functools.reduce(DataFrame.unionByName, parts)
