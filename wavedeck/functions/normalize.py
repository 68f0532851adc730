"""Scalar rules of the station directory as Column functions; all run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


# --- trims -----------------------------------------------------------------------------------------
def trim_ascii(c: Column) -> Column:
    """Without ASCII white space at the ends."""
    return F.regexp_replace(F.regexp_replace(c, r"^[\t\n\f\r ]+", ""), r"[\t\n\f\r ]+\z", "")


def trim_record(c: Column) -> Column:
    """Without ASCII white space and NUL at the ends, as record values are trimmed."""
    return F.regexp_replace(F.regexp_replace(c, r"^[\x00\t\n\f\r ]+", ""), r"[\x00\t\n\f\r ]+\z", "")


def trim_unicode(c: Column) -> Column:
    """Without Unicode white space at the ends."""
    return F.regexp_replace(F.regexp_replace(c, r"^[\s\x0B\x85\p{Z}]+", ""), r"[\s\x0B\x85\p{Z}]+\z", "")


def clean_ascii(c: Column) -> Column:
    """The trimmed value; null if it is empty or holds a byte outside printable ASCII."""
    t = trim_record(c)
    return F.when(t.rlike(r"\A[ -~]+\z"), t)


# --- keys and calls --------------------------------------------------------------------------------
def callsign(c: Column) -> Column:
    """A valid call in upper case: 1 to 26 of A-Z, 0-9 and /; else null."""
    t = F.upper(trim_ascii(c))
    return F.when(t.rlike(r"\A[A-Z0-9/]{1,26}\z"), t)


def is_record_key(c: Column) -> Column:
    """Whether a record's key part is usable: 1 to 12 of A-Z, 0-9 and /, in upper case as it stands."""
    return F.coalesce(c.rlike(r"\A[A-Z0-9/]{1,12}\z"), F.lit(False))


def _u16(c: Column) -> Column:
    """An unsigned 16-bit number, a leading + allowed; else null."""
    n = F.when(c.rlike(r"\A\+?0*[0-9]{1,5}\z"), c).try_cast("int")
    return F.when(n.between(0, 65535), n)


def key_call(c: Column) -> Column:
    return F.split_part(c, F.lit(":"), F.lit(1))


def key_vintage(c: Column) -> Column:
    """The year of CALL:YEAR; null without a year. See key_ok for years that don't parse."""
    return F.when(c.contains(":"), _u16(F.regexp_extract(c, r"(?s)\A[^:]*:(.*)\z", 1)))


def key_ok(c: Column) -> Column:
    """Whether a record key is usable, its year included."""
    return is_record_key(key_call(c)) & (~c.contains(":") | key_vintage(c).isNotNull())


def statistics_call(c: Column) -> Column:
    """The call of an index key as statistics count it: no sentinels, a four-digit year from 1900 to 2099 if any."""
    call, year = key_call(c), F.regexp_extract(c, r"(?s)\A[^:]*:(.*)\z", 1)
    good = ~c.contains(":") | (year.rlike(r"\A[0-9]{4}\z") & year.between("1900", "2099"))
    return F.when(good & ~c.startswith("!!!") & ~c.startswith("ZZZZZZZZ"), callsign(call))


def is_call_header(c: Column) -> Column:
    """Whether an inverted-index header is a call: at most 12 of the alphabet, with a letter and a digit."""
    return F.coalesce(c.rlike(r"\A(?=.*[A-Z])(?=.*[0-9])[A-Z0-9/]{1,12}\z"), F.lit(False))


def scan_key_call(c: Column) -> Column:
    """The call of a record key as the scans over all records take it, as it is spelt: a looser rule than that of lookups. Any
    valid call, with a 16-bit year if with any; else null."""
    t = trim_record(c)
    call, dated = key_call(t), t.contains(":")
    return F.when((~dated | scan_key_vintage(c).isNotNull()) & callsign(call).isNotNull(), call)


def scan_key_vintage(c: Column) -> Column:
    return key_vintage(trim_record(c))


def lookup_key(c: Column) -> Column:
    """The key of a current record: trimmed, upper case; null if empty or with a colon."""
    t = F.upper(trim_unicode(c))
    return F.when((t != "") & ~t.contains(":"), t)


def interest_code(c: Column) -> Column:
    t = trim_unicode(c)
    return F.when(t.rlike(r"\A[0-9]{4}\z"), t)


def interest_codes(c: Column) -> Column:
    """A raw string's codes: every four characters that are digits; a rest is left out."""
    parts = F.transform(F.sequence(F.lit(0), F.greatest(F.floor(F.length(c) / 4).cast("int") - 1, F.lit(0))), lambda i: F.substring(c, i * 4 + 1, F.lit(4)))
    return F.filter(parts, lambda x: x.rlike(r"\A[0-9]{4}\z"))


# --- country text ----------------------------------------------------------------------------------
def tag_value(c: Column, mark: str) -> Column:
    """The text after the first `mark`, up to the next mark of any kind."""
    return blank_to_null(trim_unicode(F.regexp_extract(c, rf"\{mark}([^!@#$%^&]*)", 1)))


def tag_int(c: Column, mark: str) -> Column:
    return _u16(tag_value(c, mark))


def number(c: Column) -> Column:
    """A plain decimal number; null for what only Spark would accept, and for what isn't finite."""
    n = F.when(c.rlike(r"\A[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z"), c).try_cast("double")
    return F.when(F.abs(n) < float("inf"), n)


def tag_float(c: Column, mark: str) -> Column:
    return number(tag_value(c, mark))


def clean_label(c: Column) -> Column:
    return F.trim(F.split_part(c, F.lit(" - "), F.lit(1)))


def grouping_label(cleaned: Column, name: Column) -> Column:
    return F.coalesce(blank_to_null(cleaned), name)


def rule_jurisdiction(code: Column, name: Column) -> Column:
    """Of a country rule: by its code, or by its name as the rule files spell it."""
    found = F.when((code == "US") | (name == "UNITED STATES"), "united_states").when((code == "CA") | (name == "CANADA"), "canada")
    return F.when(code.isNotNull() | name.isNotNull(), F.coalesce(found, F.lit("international")))


def record_jurisdiction(country: Column) -> Column:
    """Of a record that names its country, in either spelling; null if it doesn't."""
    return F.when(country.isin("United States", "UNITED STATES"), "united_states").when(country.isin("Canada", "CANADA"), "canada").when(country.isNotNull(), "international")


# --- records ---------------------------------------------------------------------------------------
def display_name(first: Column, middle: Column, last: Column, suffix: Column) -> Column:
    """Without first and middle name the last name alone; else all four that there are."""
    parts = [blank_to_null(x) for x in (first, middle, last, suffix)]
    return blank_to_null(F.when(parts[0].isNull() & parts[1].isNull(), parts[2]).otherwise(F.concat_ws(" ", *parts)))


def located(lat: Column, lon: Column) -> Column:
    """Whether both texts are finite numbers; their range isn't checked."""
    return number(lat).isNotNull() & number(lon).isNotNull()


def status(has_current: Column, has_history: Column) -> Column:
    return F.when(has_current, "current").when(has_history, "archive_only").otherwise("not_found")


#: Order and flag of the three sources; fixed values.
SOURCES = {"us_csv": 1, "dat_idx": 2, "hci": 4}


def source_flags(sources: Column) -> Column:
    bit = lambda s: F.coalesce(*(F.when(s == name, F.lit(v)) for name, v in SOURCES.items()), F.lit(0))
    return F.aggregate(F.array_distinct(sources), F.lit(0), lambda a, s: a.bitwiseOR(bit(s)))


def plausible_date(yyyymmdd: Column) -> Column:
    return F.when(yyyymmdd.between(19900101, 21000101), yyyymmdd)


def hex_preview(data: Column, n: int) -> Column:
    return F.lower(F.hex(F.substring(data, 1, n)))


def text_preview(data: Column, n: int) -> Column:
    return F.regexp_replace(F.decode(F.substring(data, 1, n), "ISO-8859-1"), r"[^ -~]", ".")


def safe_path(c: Column) -> Column:
    """A relative path without . parts; null if it is absolute, empty, or climbs with .. parts."""
    parts = F.filter(F.split(F.replace(c, F.lit("\\"), F.lit("/")), "/"), lambda p: (p != "") & (p != "."))
    good = ~c.startswith("/") & ~c.startswith("\\") & ~c.rlike(r"\A[A-Za-z]:") & ~F.array_contains(parts, "..") & (F.size(parts) > 0)
    return F.when(good, F.array_join(parts, "/"))


#: Media types by extension; fixed values.
MEDIA_TYPES = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "png": "image/png", "bmp": "image/bmp", "txt": "text/plain", "zip": "application/zip", "dat": "application/octet-stream"}


def media_type(path: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in MEDIA_TYPES.items() for x in pair))
    return F.coalesce(F.get(F.array(table[F.lower(F.regexp_extract(path, r"\.([^./]+)\z", 1))]), F.lit(0)), F.lit("application/octet-stream"))


#: Field of each tag byte, in the order of the tags; fixed values.
TAG_NAMES = {
    "b6": "license_class", "b7": "record_code", "b8": "first_name", "b9": "middle_name", "ba": "last_name", "bb": "suffix",
    "bc": "address", "bd": "address", "be": "address", "bf": "city", "c0": "state_or_province", "c1": "postal_code",
    "c2": "birth_date", "c3": "first_issued", "c4": "expires", "c5": "last_changed", "c6": "county", "c7": "gmt_offset",
    "c8": "latitude", "c9": "longitude", "ca": "grid", "cb": "area_code", "cc": "previous_call", "cd": "previous_class",
    "ce": "fcc_transaction_type", "cf": "email", "d0": "qsl", "d1": "country", "d2": "url", "d4": "fax_number",
    "d5": "interest_codes", "d7": "license_id", "d9": "frn", "da": "iota", "de": "numeric_id",
}
FIELDS = tuple(dict.fromkeys(TAG_NAMES.values()))


def tag_name(tag: Column) -> Column:
    return F.create_map(*(F.lit(x) for pair in TAG_NAMES.items() for x in pair))[tag]
