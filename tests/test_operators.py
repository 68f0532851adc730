import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wavedeck.functions import normalize as N
from wavedeck.operators import country, layers, lookup, merge, profile, rangejoin, statistics, tally

RULES = [("OH0", "OH0ZZ"), ("K", "N"), ("4A", "4C"), ("3B6", "3B7"), ("VP2E", "VP2EZZ"), ("VP2", "VP2"), ("OH", "OH"), ("A", "AL"), ("K1", "K1"), ("Q0A", "Q9Z")]


def value(spark, column):
    return spark.range(1).select(column.alias("v")).head().v


# --- scalar rules ----------------------------------------------------------------------------------
@pytest.mark.parametrize("raw,expected", [(" k1abc\t", "K1ABC"), ("", None), ("K1-A", None), ("A" * 27, None), ("w1aw/4", "W1AW/4"), (None, None), ("K1ABC\n", "K1ABC"), ("K1 ABC", None)])
def test_callsign(spark, raw, expected):
    assert value(spark, N.callsign(F.lit(raw).cast("string"))) == expected


@pytest.mark.parametrize("raw,call,year,ok", [("K1ABC", "K1ABC", None, True), ("K1ABC:2015", "K1ABC", 2015, True), ("K1ABC:+2015", "K1ABC", 2015, True), ("K1ABC:70000", "K1ABC", None, False), ("K1ABC:", "K1ABC", None, False), ("k1abc", "k1abc", None, False), ("K1ABC:20:5", "K1ABC", None, False)])
def test_record_keys(spark, raw, call, year, ok):
    c = F.lit(raw)
    r = spark.range(1).select(N.key_call(c).alias("call"), N.key_vintage(c).alias("year"), N.key_ok(c).alias("ok")).head()
    assert (r.call, r.year, r.ok) == (call, year, ok)


def test_other_scalars(spark):
    lit = F.lit
    cases = [
        (N.interest_codes(lit("0010ab1200209999x")), ["0010", "0020", "9999"]),
        (N.interest_codes(lit("")), []), (N.interest_code(lit(" 0010 ")), "0010"), (N.interest_code(lit("10")), None),
        (N.clean_ascii(lit("\0 a b \r\n")), "a b"), (N.clean_ascii(lit("café")), None), (N.clean_ascii(lit(" \0")), None), (N.trim_ascii(lit("\u000b a")), "\u000b a"), (N.trim_unicode(lit(" a ")), "a"),
        (N.tag_int(lit("X !14@5#EU$1.5%-2^7"), "!"), 14), (N.tag_float(lit("X !14@5#EU$1.5%-2^7"), "%"), -2.0), (N.tag_value(lit("X !14@5#EU$1.5"), "#"), "EU"), (N.tag_float(lit("$1.5d"), "$"), None),
        (N.number(lit("0x1p3")), None), (N.number(lit(" 1")), None), (N.number(lit("1e400")), None), (N.clean_label(lit("ALAND - Islands - x")), "ALAND"),
        (N.display_name(lit("A"), lit(""), lit("B"), lit("Jr")), "A B Jr"), (N.display_name(lit(""), lit(None).cast("string"), lit("Whole Name"), lit("Jr")), "Whole Name"), (N.display_name(lit(""), lit(""), lit(""), lit("x")), None),
        (N.source_flags(F.array(lit("us_csv"), lit("hci"), lit("hci"))), 5), (N.plausible_date(lit(18991231)), None), (N.plausible_date(lit(20260509)), 20260509),
        (N.hex_preview(lit(b"\xb5K1").cast("binary"), 2), "b54b"), (N.text_preview(lit(b"\xb5K1\n").cast("binary"), 4), ".K1."), (N.safe_path(lit("a/./b.jpg")), "a/b.jpg"), (N.safe_path(lit("../b.jpg")), None), (N.safe_path(lit("/b.jpg")), None),
        (N.media_type(lit("x/K1.JPG")), "image/jpeg"), (N.media_type(lit("x.d/K1")), "application/octet-stream"), (N.tag_name(lit("bd")), "address"), (N.tag_name(lit("d3")), None), (N.is_call_header(lit("DAVID")), False), (N.is_call_header(lit("K1ABC")), True),
        (N.statistics_call(lit("K1ABC:1899")), None), (N.statistics_call(lit("!!!")), None), (N.statistics_call(lit("K1ABC:2015")), "K1ABC"), (N.lookup_key(lit(" k0ab ")), "K0AB"), (N.lookup_key(lit("a:b")), None),
    ]
    row = spark.range(1).select(*(c.alias(f"c{i}") for i, (c, _) in enumerate(cases))).head()
    for i, (_, expected) in enumerate(cases):
        assert row[i] == expected, i


# --- range joins -----------------------------------------------------------------------------------
def matches(call, start, end):
    if start == end:
        return call.startswith(start)
    w = min(max(len(start), len(end)), len(call))
    return start[:w] <= call[:w] <= end[:w]


def rules(spark):
    return spark.createDataFrame([(i, a, b, f"N{i}", "C", "x") for i, (a, b) in enumerate(RULES)], "line_no int, start string, end string, name string, code string, source string")


def test_classify_is_the_linear_scan(spark):
    rng = random.Random(7)
    calls = ["", "OH", "OH0", "OH0A", "VP2E", "VP2EZ", "VP2", "K", "N9", "4B1"] + ["".join(rng.choice("AKLNOHVPQ02349BEZ") for _ in range(rng.randint(1, 6))) for _ in range(2000)]
    order = sorted(range(len(RULES)), key=lambda i: (-len(RULES[i][0]), RULES[i][0], i))
    expected = {c: next((f"N{i}" for i in order if matches(c, *RULES[i])), None) for c in calls}
    got = rangejoin.classify(spark.createDataFrame([(c,) for c in calls], "call string"), rangejoin.ranked(rules(spark)))
    assert {r.call: r["name"] for r in got.collect()} == expected
    assert "CartesianProduct" not in got._jdf.queryExecution().toString()


def test_interval_joins_are_brute_force(spark):
    rng = random.Random(3)
    records, at = [], 0
    for _ in range(200):
        n = rng.choice([1, 10, 300, 200_000])
        records.append((at, at + n))
        at += n + rng.randint(0, 50)
    points = [(i, rng.randint(-5, at + 100)) for i in range(500)]
    r, p = spark.createDataFrame(records, "s long, e long"), spark.createDataFrame(points, "i int, at long")
    got = {(x.i, x.s) for x in rangejoin.containing(p, r, "at", "s", "e").collect()}
    assert got == {(i, next((s for s, e in records if s <= x < e), None)) for i, x in points}
    near = {(x.i, x.s) for x in rangejoin.within(p, r, "at", "s", 500).collect()}
    assert near == {(i, s) for i, x in points for s, _ in records if x <= s < x + 500}


# --- merge -----------------------------------------------------------------------------------------
def fold(rows):
    out = None
    for seq, first, middle, last, address in sorted(rows, key=lambda r: r[0]):
        new = {"first_name": first or None, "middle_name": middle or None, "last_name": last or None, "address": address or None}
        if out is None:
            out = new
            continue
        given = new["first_name"] or new["middle_name"]
        filled = {k: out[k] or new[k] for k in out}
        if given and new["last_name"] and filled["first_name"]:
            filled["last_name"] = new["last_name"]
        out = filled
    return out


@settings(max_examples=25, deadline=None)
@given(st.lists(st.lists(st.tuples(st.sampled_from([None, "", "F", "G"]), st.sampled_from([None, "M"]), st.sampled_from([None, "", "L", "K", "J"]), st.sampled_from([None, "", "A"])), min_size=1, max_size=5), min_size=1, max_size=12))
def test_merge_is_the_fold(spark, groups):
    rows = [(g, s, *r) for g, group in enumerate(groups) for s, r in enumerate(group)]
    df = spark.createDataFrame(rows, "g int, seq int, first_name string, middle_name string, last_name string, address string")
    got = merge.merge(df, ["g"], "seq", ["first_name", "middle_name", "last_name", "address"]).collect()
    assert {r.g: {k: r[k] for k in ("first_name", "middle_name", "last_name", "address")} for r in got} == {g: fold([(s, *r) for s, r in enumerate(group)]) for g, group in enumerate(groups)}


def test_merge_of_maps_arrays_and_sources(spark):
    df = spark.createDataFrame([("a", 1, "unknown", [], {"d3": "x"}, "hci"), ("a", 2, "canada", ["0010"], {"d3": "y", "d6": "z"}, "us_csv"), ("a", 3, "united_states", ["0020"], None, "hci")], "k string, seq int, jurisdiction string, codes array<string>, raw map<string,string>, source string")
    r = merge.merge(df, ["k"], "seq", ["jurisdiction"], arrays=["codes"], maps=["raw"], sources="source").head()
    assert (r.jurisdiction, r.codes, r.raw, r.source) == ("canada", ["0010"], {"d3": "y", "d6": "z"}, ["hci", "us_csv"])


# --- lookups and statistics ------------------------------------------------------------------------
def test_index_neighbours(spark):
    keys = [f"AN{i:04d}" for i in range(280)] + ["AO01DD", "AO0IMD:2015", "AO1B:2010", "AO:1980", "AO:2015", "AOAB:2010", "W1AW/1:2020", "W1AW/KP4:2015", "W1AW:2000", "W1AWA:1957"]
    index = spark.createDataFrame([(k, i * 10, i * 28) for i, k in enumerate(sorted(keys))], "key string, dat_offset long, line_start long")
    asked = spark.createDataFrame([("AO",), ("W1AW",), ("NOPE",)], "call string")
    assert sorted((r.call, r.vintage, r.seq) for r in lookup.call_run(asked, index).collect()) == [("AO", 1980, 1), ("AO", 2015, 2), ("W1AW", 2000, 1)]
    order = {k: i * 10 for i, k in enumerate(sorted(keys))}
    following = dict(zip(sorted(keys), [order[k] for k in sorted(keys)[1:]] + [None]))
    assert {r.key: r.next_offset for r in lookup.next_offsets(index).collect()} == following
    assert lookup.first_key_at_least(index, "AO1").head().key == "AO1B:2010"
    cut = lookup.slices(lookup.next_offsets(index), 2_500).collect()
    assert all(r.slice_end <= 2_500 and r.dat_offset < 2_500 for r in cut)


def test_key_expansion_and_probe(spark):
    calls = spark.createDataFrame([("K1ABC",)], "call string")
    keys = lookup.expand_keys(calls, [2015, 2010])
    assert [r.key for r in keys.orderBy("key_no").collect()] == ["K1ABC", "1ABC", "K1ABC:2010", "1ABC:2010", "K1ABC:2015", "1ABC:2015"]
    postings = spark.createDataFrame([("K1ABC:2015", 2, 0, 100), ("K1ABC", 5, 0, 300), ("K1ABC", 5, 1, 100), ("DAVID", 1, 0, 400)], "header_key string, ordinal long, posting_no long, dat_offset long")
    assert sorted((r.dat_offset, r.key, r.seq) for r in lookup.probe(keys, postings).collect()) == [(100, "K1ABC", 2), (300, "K1ABC", 1)]
    plain = lookup.expand_keys(calls, [])
    assert plain.count() == 2


def test_probe_numbers_equal_postings_by_offset(spark):
    postings = spark.createDataFrame([("1ABC", 7, 3, o * 37 % 101) for o in range(101)], "header_key string, ordinal long, posting_no long, dat_offset long")
    found = lookup.probe(lookup.expand_keys(spark.createDataFrame([("K1ABC",)], "call string"), []), postings)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as on large tables: a call's offsets come from several tasks
    try:
        assert sorted((r.seq, r.dat_offset) for r in found.collect()) == [(o + 1, o) for o in range(101)]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_postings_statistics(spark):
    rows = [("K1ABC", None, 100), ("K1ABC", None, 200), ("K1ABC", 2015, 100), ("K1ABC", 2015, 300), ("K2AA", 2016, 300), ("DAVID", None, 400), ("K3A", 1800, 1)]
    df = spark.createDataFrame(rows, "header_key string, year int, dat_offset long")
    got = sorted((r.archive, r.year or 0, r.postings, r.offsets) for r in statistics.posting_statistics(df).collect())
    assert got == [(False, 0, 2, 2), (True, 0, 3, 2), (True, 2015, 2, 2), (True, 2016, 1, 1)]


def test_verification(spark):
    lines = [(i, k, o, f"{k} {o} ", True) for i, (k, o) in enumerate([("A", 5), ("C", 9), ("B", 20), ("D", 15)])] + [(4, None, None, "bad é", False)]
    df = spark.createDataFrame(lines, "line_no long, key string, dat_offset long, line string, parsed boolean")
    r = statistics.index_verification(df).head()
    assert (r.key_order_violations, r.offset_violations, r.unparsed, r.non_ascii, r.lowest, r.highest) == (1, 1, 1, 1, "A", "D")
    entries = spark.createDataFrame([(0, 0, 10, True), (1, 10, 0, True), (2, 5, None, False)], "ordinal long, hci_offset long, raw_len long, terminated boolean")
    e = statistics.entry_lengths(entries).head()
    assert (e.entries, e.empty, e.out_of_bounds, e.shortest, e.longest, e.offset_violations) == (3, 1, 1, 0, 10, 1)


def test_islands_join_over_parts(spark):
    rng = random.Random(2)
    calls = sorted({f"{rng.choice('AB')}{rng.choice('01')}{rng.randint(0, 999):03d}" for _ in range(300)})
    rows = [(c, rng.choice("xxxxy"), c[:2]) for c in calls]
    runs, last = [], None
    for c, country_, _ in rows:
        if country_ == last:
            runs[-1][1] += 1
            runs[-1][3] = c
        else:
            runs.append([country_, 1, c, c])
        last = country_
    got = tally.islands(spark.createDataFrame(rows, "call string, country string, part string")).orderBy("run_no").collect()
    assert [[r.country, r.calls, r.first_call, r.last_call] for r in got] == runs


# --- tables and layers -----------------------------------------------------------------------------
def test_country_tables(spark):
    lines = ["# comment", "K     N     United States [US] !8@5#NA$37.5%-91.8^291", "OH0   OH0ZZ ALAND IS. - x [AX] !18@15#EU", "short", "      K     NOSTART", "VE    VE    Canada [CA]"]
    rules_ = country.parse_rules(spark.createDataFrame(list(enumerate(lines)), "line_no int, line string"), "countrys").orderBy("line_no").collect()
    assert [(r.start, r.end, r["name"], r.code, r.itu, r.cq, r.continent, r.lat, r.lon, r.number, r.jurisdiction) for r in rules_] == [
        ("K", "N", "United States", "US", 8, 5, "NA", 37.5, -91.8, 291, "united_states"), ("OH0", "OH0ZZ", "ALAND IS. - x", "AX", 18, 15, "EU", None, None, None, "international"), ("VE", "VE", "Canada", "CA", None, None, None, None, None, None, "canada")]
    assert rules_[1].cleaned_name == "ALAND IS."
    centroids = country.parse_centroids(spark.createDataFrame(list(enumerate(["Vatican (City) (41.9, 12.4)", "BAD (99, 1)", "X (1,2)", "x (3, 4)"])), "line_no int, line string"))
    assert sorted((r["name"], r.lat, r.lon) for r in centroids.collect()) == [("VATICAN (CITY)", 41.9, 12.4), ("X", 3.0, 4.0)]


def test_interests(spark):
    lines = ["0009*No category", "---Bands", "0010*160 meters", " 0020 * 80 meters ", "12*bad", "0030*", "---Modes", "0040*CW"]
    got = layers.parse_interests(spark.createDataFrame(list(enumerate(lines)), "line_no int, line string")).orderBy("ordinal").collect()
    assert [(r.code, r.category, r.label, r.ordinal) for r in got] == [("0009", "", "No category", 0), ("0010", "Bands", "160 meters", 1), ("0020", "Bands", "80 meters", 2), ("0040", "Modes", "CW", 3)]


def test_paths_and_svg(spark):
    points = spark.createDataFrame([(0, 5, 0.0, 0.0), (1, 4000, 2460.0, -4380.0), (2, 1, 2520.0, -4320.0)], "at int, command int, lat_min double, lon_min double")
    (p,) = layers.paths(points, "at").collect()
    assert [(x.lat, x.lon) for x in p.points] == [(41.0, -73.0), (42.0, -72.0)]
    lines = spark.createDataFrame([("world", s, n, float(s % 180), float(n)) for s in range(1, 514) for n in range(2)] + [("world", 600, 0, 0.0, 0.0)], "layer string, segment_no int, point_no int, lon double, lat double")
    assert layers.layer_svg(lines).head().svg.count("<polyline") == 513 and layers.layer_svg(lines, 512).head().svg.count("<polyline") == 512
    places = spark.createDataFrame([("A", 40.0, -70.0), ("B", None, None)], "call string, lat double, lon double")
    got = {r.call: r.svg for r in layers.station_svg(places).collect()}
    assert 'cx="-70.000000" cy="-40.000000"' in got["A"] and got["B"] is None
    assert all("polyline" in r.svg for r in layers.station_svg(places, layers.layer_svg(lines)).collect())


def test_best_location_is_the_latest(spark):
    df = spark.createDataFrame([("K0AB", 2015, 1, "40", "-70"), ("K0AB", 2020, 2, "41", "-71"), ("K0AB", None, 3, "x", "1"), ("K1", None, 1, "1", "2"), ("K1", 2020, 2, "3", "4")], "call string, vintage int, pos int, latitude string, longitude string")
    assert {r.call: (r.vintage, r.lat, r.lon) for r in layers.best_location(df).collect()} == {"K0AB": (2020, 41.0, -71.0), "K1": (None, 1.0, 2.0)}


def test_assets(spark):
    files = spark.createDataFrame([("bios/K/K0AB.txt",), ("bios/K/K0ABX.txt",), ("photos/X/K0ABX.JPG",), ("photos/K0AB.gif",), ("flags/US.GIF",), ("maps/US-1.gif",)], "path string")
    calls = spark.createDataFrame([("K0AB",)], "call string")
    assert sorted((r.kind, r.path) for r in profile.call_assets(calls, files).collect()) == [("biography", "bios/K/K0AB.txt"), ("photo", "photos/K0AB.gif"), ("photo", "photos/X/K0ABX.JPG")]
    assert sorted((r.kind, r.path) for r in profile.country_assets(spark.createDataFrame([("US",)], "code string"), files).collect()) == [("flag", "flags/US.GIF"), ("map", "maps/US-1.gif")]
    manifest = profile.parse_manifest(spark.createDataFrame([(0, "# c"), (1, "K0AB, X\\K0ABX.JPG"), (2, "K0AB|../no.jpg"), (3, "W1AW"), (4, "K0AB gone.jpg")], "line_no int, line string"))
    ranked = profile.ranked_photos(profile.call_assets(calls, files).where("kind = 'photo'"), manifest)
    assert [r.path for r in ranked.orderBy("photo_rank").collect()] == ["photos/X/K0ABX.JPG", "photos/K0AB.gif"]
    d = profile.manifest_diagnostics(manifest, files).head()
    assert (d.entries, d.with_file, d.found, d.missing) == (4, 2, 1, 1)


def test_counts_between_sentinels(spark):
    rows = [(0, "", 0), (1, "K0AB", 1), (2, "!" * 15, 0), (3, "K0AB", 7), (4, "W1AW", 9), (5, "z" * 15, 0)]
    slots = spark.createDataFrame([(n, k, c, 20260509, "N") for n, k, c in rows], "slot_no long, key string, count long, updated int, status string")
    reach = profile.searchable_slots(slots)
    assert sorted(r.key for r in reach.collect()) == ["K0AB", "W1AW"]
    asked = spark.createDataFrame([("k0ab",), ("zzzz",)], "call string")
    assert {r.call: r["count"] for r in profile.counts(asked, reach).collect()} == {"k0ab": 7, "zzzz": None}
    assert profile.searchable_slots(slots.where("slot_no > 2")).count() == 3


def test_expanded_keys_are_not_broadcast(spark):
    calls = spark.createDataFrame([("K0AB",), ("W1AW",)], "call string")
    postings = spark.createDataFrame([("K0AB", 1, 1, 10), ("0AB:1993", 2, 1, 10), ("1AW", 3, 1, 20)], "header_key string, ordinal long, posting_no long, dat_offset long")
    found = lookup.probe(lookup.expand_keys(calls, [1993]), postings)
    assert sorted(map(tuple, found.collect())) == [("K0AB", 10, "K0AB", 1), ("W1AW", 20, "1AW", 1)]
    # a small side is what the planner broadcasts unless told otherwise: the calls' estimate says nothing of their keys
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()


def test_drawings_are_made_by_all_tasks(spark, tmp_path):
    places = spark.range(40).selectExpr("concat('A', id % 20) as call", "id * 1.0d as lat", "id * 2.0d as lon").groupBy("call").agg(F.max("lat").alias("lat"), F.max("lon").alias("lon"))
    points = spark.createDataFrame([("world", 1, 1, 0.0, 1.0), ("world", 1, 2, 2.0, 3.0)], "layer string, segment_no int, point_no int, lon double, lat double")
    drawn = layers.station_svg(places, layers.layer_svg(points))
    drawn.write.parquet(str(tmp_path / "drawn"))
    assert len(list((tmp_path / "drawn").glob("*.parquet"))) > 1
    assert {(r.call, r.svg.count("<polyline"), r.svg.count("<circle")) for r in drawn.collect()} == {(f"A{i}", 1, 1) for i in range(20)}
