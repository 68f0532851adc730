import contextlib
import io
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from wavedeck import cli
from wavedeck.directory import DataPathNotFound, Directory, InvalidCallsign, NoDataFiles
from wavedeck.keystream import coded
from wavedeck.streaming.arrivals import enriched, lookups_per_window


@pytest.fixture(scope="module")
def path(tmp_path_factory):
    root = tmp_path_factory.mktemp("db")
    at = root / "ham0"
    (at / "photos").mkdir(parents=True)
    bodies = [b"\xb5DL1ABC:2010\xbaName", b"\xb5K0AB\xb8Jane\xbaOld\xd5001000209999\xc840\xc9-70", b"\xb5K0AB:2015\xb8Jane\xbaOlder\xd50010", b"\xb5K0AB:2020\xc841\xc9-71\xbaOld", b"\xb5Z9ZZ\xbax"]
    starts, plain = [], b"head"
    for b in bodies:
        starts.append(len(plain))
        plain += b
    (at / "hamcall.dat").write_bytes(coded(plain))
    keys = ["DL1ABC:2010", "K0AB", "K0AB:2015"]
    offsets = {"DL1ABC:2010": starts[0], "K0AB": starts[1], "K0AB:2015": starts[2]}
    (at / "hamcall.idx").write_bytes(b"".join(f"{k:<15}{offsets[k]} \r\n".encode() for k in sorted(keys)))
    body, index = b"", []
    for key, offs in (("K0AB:2020", [starts[3]]), ("K0AB", [starts[1]])):
        index.append(len(body))
        body += coded(key.encode() + b"\xb5", len(body)) + b"".join(struct.pack(">IB", o, 1) for o in offs) + b"?"
    (at / "hci.dat").write_bytes(body)
    (at / "hciindex.dat").write_bytes(b"".join(struct.pack(">I", o) for o in index))
    with zipfile.ZipFile(at / "usa.csv.zip", "w") as z:
        z.writestr("usa.csv", "Callsign,Class,Name,Address,City,State,ZIP,County,License Issue Date,FCC Transaction Type\nK0AB,G,Jane Q New,1 St,Town,NJ,07,,20200101,\nW1AW,E,Club,,,CT,,,,\n")
    (at / "countrys").write_text("K     N     United States [US] !8@5#NA$37.5%-91.8\nDL    DL    Germany [DE]\n")
    (at / "COUNTRYS.PC").write_text("1A    1A    Vatican\n")
    (at / "countrys.nam").write_text("GERMANY (51, 10)\n")
    (at / "interest").write_text("---Bands\n0010*160 meters\n0020*80 meters\n")
    (at / "counts.dat").write_bytes(coded(b"".join(f"{k:<15}{c:>7}20260509N\r\n".encode() for k, c in (("K0AB", 7), ("W1AW", 9)))))
    (at / "bios/K").mkdir(parents=True)
    (at / "flags").mkdir()
    (at / "bios/K/K0AB.txt").write_text("b")
    (at / "flags/US.GIF").write_bytes(b"f")
    for name in ("K0AB.JPG", "K0ABX.gif"):
        (at / "photos" / name).write_bytes(b"p")
    (at / "photos/PHOTOS.TXT").write_text("# photos\nK0AB K0ABX.gif\nK0AB ../no.gif\n")
    (at / "wc.dat").write_text("# -b -73 -72 41 42 24\n-73 41\n-72 42\n")
    return str(root)


def test_lookup_merges_the_sources(spark, path):
    d = Directory.open(spark, path)
    got = {r.call: r for r in d.lookup([" k0ab", "W1AW", "DL1ABC", "NOPE9"]).collect()}
    assert {c: r.status for c, r in got.items()} == {"K0AB": "current", "W1AW": "current", "DL1ABC": "archive_only", "NOPE9": "not_found"}
    k = got["K0AB"]
    # the record's last name replaces the whole name once a first name is there; other fields stay with the first source
    assert (k.current.last_name, k.current.first_name, k.current.city, k.current.sources) == ("Old", "Jane", "Town", ["dat_idx", "hci", "us_csv"])
    assert [(h.vintage, h.last_name) for h in k.history] == [(2015, "Older"), (2020, "Old")]
    with pytest.raises(InvalidCallsign):
        d.lookup("K0-AB")


def test_other_questions(spark, path):
    d = Directory(spark, path + "/ham0")
    assert {r.call: (r["name"], r.lat) for r in d.country_info(["K0AB", "DL1ABC", "1A0"]).collect()} == {"K0AB": ("United States", 37.5), "DL1ABC": ("Germany", 51.0), "1A0": ("Vatican", None)}
    assert {r.call: r["count"] for r in d.lookup_count(["k0ab", "X1X"]).collect()} == {"K0AB": 7, "X1X": None}
    assert sorted((r.call, r.vintage) for r in d.search_interest("0010").collect() if r.vintage) == [("K0AB", 2015)]
    p = d.profile(["K0AB", "NOPE9"]).where("call = 'K0AB'").head()
    assert (p.call_status, p.country_name, p["count"], p.history_rows, [i.label for i in p.interests]) == ("current", "United States", 7, 2, ["160 meters", "80 meters"])
    svg = {r.call: r.svg for r in d.map_svg(["K0AB", "NOPE9"], ("world",)).collect()}
    assert "circle" in svg["K0AB"] and "polyline" in svg["NOPE9"] and "circle" not in svg["NOPE9"]
    assert {r.call for r in d.entries().collect()} == {"K0AB", "DL1ABC", "W1AW"}
    assert {r.relation: r.rows_ for r in d.stats().collect()} == {"index_lines": 3, "records": 5, "inverted_entries": 2, "current_records": 2}
    assert d.interest_statistics().head().snapshots == 2 and d.verify_index().head().key_order_violations == 0 and d.verify_inverted().head().entries == 2
    assert {r.kind: r.postings for r in d.posting_invariant()[0].collect()} == {"record_start": 2}
    assert d.tag_statistics().where("tag = 'ba'").head().occurrences == 5 and d.posting_statistics().count() == 3
    assert {r.country: r.calls for r in d.tally().collect()} == {"Germany": 1, "United States": 1, "": 1} or d.tally().count() >= 2


def test_files_and_traces(spark, path):
    d = Directory(spark, path)
    found = {(r.kind, r.path.split("/")[-1]): r.photo_rank for r in d.callsign_assets("K0AB").collect()}
    assert found == {("biography", "K0AB.txt"): None, ("photo", "K0ABX.gif"): 1, ("photo", "K0AB.JPG"): 2}
    assert [(r.call, r.kind, r.media_type) for r in d.country_assets(["K0AB"]).collect()] == [("K0AB", "flag", "image/gif")]
    m = d.manifest_diagnostics().head()
    assert (m.entries, m.with_file, m.found, m.missing) == (2, 1, 1, 0)
    assert d.publication_years() == [2020]
    assert sorted((r.key, r.how, r.vintage) for r in d.trace("K0AB").collect()) == [("K0AB", "posting_start", None), ("K0AB:2020", "posting_start", 2020)]
    assert [(r.key, r.slice_end > r.dat_offset) for r in d.index_trace("K0AB").orderBy("seq").collect()] == [("K0AB", True), ("K0AB:2015", True)]
    raw = d.raw(spark.createDataFrame([(0,), (4,), (10**6,)], "dat_offset long"), 10).orderBy("dat_offset").collect()
    assert bytes(raw[0].raw)[:5] == b"head\xb5" and raw[1].text.startswith(".DL1ABC") and bytes(raw[2].raw) == b""
    j = {r.callsign: (r.jurisdiction, r.country) for r in d.snapshots.where("source <> 'us_csv'").collect()}
    assert j["K0AB"] == ("united_states", "United States") and j["DL1ABC"] == ("international", "Germany")


def test_a_few_calls_read_what_the_join_finds(spark, path):
    d = Directory(spark, path)
    calls = ["K0AB", "W1AW", "DL1ABC", "Z9ZZ", "NOPE9", "K"]
    few, many = d.lookup(calls), d.lookup(spark.createDataFrame([(c,) for c in calls], "call string"))
    assert few.schema == many.schema and sorted(few.collect()) == sorted(many.collect())
    assert d.index.count() == 3 and d._load("text_index", "index", calls="K0AB").count() == 2 and d._load("text_index", "index", calls="A ZZ").count() == 1


def test_index_runs_are_found_by_binary_search(spark, tmp_path):
    from wavedeck.sources import tables

    tables.register(spark)
    keys = sorted([f"A{i:04d}:{1900 + i % 200}" for i in range(3000)] + ["W1AW", "W1AW/1:2020", "W1AW:2000", "W1AW:2001", "W1AWA:1957"])
    (tmp_path / "a.idx").write_bytes(b"".join(f"{k:<15}{i * 7} \r\n".encode() for i, k in enumerate(keys)))
    for call in ("A0000", "A1234", "A2999", "W1AW", "A", "ZZ", "W1AW/1"):
        got = spark.read.format("text_index").option("path", str(tmp_path / "a.idx")).option("calls", call).load().collect()
        run = [i for i, k in enumerate(keys) if call <= k < call + ";"]
        after = [i for i, k in enumerate(keys) if k >= call + ";"][:1]
        assert [r.key for r in got] == [keys[i] for i in run + after] and [r.dat_offset for r in got] == [7 * i for i in run + after]


def test_scans_over_all_records(spark, tmp_path):
    """Keys that lookups don't take, repeated and unknown tags, values that don't print: what the scans count."""
    at = tmp_path / "ham0"
    at.mkdir()
    plain = b"head\xb5k1abc:2015\xd5" + b"0010\xd50020\xd3one\xd3one\xd3two\xb5bad key\xb8Jo\xc3\xa9\xb8 \0\xb5K1ABC\xd50030\xd5 "
    (at / "hamcall.dat").write_bytes(coded(plain))
    (at / "hamcall.idx").write_bytes(b"K1ABC 1 \r\n")
    (at / "interest").write_text("---Bands\n0020*80 meters\n")
    d = Directory(spark, str(tmp_path))
    tags = {r.tag: (r.occurrences, r.current, r.archive, r.samples, r.field) for r in d.tag_statistics().collect()}
    assert tags["d3"] == (3, 0, 3, "one|two", None) and tags["d5"] == (3, 1, 2, "0010|0020|0030", "interest_codes") and tags["b8"][:3] == (1, 1, 0)
    assert [(r.call, r.vintage, r.current) for r in d.search_interest("0020").collect()] == [("k1abc", 2015, False)]
    assert d.search_interest("0010").count() == 0  # a later tag replaces it, an empty one too
    assert d.interest_statistics().head().snapshots == 1


def test_country_rules(spark, tmp_path):
    from wavedeck.operators import country

    lines = [
        "S5    S5    SLOVENIA [SI] !28@15#EU$46.03%14.31", "K     K     UNITED STATES [US] !08@05#NA", "OH0   OH0ZZ ALAND ISLANDS - FINLAND [FI] !18@15#EU$60.25%20", "T8    T8    PALAU$7.479%134.548^022",
        "3B6   3B7   AGALEGA & ST. BRANDON IS. !53@39#AF$-10.4%56.6^004", "k1a   k1z   UNITED STATES", "VP2E  VP2EZZANGUILLA - LEEWARD ISLANDS [AV] !11@08#NA$18%-63", "#     X     NOTE", "A     A", "X     X     FORM[x] [ ]", "VE    VE    CANADA", "C1    C1    Canada",
    ]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "line_no long, line string")
    got = {r.start: r for r in country.parse_rules(df, "countrys").collect()}
    assert sorted(got) == ["3B6", "C1", "K", "K1A", "OH0", "S5", "T8", "VE", "VP2E", "X"]
    assert got["3B6"]["name"] == "AGALEGA & ST. BRANDON IS." and (got["K1A"]["end"], got["K1A"]["jurisdiction"]) == ("K1Z", "united_states")
    assert (got["S5"].code, got["S5"].itu, got["S5"].cq, got["S5"].continent, got["S5"].lat, got["S5"].lon) == ("SI", 28, 15, "EU", 46.03, 14.31)
    assert (got["T8"]["name"], got["T8"].lon, got["T8"].number) == ("PALAU", 134.548, 22) and (got["X"]["name"], got["X"].code) == ("FORM[x]", None)
    assert got["OH0"].cleaned_name == "ALAND ISLANDS" and got["VP2E"].cleaned_name == "ANGUILLA" and (got["VE"].jurisdiction, got["C1"].jurisdiction) == ("canada", "international")
    calls = spark.createDataFrame([("K1AB",), ("K2X",), ("3B7A",)], "call string")
    assert {r.call: r["name"] for r in country.country_info(calls, country.parse_rules(df, "countrys")).collect()} == {"K1AB": "UNITED STATES", "K2X": "UNITED STATES", "3B7A": "AGALEGA & ST. BRANDON IS."}


def test_maps_and_assets(spark, path):
    d = Directory(spark, path)
    assert "polyline" in d.map_svg("NOPE9").head().svg and d.map_svg("NOPE9", ()).head().svg is None
    assert [(r.kind, r.path, r.seq) for r in d.assets("K0AB").orderBy("seq").collect()] == [("biography", "bios/K/K0AB.txt", 1), ("photo", "photos/K0AB.JPG", 2), ("photo", "photos/K0ABX.gif", 3), ("flag", "flags/US.GIF", 4)]
    m = d.manifest_diagnostics().head()
    assert (m.bios_present, m.maps_present, m.sidecar_files) == (True, False, 10)
    assert [r.key for r in d.current_catalog().collect()] == ["K0AB", "W1AW"] and d.current_at(1).head().key == "W1AW" and d.current_at(2).count() == 0 and d.sample_call() == "K0AB" and d.interest_at(1).head().code == "0020"


def test_manifest_names(spark):
    from wavedeck.operators import profile

    files = spark.createDataFrame([("photos/a/K1.jpg",), ("photos/K2.JPG",), ("photos/x/y/K3.gif",), ("photos/K1.jpg",), ("bios/K2.jpg",)], "path string")
    manifest = spark.createDataFrame([(1, "K1", "K1.jpg"), (2, "K2", "k2.jpg"), (3, "K3", "Y/k3.gif"), (4, "K4", "z/K3.gif"), (5, "K5", None)], "line_no long, call string, file string")
    got = profile.manifest_photos(spark.createDataFrame([(f"K{i}",) for i in range(1, 6)], "call string"), manifest, files)
    assert sorted((r.call, r.path) for r in got.collect()) == [("K1", "photos/K1.jpg"), ("K2", "photos/K2.JPG"), ("K3", "photos/x/y/K3.gif")]
    m = profile.manifest_diagnostics(manifest, files).head()
    assert (m.entries, m.with_file, m.found, m.missing) == (5, 4, 3, 1)


def test_running_counts_pass_from_part_to_part(spark, monkeypatch):
    from wavedeck.operators import layers

    monkeypatch.setattr(layers, "PART", 7)
    rows = [(i, i % 11 in (0, 5) and i > 3, f"h{i}") for i in range(100)]
    df = spark.createDataFrame(rows, "line_no long, head boolean, h string")
    n, last, expected = 0, None, []
    for i, head, h in rows:
        n, last = n + head, h if head else last
        expected.append((i, n, last))
    made = layers.carry_down(layers.segments(df, F.col("head"), "line_no"), F.when(F.col("head"), F.col("h")), "line_no")
    assert sorted((r.line_no, r.segment_no, r.carried) for r in made.collect()) == expected


def test_slices_that_begin_inside_a_key(spark, path, tmp_path):
    from wavedeck.sources.records import read_slices

    plain = b"head\xb5S51DX:2010\xb6A\xbaExample\xb5S51DXA\xbaOther"
    (tmp_path / "r.dat").write_bytes(coded(plain))
    entries = spark.createDataFrame([("S51DX:2010", 10, len(plain)), ("S51DX", 4, 20), ("S51DXA", 10, len(plain))], "key string, dat_offset long, slice_end long")
    got = sorted((r.key, r.callsign, r.vintage or 0, r.last_name or "") for r in read_slices(entries, str(tmp_path / "r.dat")).collect())
    assert got == [("S51DX", "S51DX", 2010, "Ex"), ("S51DX:2010", "S51DX", 2010, "Example"), ("S51DXA", "S51DXA", 0, "Other"), ("S51DXA", "S51DXA", 2010, "Example")]
    assert [r.last_name for r in read_slices(entries.limit(1), str(tmp_path / "r.dat"), complete=True).collect()] == ["Example"]


def test_paths_and_cli(spark, path, tmp_path, capsys, monkeypatch):
    with pytest.raises(DataPathNotFound):
        Directory(spark, str(tmp_path / "none"))
    with pytest.raises(NoDataFiles):
        Directory(spark, str(tmp_path))
    assert cli.main(["--db", path, "--json", "lookup", "K0AB"], spark) == 0 and '"status":"current"' in capsys.readouterr().out
    assert cli.main(["--db", path, "lookup", "NOPE9"], spark) == 1
    monkeypatch.delenv("WAVEDECK_DB", raising=False)
    monkeypatch.setenv("HOME", str(tmp_path / "home"))
    monkeypatch.chdir(tmp_path)
    assert cli.main(["lookup", "X"], spark) == 2
    monkeypatch.setenv("WAVEDECK_DB", path)
    assert cli.main(["lookup", "K0AB"], spark) == 0
    capsys.readouterr()
    assert cli.main(["assets", "K0AB"], spark) == 0
    assert [x.split("  ")[1:3] for x in capsys.readouterr().out.splitlines()] == [["biography", "bios/K/K0AB.txt"], ["photo", "photos/K0AB.JPG"], ["photo", "photos/K0ABX.gif"], ["flag", "flags/US.GIF"]]
    assert cli.main(["assets", "Q9ZZZ"], spark) == 1 and cli.main(["trace-lookup", "K0AB"], spark) == 0 and "posting_start" in capsys.readouterr().out
    assert cli.main(["hci-dump", "0"], spark) == 0 and "K0AB" in capsys.readouterr().out and cli.main(["hci-dump", "99"], spark) == 1
    assert cli.main(["sidecar-stats"], spark) == 0 and "world  1  2" in capsys.readouterr().out
    with contextlib.redirect_stdout(io.TextIOWrapper(io.BytesIO())) as said:
        assert cli.main(["--raw", "lookup", "K0AB"], spark) == 0
        assert b"\xb5K0AB:2015" in said.buffer.getvalue()
    assert cli.main(["--tags", "--interests", "--unknown-samples", "1", "stats"], spark) == 0
    told = capsys.readouterr().out
    assert "9999  1  1  0  K0AB" in told and "d5  2  1  1" in told
    assert cli.main(["--db", str(tmp_path), "stats"], spark) == 1 and cli.main(["--db", path, "stats"], spark) == 0


def test_arrivals(spark, tmp_path):
    rows = spark.createDataFrame([("k0ab", "2026-01-01 00:01:00"), ("W1AW", "2026-01-01 00:02:00"), ("k0ab", "2026-01-01 00:09:00"), ("x-", "2026-01-01 02:00:00")], "call string, t string").select("call", F.to_timestamp("t").alias("ts"))
    rows.write.parquet(str(tmp_path / "in"))
    static = spark.createDataFrame([("K0AB", "current")], "call string, status string")
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    for name, df, mode in (("met", enriched(stream, static), "append"), ("counted", lookups_per_window(stream), "append")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
    assert sorted((r.call, r.status) for r in spark.table("met").collect()) == [("W1AW", None), ("k0ab", "current"), ("k0ab", "current"), ("x-", None)]
    assert sorted((r.call, r.lookups) for r in spark.table("counted").collect()) == [("W1AW", 1), ("k0ab", 1), ("k0ab", 1)]
