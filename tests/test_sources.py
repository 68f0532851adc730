import struct
import zipfile

import pytest
from hypothesis import given
from hypothesis import strategies as st

from wavedeck import keystream
from wavedeck.keystream import coded
from wavedeck.sources import records, tables


@given(st.binary(max_size=400), st.integers(0, 10_000), st.integers(0, 400))
def test_the_coding_is_its_own_inverse_and_splits(data, position, cut):
    assert coded(coded(data, position), position) == data
    assert coded(data, position) == bytes(b ^ 7 ^ (position + i + 4) % 101 for i, b in enumerate(data))
    assert coded(data[:cut], position) + coded(data[cut:], position + len(data[:cut])) == coded(data, position)


def test_candidates_find_the_place():
    text = b"\xb5K0ABC\xb8Jane\xbaExample\xc0IL"
    ranked = keystream.candidates(coded(text, 37))
    assert len(ranked) == 101 and ranked == sorted(ranked, key=lambda x: (-x[1], x[0]))
    assert keystream.coded(coded(text, 37), 37) == text


def test_parse():
    body = b"K0ABC:2015\xb6G\xb8Jane\xb9Q\xbaExample\xbc123 Test St\xbfSpringfield\xc0IL\xc162704\xd3raw\xb8\xe9\xd2 \0"
    r = records.parse(body)
    assert (r["callsign"], r["vintage"], r["first_name"], r["address"], r["city"], r["raw_tags"]) == ("K0ABC", 2015, "Jane", "123 Test St", "Springfield", [("d3", "raw")])
    assert "url" not in r and records.parse(b"k0abc\xb6G") is None and records.parse(b"K0ABC:99999\xb6G") is None and records.parse(b":2010\xb6A") is None
    assert [(x["callsign"], x["vintage"]) for x in records.parse_slice(b":2010\xb6A\xbaExample", "S51DX:2010")] == [("S51DX", 2010)]
    two = b"\xb5K0AB\xb8A\xb5K0ABC:2015\xb8Jane"
    assert [x["callsign"] for x in records.parse_slice(two)] == ["K0AB", "K0ABC"] and [x["callsign"] for x in records.parse_slice(two, complete=True)] == ["K0AB"]


@pytest.mark.parametrize("length", [1, 7, 40, 1 << 20])
def test_records_by_ranges(spark, tmp_path, length):
    tables.register(spark)
    plain = b"header" + b"".join(b"\xb5K%dABC:20%02d\xb8Name%d\xd6tag" % (i % 10, i, i) for i in range(30)) + b"\xb5bad\xb8x\xb5W1AW\xb8last" + b" " * 50
    (tmp_path / "a.dat").write_bytes(coded(plain))
    got = spark.read.format("tagged_records").option("path", str(tmp_path / "a.dat")).option("length", length).load().orderBy("rec_start").collect()
    assert [r.first_name for r in got] == [f"Name{i}" for i in range(30)] + ["last"]
    assert all(plain[r.rec_start] == 0xB5 for r in got) and [r.rec_terminated for r in got] == [True] * 30 + [False] and got[-1].rec_end == len(plain)
    assert got[0].raw_tags == {"d6": "tag"}


@pytest.mark.parametrize("length", [1, 9, 28, 1 << 20])
def test_text_index_by_ranges(spark, tmp_path, length):
    tables.register(spark)
    data = b"!!!            6 \r\nK1ABC          100 \r\nbad line\r\nK1ABC:2015  200\r\nodd\nK2 5 \r\nZZZZZZZZ 300 \r\ntail"
    (tmp_path / "a.idx").write_bytes(data)
    got = spark.read.format("text_index").option("path", str(tmp_path / "a.idx")).option("length", length).load().orderBy("line_start").collect()
    assert [(r.key, r.dat_offset) for r in got if r.parsed] == [("!!!", 6), ("K1ABC", 100), ("K1ABC:2015", 200), ("ZZZZZZZZ", 300)]
    assert len(got) == 6 and all(data[r.line_start :].decode("latin-1").startswith(r.line) for r in got)


def test_inverted_index(spark, tmp_path):
    tables.register(spark)
    at, body, offsets = 0, b"", []
    for key, postings in (("K1ABC", [100, 200]), ("K1ABC:2015", [100, 300]), ("DAVID", [400]), ("", [1]), ("X" * 120, [2])):
        offsets.append(at)
        entry = coded(key.encode() + b"\xb5", at) + b"".join(struct.pack(">IB", p, 3) for p in postings) + b"?"
        body, at = body + entry, at + len(entry)
    (tmp_path / "a.entries").write_bytes(body)
    (tmp_path / "a.index").write_bytes(b"".join(struct.pack(">I", o) for o in [*offsets, 10**9]))
    read = lambda: spark.read.format("inverted_index").option("path", str(tmp_path)).option("length", 8).load().orderBy("ordinal").collect()
    got = read()
    assert [(r.header_key, r.year, [p.dat_offset for p in r.postings]) for r in got[:3]] == [("K1ABC", None, [100, 200]), ("K1ABC", 2015, [100, 300]), ("DAVID", None, [400])]
    assert [r.terminated for r in got] == [True, True, True, False, False, False] and got[5].raw_len is None
    (tmp_path / "a.index").write_bytes(b"abc")
    with pytest.raises(Exception, match="malformed header"):
        read()


def test_counts_and_states(spark, tmp_path):
    tables.register(spark)
    slots = b"".join(f"{k:<15}{c:>7}{d:08d}{s}\r\n".encode() for k, c, d, s in (("K0AB", 7, 20260509, "N"), ("W1AW", 9, 18000101, "X")))
    (tmp_path / "a.counts").write_bytes(coded(slots))
    got = spark.read.format("lookup_counts").option("path", str(tmp_path / "a.counts")).option("length", 33).load().orderBy("slot_no").collect()
    assert [(r.slot_no, r.key, r["count"], r.updated, r.status) for r in got] == [(0, "K0AB", 7, 20260509, "N"), (1, "W1AW", 9, None, "X")]
    (tmp_path / "a.state").write_bytes(struct.pack("<hhhhhh", 4000, 2460, -4380, 1, 2520, -4320) + b"x")
    got = spark.read.format("state_vectors").option("path", str(tmp_path / "a.state")).option("length", 6).load().orderBy("point_no").collect()
    assert [tuple(r)[1:] for r in got] == [(0, 4000, 2460, -4380), (1, 1, 2520, -4320)]


def test_zipped_current_records(spark, tmp_path):
    tables.register(spark)
    text = 'Callsign,Class,Name,Address,City,State,ZIP,County,Date,Type\n" w1aw ",E,"ARRL, ""HQ""",x,y,CT,1,,20200101,\nK0AB,,Old,,,,,,,\n,,none,,,,,,,\nk0ab,G,New,,,NJ,,,,\n'
    with zipfile.ZipFile(tmp_path / "u.zip", "w") as z:
        z.writestr("usa.csv", text)
    got = tables.current_records(spark, str(tmp_path / "u.zip"))
    assert sorted((r.key, r.callsign, r["name"]) for r in got.collect()) == [("K0AB", "k0ab", "New"), ("W1AW", "w1aw", 'ARRL, "HQ"')]
    snap = {r.callsign: r for r in tables.as_snapshots(got).collect()}
    assert (snap["W1AW"].last_name, snap["W1AW"].first_issued, snap["K0AB"].address, snap["K0AB"].jurisdiction) == ('ARRL, "HQ"', "20200101", None, "united_states")
    with zipfile.ZipFile(tmp_path / "bad.zip", "w") as z:
        z.writestr("usa.csv", "a,b\n1\n")
    with pytest.raises(Exception, match="fields"):
        tables.current_records(spark, str(tmp_path / "bad.zip")).collect()


def test_boundaries_and_counties(spark, tmp_path):
    tables.register(spark)
    (tmp_path / "wc.txt").write_text("# -b -73 -72 41 42 24\n-73.5 41\n-72 42\n# -b 1 2 x 4 5\n9 9\n# -b 0 1 0 1 7\n0.5 0.5\n")
    lines = spark.read.format("numbered_lines").option("path", str(tmp_path / "wc.txt")).load()
    got = tables.parse_boundaries(lines, "world").orderBy("point_no").collect()
    assert [(r.segment_no, r.min_lon, r.next_offset, r.lon, r.lat) for r in got] == [(1, -73.0, 24, -73.5, 41.0), (1, -73.0, 24, -72.0, 42.0), (3, 0.0, 7, 0.5, 0.5)]
    text = ["001*Test County*-73*-72*41*42*24", "-73 41", "# 002|Other County|x|1|2|3|9", "1 2"]
    counties = tables.parse_counties(spark.createDataFrame(list(enumerate(text)), "line_no int, line string")).orderBy("point_no").collect()
    assert [(r.id, r["name"], r.min_lon, r.next_offset, r.lon) for r in counties] == [("001", "Test County", -73.0, 24, None), ("001", "Test County", -73.0, 24, -73.0), ("002", "Other County", None, 9, None), ("002", "Other County", None, 9, 1.0)]
