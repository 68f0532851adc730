"""The sorted text index, the inverted index, and the files of fixed-width records, read by ranges."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In

from ..keystream import coded
from . import files
from .records import FolderWriter

RANGE = 8 << 20
_LINE = re.compile(rb"([^ \t\r\n]+) +([0-9]+) *")
_HEADER = re.compile(r"[ -~]{1,100}")
_POSTING = np.dtype([("offset", ">u4"), ("position", "u1")])


# --- text index ------------------------------------------------------------------------------------
class TextIndexReader(DataSourceReader):
    """Lines end with CR LF only; a partition owns the lines that begin in its range. A tail without an end is left out.

    calls: read the lines of these calls alone, with and without years, and the one that follows each call's, found by
    binary search in the sorted file."""

    def __init__(self, path: str, length: int, calls: list[str] | None = None):
        self.path, self.length, self.calls = path, length, calls

    def partitions(self):
        if self.calls is None:
            return files.ranges(self.path, self.length, ".idx")
        found: list[files.ByteRange] = []
        for path, size in files.files(self.path, ".idx"):
            store, at = files.filesystem(path)
            with store.open_input_file(at) as f:
                # no key of another call lies between a call's and that with the character after the colon
                spans = sorted((lower_bound(f, size, c.encode()), lower_bound(f, size, c.encode() + b";") + 1) for c in set(self.calls))
            for a, b in spans:
                if found and found[-1].path == path and a <= found[-1].stop:
                    found[-1].stop = max(found[-1].stop, min(b, size))
                elif a < size:
                    found.append(files.ByteRange(path, a, min(b, size), size))
        return found or [files.ByteRange(self.path, 0, 0, 0)]

    def read(self, part: files.ByteRange) -> Iterator[pa.RecordBatch]:
        if part.start >= part.stop:
            return
        back = min(2, part.start)
        data = files.read(part.path, part.start - back, part.stop)
        first = 0 if not part.start else data.find(b"\r\n") + 2
        if first == 1:  # no line begins here
            return
        stop = part.stop
        while stop < part.size and not data.endswith(b"\r\n"):
            more = files.read(part.path, stop, min(stop + 4096, part.size))
            joined = data[-1:] + more
            cut = joined.find(b"\r\n")
            data += more if cut < 0 else more[: cut + 1]
            stop += len(more)
            if cut >= 0:
                break
        lines = data[first:].split(b"\r\n")[:-1]
        rows, at = [], part.start - back + first
        for line in lines:
            m = _LINE.fullmatch(line)
            good = m and int(m[2]) < 1 << 63
            rows.append({"line_start": at, "line": line.decode("latin-1"), "parsed": bool(good), "key": m[1].decode("latin-1") if good else None, "dat_offset": int(m[2]) if good else None})
            at += len(line) + 2
        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("line_start", pa.int64()), ("line", pa.string()), ("parsed", pa.bool_()), ("key", pa.string()), ("dat_offset", pa.int64())]))


def lower_bound(f: pa.NativeFile, size: int, key: bytes, near: int = 4096) -> int:
    """Where the first line with this key or a greater one begins in a sorted file; its size if there is none. Lines that don't
    parse are passed over."""

    def lines(start: int) -> Iterator[tuple[int, bytes]]:
        data, at = b"", start
        while at < size:
            if (cut := data.find(b"\r\n")) < 0:
                f.seek(at + len(data))
                more = f.read(near)
                if not more:
                    return
                data += more
                continue
            yield at, data[:cut]
            data, at = data[cut + 2 :], at + cut + 2

    low, high = 0, size  # the line looked for begins at low or behind, and at high or before
    while high - low > near:
        middle = (low + high) // 2
        begins = lines(middle)
        next(begins, None)  # the rest of a line
        good = next(((at, m[1]) for at, line in begins if (m := _LINE.fullmatch(line))), None)
        if good is None or good[0] >= high or good[1] >= key:
            high = middle
        else:
            low = good[0]
    return next((at for at, line in lines(low) if (m := _LINE.fullmatch(line)) and m[1] >= key), size)


class TextIndexWriter(FolderWriter):
    ending = ".idx"

    def parts(self, rows):
        for r in rows:
            yield f"{r.key:<15}{r.dat_offset} \r\n".encode("latin-1")


class TextIndex(DataSource):
    @classmethod
    def name(cls):
        return "text_index"

    def schema(self):
        return "line_start long, line string, parsed boolean, key string, dat_offset long"

    def reader(self, schema):
        calls = self.options.get("calls")
        return TextIndexReader(self.options["path"], int(self.options.get("length", RANGE)), None if calls is None else calls.split())

    def writer(self, schema, overwrite):
        return TextIndexWriter(self.options["path"])


# --- inverted index --------------------------------------------------------------------------------
def header(raw: bytes, position: int) -> tuple[str, int | None, int, bool] | None:
    """(key, year, length with its end mark, whether that was there) of an entry at an absolute position."""
    plain = coded(raw[:101], position)
    cut = plain.find(b"\xb5")
    text = plain[: cut if cut >= 0 else len(plain)].decode("latin-1")
    if cut < 0 or not _HEADER.fullmatch(text):
        return None
    call, colon, year = text.rpartition(":")
    dated = bool(colon) and re.fullmatch("[0-9]{4}", year) is not None
    return (call if dated else text), int(year) if dated else None, cut + 1, True


class InvertedIndexReader(DataSourceReader):
    """Big-endian offsets into a file of entries: two files (options path and entries), or a folder of pairs
    `<stem>.index` and `<stem>.entries`. Keys that are asked for by = or IN are looked for in the entries' headers alone; the
    postings of others aren't decoded."""

    def __init__(self, path: str, length: int, entries: str | None = None):
        self.path, self.length, self.entries, self.wanted = path, length, entries, None

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("header_key",):
                keys = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted = keys if self.wanted is None else self.wanted & keys
            yield f  # Spark checks rows again

    def partitions(self):
        made = files.ranges(self.path, self.length, ".index", unit=4)
        for p in made:
            if p.size == 0 or p.size % 4:
                raise ValueError(f"malformed header: {p.path} isn't a sequence of 4-byte offsets")
        return made

    def read(self, part: files.ByteRange) -> Iterator[pa.RecordBatch]:
        body = self.entries or part.path.removesuffix(".index") + ".entries"
        size = files.files(body)[0][1]
        offsets = np.frombuffer(files.read(part.path, part.start, min(part.stop + 4, part.size)), dtype=">u4").astype(np.int64)
        n = (part.stop - part.start) // 4
        ends = np.append(offsets[1:], size)[:n]
        offsets = offsets[:n]
        inside = (offsets <= ends) & (ends <= size)
        store, at = files.filesystem(body)
        with store.open_input_file(at) as f:
            for i in range(0, n, 1024):
                rows = self._rows(f, part, i, offsets[i : i + 1024], ends[i : i + 1024], inside[i : i + 1024])
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=self.arrow)

    def _rows(self, f, part: files.ByteRange, first: int, offsets: np.ndarray, ends: np.ndarray, inside: np.ndarray) -> list[dict]:
        """Entries that lie close together are read at once and sliced."""
        low, high = (int(offsets[inside].min()), int(ends[inside].max())) if inside.any() else (0, 0)
        held = None
        if high - low <= max(1 << 20, 2 * int((ends - offsets)[inside].sum())):
            f.seek(low)
            held = f.read(high - low)

        def read(a: int, b: int) -> bytes:
            if held is not None:
                return held[a - low : b - low]
            f.seek(a)
            return f.read(b - a)

        rows = []
        for k, (a, b, good) in enumerate(zip(offsets.tolist(), ends.tolist(), inside.tolist())):
            raw = read(a, b) if good else b""
            found = header(raw, a)
            if self.wanted is not None and (not found or found[0] not in self.wanted):
                continue
            row: dict = {"path": part.path, "ordinal": part.start // 4 + first + k, "hci_offset": a, "raw_len": b - a if good else None, "terminated": False, "postings": []}
            if found:
                row |= dict(zip(("header_key", "year", "header_len", "terminated"), found))
                chunks = raw[row["header_len"] : -1]
                made = np.frombuffer(chunks, dtype=_POSTING, count=len(chunks) // 5)
                row["postings"] = [{"posting_no": i, "dat_offset": o, "position": p} for i, (o, p) in enumerate(zip(made["offset"].tolist(), made["position"].tolist()))]
            rows.append(row)
        return rows

    arrow = pa.schema(
        [("path", pa.string()), ("ordinal", pa.int64()), ("hci_offset", pa.int64()), ("raw_len", pa.int64()), ("header_key", pa.string()), ("year", pa.int32()), ("header_len", pa.int32()), ("terminated", pa.bool_()),
         ("postings", pa.list_(pa.struct([("posting_no", pa.int64()), ("dat_offset", pa.int64()), ("position", pa.int32())])))]
    )


class InvertedIndexWriter(FolderWriter):
    """rows(header_key, year, postings)."""

    def write(self, rows):
        offsets: list[int] = []

        def entries() -> Iterator[bytes]:
            at = 0
            for r in rows:
                offsets.append(at)
                key = r.header_key + (f":{r.year}" if r.year is not None else "")
                body = coded(key.encode("ascii") + b"\xb5", at) + b"".join(struct.pack(">IB", p.dat_offset, p.position) for p in r.postings) + b"\0"
                at += len(body)
                yield body

        name = files.write_part(self.path, entries(), ".entries")
        if not offsets:
            files.drop([name])
            return files.Written("")
        store, at = files.filesystem(self.path)
        with store.open_output_stream(name.removesuffix(".entries") + ".index") as f:
            f.write(np.array(offsets, dtype=">u4").tobytes())
        return files.Written(name)

    def abort(self, messages):
        files.drop([p for m in messages if m and m.path for p in (m.path, m.path.removesuffix(".entries") + ".index")])


class InvertedIndex(DataSource):
    @classmethod
    def name(cls):
        return "inverted_index"

    def schema(self):
        return "path string, ordinal long, hci_offset long, raw_len long, header_key string, year int, header_len int, terminated boolean, postings array<struct<posting_no: long, dat_offset: long, position: int>>"

    def reader(self, schema):
        return InvertedIndexReader(self.options["path"], int(self.options.get("length", 1 << 18)), self.options.get("entries"))

    def writer(self, schema, overwrite):
        return InvertedIndexWriter(self.options["path"])


# --- fixed widths ----------------------------------------------------------------------------------
SLOT = 33


class CountsReader(DataSourceReader):
    def __init__(self, path: str, length: int):
        self.path, self.length = path, length

    def partitions(self):
        return files.ranges(self.path, self.length, ".counts", unit=SLOT)

    def read(self, part: files.ByteRange) -> Iterator[pa.RecordBatch]:
        plain = coded(files.read(part.path, part.start, part.stop), part.start)
        rows = []
        for i in range(0, len(plain) - SLOT + 1, SLOT):
            text = plain[i : i + SLOT].decode("latin-1")
            count, date = text[15:22].strip(), text[22:30]
            rows.append({"path": part.path, "slot_no": (part.start + i) // SLOT, "key": text[:15].strip(), "count": int(count) if count.isdecimal() else None, "updated": int(date) if date.isdecimal() and 19900101 <= int(date) <= 21000101 else None, "status": text[30]})
        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("path", pa.string()), ("slot_no", pa.int64()), ("key", pa.string()), ("count", pa.int64()), ("updated", pa.int32()), ("status", pa.string())]))


class CountsWriter(FolderWriter):
    ending = ".counts"

    def parts(self, rows):
        for i, r in enumerate(rows):
            yield coded(f"{r.key:<15}{r['count']:>7}{r.updated:08d}{r.status}\r\n".encode("latin-1"), i * SLOT)


class LookupCounts(DataSource):
    @classmethod
    def name(cls):
        return "lookup_counts"

    def schema(self):
        return "path string, slot_no long, key string, count long, updated int, status string"

    def reader(self, schema):
        return CountsReader(self.options["path"], int(self.options.get("length", RANGE)))

    def writer(self, schema, overwrite):
        return CountsWriter(self.options["path"])


class StateReader(DataSourceReader):
    def __init__(self, path: str, length: int):
        self.path, self.length = path, length

    def partitions(self):
        return files.ranges(self.path, self.length, ".state", unit=6)

    def read(self, part: files.ByteRange) -> Iterator[pa.RecordBatch]:
        data = files.read(part.path, part.start, part.stop)
        v = np.frombuffer(data[: len(data) // 6 * 6], dtype="<i2").reshape(-1, 3)
        n = len(v)
        yield pa.RecordBatch.from_arrays([pa.array([part.path] * n, pa.string()), pa.array(part.start // 6 + np.arange(n)), *(pa.array(v[:, k].astype(np.int16)) for k in range(3))], ["path", "point_no", "command", "lat_min", "lon_min"])


class StateWriter(FolderWriter):
    ending = ".state"

    def parts(self, rows):
        for r in rows:
            yield struct.pack("<hhh", r.command, r.lat_min, r.lon_min)


class StateVectors(DataSource):
    @classmethod
    def name(cls):
        return "state_vectors"

    def schema(self):
        return "path string, point_no long, command short, lat_min short, lon_min short"

    def reader(self, schema):
        return StateReader(self.options["path"], int(self.options.get("length", 6 << 16)))

    def writer(self, schema, overwrite):
        return StateWriter(self.options["path"])
