"""Tagged records: `0xB5 KEY (TAG VALUE)*`, position-coded, read by byte ranges and written by tasks.

A partition owns the records that begin in its range and reads on to the end of the last one. Every file of a folder
is coded from its own beginning.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, In

from ..functions.normalize import FIELDS, TAG_NAMES, hex_preview, text_preview
from ..keystream import coded
from . import files

BEGIN, FIRST_TAG, LAST_TAG = 0xB5, 0xB6, 0xDF
RANGE, AHEAD = 8 << 20, 1 << 16
_KEY = re.compile(rb"[A-Z0-9/]{1,12}(:\+?[0-9]+)?")
_SPLIT = re.compile(rb"[\xB6-\xDF]")
_WRITTEN = re.compile("[ -~\xB5-\xDF]*")
_CALL = re.compile(rb"[\x00\t\n\f\r ]*([A-Z0-9/]*)")
_PRINTABLE = re.compile(rb"[ -~]+")
_BLANK = b"\x00\t\n\f\r "
SCHEMA = "path string, rec_start long, rec_end long, rec_terminated boolean, callsign string, vintage int, " + ", ".join(f"{f} string" for f in FIELDS) + ", raw_tags map<string,string>"
_TAG_OF = {name: tag for tag, name in reversed(TAG_NAMES.items())}


def parse(body: bytes, default_key: str | None = None) -> dict | None:
    """The record behind a begin mark; None where its key isn't one. A key that starts at its year takes the default
    key's call. Values with bytes that don't print are left out; of a tag's values the last one counts."""
    cuts = [m.start() for m in _SPLIT.finditer(body)] + [len(body)]
    key = body[: cuts[0]].strip(_BLANK)
    if key.startswith(b":"):
        if default_key is None:
            return None
        key = default_key.partition(":")[0].encode() + key
    if not _KEY.fullmatch(key):
        return None
    call, _, year = key.decode().partition(":")
    if year and int(year) > 65535:
        return None
    row: dict = {"callsign": call, "vintage": int(year) if year else None, "raw_tags": []}
    raw: dict[str, str] = {}
    for a, b in zip(cuts, cuts[1:]):
        value = body[a + 1 : b].strip(_BLANK)
        if value and _PRINTABLE.fullmatch(value):
            tag = f"{body[a]:02x}"
            if tag in TAG_NAMES:
                row[TAG_NAMES[tag]] = value.decode()
            else:
                raw[tag] = value.decode()
    row["raw_tags"] = sorted(raw.items())
    return row


def parse_slice(data: bytes, default_key: str | None = None, complete: bool = False) -> list[dict]:
    """All records of a decoded slice, which may begin inside one's key; complete: without the last one, whose end isn't seen."""
    parts = data.split(bytes([BEGIN]))
    head = [parse(parts[0], default_key)] if default_key and parts[0] else []
    rest = parts[1:-1] if complete else parts[1:]
    return [r for r in [*head, *map(parse, rest)] if r]


def bodies(part: files.ByteRange) -> tuple[bytes, list[int], list[int]]:
    """The decoded bytes from a range's start to the end of the last record that begins in it, and where its records
    begin and end there."""
    plain = coded(files.read(part.path, part.start, part.stop), part.start)
    starts = [m.start() for m in re.finditer(rb"\xB5", plain)]
    if not starts:
        return b"", [], []
    end, terminated = part.stop, False
    while end < part.size and not terminated:  # the last record goes on
        more = coded(files.read(part.path, end, min(end + AHEAD, part.size)), end)
        cut = more.find(bytes([BEGIN]))
        terminated = cut >= 0
        plain += more[:cut] if terminated else more
        end += cut if terminated else len(more)
    return plain, starts, [*starts[1:], end - part.start]


class RecordReader(DataSourceReader):
    """Calls that are asked for by = or IN are looked for in the keys alone; other records aren't parsed."""

    def __init__(self, path: str, length: int):
        self.path, self.length, self.wanted = path, length, None

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("callsign",):
                calls = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted = calls if self.wanted is None else self.wanted & calls
            yield f  # Spark checks rows again

    def partitions(self):
        return files.ranges(self.path, self.length, ".dat")

    def read(self, part: files.ByteRange) -> Iterator[pa.RecordBatch]:
        plain, starts, ends = bodies(part)
        if self.wanted is not None:
            calls = {c.encode() for c in self.wanted if c is not None}
            some = [(a, b) for a, b in zip(starts, ends) if _CALL.match(plain, a + 1, min(b, a + 64))[1] in calls]
            starts, ends = [a for a, _ in some], [b for _, b in some]
        for at in range(0, len(starts), 4096):
            rows, spans = [], []
            for a, b in zip(starts[at : at + 4096], ends[at : at + 4096]):
                if row := parse(plain[a + 1 : b]):
                    rows.append(row)
                    spans.append((part.start + a, part.start + b))
            if rows:
                begin, end = (np.array(x, dtype=np.int64) for x in zip(*spans))
                yield pa.RecordBatch.from_arrays([pa.array([part.path] * len(rows)), pa.array(begin), pa.array(end), pa.array(end < part.size), *columns(rows, _ARROW.names[4:])], schema=_ARROW)


def columns(rows: list[dict], names: list[str]) -> list[pa.Array]:
    """Columns of rows that have few of them each: values are put where they stand instead of being asked for one by one."""
    places: dict[str, list] = {name: [None] * len(rows) for name in names}
    for i, row in enumerate(rows):
        for name, value in row.items():
            places[name][i] = value
    return [pa.array(places[name], _ARROW.field(name).type) for name in names]


class RecordTagsReader(DataSourceReader):
    def __init__(self, path: str, length: int):
        self.path, self.length = path, length

    def partitions(self):
        return files.ranges(self.path, self.length, ".dat")

    def read(self, part: files.ByteRange) -> Iterator[pa.RecordBatch]:
        plain, starts, ends = bodies(part)
        schema = pa.schema([("path", pa.string()), ("rec_start", pa.int64()), ("key", pa.string()), ("tags", pa.list_(pa.struct([("tag", pa.string()), ("value", pa.string())])))])
        for at in range(0, len(starts), 4096):
            rows = []
            for a, b in zip(starts[at : at + 4096], ends[at : at + 4096]):
                body = plain[a + 1 : b]
                cuts = [m.start() for m in _SPLIT.finditer(body)] + [len(body)]
                tags = [{"tag": f"{body[x]:02x}", "value": body[x + 1 : y].decode("utf-8", "replace")} for x, y in zip(cuts, cuts[1:])]
                rows.append({"path": part.path, "rec_start": part.start + a, "key": body[: cuts[0]].decode("utf-8", "replace"), "tags": tags})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)


_ARROW = pa.schema(
    [("path", pa.string()), ("rec_start", pa.int64()), ("rec_end", pa.int64()), ("rec_terminated", pa.bool_()), ("callsign", pa.string()), ("vintage", pa.int32()), *((f, pa.string()) for f in FIELDS), ("raw_tags", pa.map_(pa.string(), pa.string()))]
)


def read_slices(entries: DataFrame, path: str, complete: bool = False) -> DataFrame:
    """entries(key, dat_offset, slice_end) -> the records of each key's call in its slice of the file, in order: key,
    dat_offset, slice_no and the records' columns. A slice may begin inside a key: the call is then the entry's.
    complete: without a record whose end the slice doesn't show."""
    schema = pa.schema([("key", pa.string()), ("dat_offset", pa.int64()), ("slice_no", pa.int64()), *((f.name, f.type) for f in _ARROW if f.name not in ("path", "rec_start", "rec_end", "rec_terminated"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = files.filesystem(path)
        with store.open_input_file(at) as f:
            for batch in batches:
                rows = []
                for key, start, stop in zip(*(batch.column(c).to_pylist() for c in range(3))):
                    f.seek(start)
                    found = parse_slice(coded(f.read(max(0, stop - start)), start), key, complete)
                    rows += [r | {"key": key, "dat_offset": start, "slice_no": i} for i, r in enumerate(found) if r["callsign"] == key.partition(":")[0]]
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    kinds = "key string, dat_offset long, slice_no long, callsign string, vintage int, " + ", ".join(f"{x} string" for x in FIELDS) + ", raw_tags map<string,string>"
    return entries.select("key", "dat_offset", "slice_end").mapInArrow(run, kinds)


#: Window sizes that are tried in turn behind a posting without a matching record: complete records, then in the last one any.
WINDOWS = (1024, 2048, 4096, 8192)


def read_postings(postings: DataFrame, path: str) -> DataFrame:
    """postings(header_key, ordinal, posting_no, dat_offset) -> the records that they lead to, with ordinal and posting_no: the
    record that holds the offset if it is the call's, else those of the first window behind it that has some. For few
    postings: each reads its own bytes of the file."""
    names = [f.name for f in _ARROW if f.name not in ("path", "rec_start", "rec_end", "rec_terminated")]
    schema = pa.schema([("ordinal", pa.int64()), ("posting_no", pa.int64()), *((n, _ARROW.field(n).type) for n in names)])

    def holding(f: pa.NativeFile, size: int, at: int) -> dict | None:
        start = stop = at
        head = tail = b""
        mark = bytes([BEGIN])
        while start > 0 and mark not in head:  # back to the record's beginning; the byte at the offset may be it
            before = max(0, start - WINDOWS[0])
            f.seek(before)
            head, start = coded(f.read((start if head else min(size, at + 1)) - before), before) + head, before
        if mark not in head:
            return None
        while stop < size and mark not in tail[1:]:
            f.seek(at + len(tail))
            more = f.read(WINDOWS[0])
            if not more:
                break
            tail, stop = tail + coded(more, at + len(tail)), at + len(tail) + len(more)
        body = head[head.rindex(mark) : len(head) - 1] + tail
        return parse(body[1:].split(mark)[0])

    def found(f: pa.NativeFile, size: int, call: str, at: int) -> list[dict]:
        if at >= size:
            return []
        own = holding(f, size, at)
        if own and call in (own["callsign"], own["callsign"][1:]):
            return [own]
        f.seek(at)
        data = coded(f.read(WINDOWS[-1]), at)
        for n in WINDOWS:
            if made := [r for r in parse_slice(data[:n], complete=n < WINDOWS[-1]) if r["callsign"] == call]:
                return made
        return []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, place = files.filesystem(path)
        with store.open_input_file(place) as f:
            size = f.size()
            for batch in batches:
                rows = [(o, p, r) for call, o, p, at in zip(*(batch.column(c).to_pylist() for c in range(4))) for r in found(f, size, call, at)]
                keys = [pa.array([r[i] for r in rows], pa.int64()) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*keys, *columns([r[2] for r in rows], names)], schema=schema)

    kinds = "ordinal long, posting_no long, callsign string, vintage int, " + ", ".join(f"{x} string" for x in FIELDS) + ", raw_tags map<string,string>"
    return postings.select("header_key", "ordinal", "posting_no", "dat_offset").mapInArrow(run, kinds)


def read_windows(offsets: DataFrame, path: str, length: int) -> DataFrame:
    """offsets(dat_offset) -> with `raw`, the decoded bytes from there on, and previews of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = files.filesystem(path)
        with store.open_input_file(at) as f:
            for batch in batches:
                raw = []
                for start in batch.column(0).to_pylist():
                    f.seek(min(start, f.size()))
                    raw.append(coded(f.read(length), start))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], ["dat_offset", "raw"])

    made = offsets.select("dat_offset").mapInArrow(run, "dat_offset long, raw binary")
    return made.select("*", hex_preview(F.col("raw"), 16).alias("hex"), text_preview(F.col("raw"), 64).alias("text"))


def encoder(names: list[str]) -> Callable[[Sequence], bytes]:
    """For rows with these fields in this order: a record's plain bytes."""
    place = {name: i for i, name in enumerate(names)}
    marked = [(place[f], chr(int(_TAG_OF[f], 16))) for f in FIELDS if f in place]
    call, vintage, raw = place["callsign"], place.get("vintage"), place.get("raw_tags")

    def encode(row: Sequence) -> bytes:
        out = [chr(BEGIN), row[call]]
        if vintage is not None and row[vintage] is not None:
            out.append(f":{row[vintage]}")
        out += [mark + row[i] for i, mark in marked if row[i]]
        if raw is not None and row[raw]:
            out += [chr(int(tag, 16)) + value for tag, value in sorted(row[raw].items())]
        text = "".join(out)
        if not _WRITTEN.fullmatch(text):
            raise ValueError(f"a record's values are printable ASCII: {row[call]}")
        return text.encode("latin-1")

    return encode


class FolderWriter(DataSourceWriter):
    """Each task writes a file of its own; files of failed tasks go."""

    ending = ""

    def __init__(self, path: str):
        self.path = path
        files.begin_folder(path)

    def parts(self, rows) -> Iterator[bytes]:
        raise NotImplementedError

    def write(self, rows):
        return files.Written(files.write_part(self.path, self.parts(rows), self.ending))

    def abort(self, messages):
        files.drop([m.path for m in messages if m])


class RecordWriter(FolderWriter):
    ending = ".dat"

    def parts(self, rows) -> Iterator[bytes]:
        position, held, size, made = 0, [], 0, None
        for row in rows:
            made = made or encoder(row.__fields__)
            plain = made(row)
            held.append(plain)
            size += len(plain)
            if size >= 1 << 20:
                yield coded(b"".join(held), position)
                position, held, size = position + size, [], 0
        yield coded(b"".join(held), position)


class RecordTags(DataSource):
    """All records as they stand, whatever their keys: tags with their values in order, repeated and unknown ones too."""

    @classmethod
    def name(cls):
        return "record_tags"

    def schema(self):
        return "path string, rec_start long, key string, tags array<struct<tag: string, value: string>>"

    def reader(self, schema):
        return RecordTagsReader(self.options["path"], int(self.options.get("length", RANGE)))


class TaggedRecords(DataSource):
    """Options: path, length (bytes of a partition)."""

    @classmethod
    def name(cls):
        return "tagged_records"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return RecordReader(self.options["path"], int(self.options.get("length", RANGE)))

    def writer(self, schema, overwrite):
        return RecordWriter(self.options["path"])
