"""Small text tables and the zipped table of current records."""

from __future__ import annotations

import csv
import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import normalize as N
from ..operators import layers
from . import files
from .indexes import InvertedIndex, LookupCounts, StateVectors, TextIndex
from .records import RecordTags, TaggedRecords

#: Columns of the current records, by place; fixed values.
CURRENT = ("callsign", "class", "name", "address", "city", "state", "zip", "county", "issue_date", "transaction_type")


class NumberedLinesReader(DataSourceReader):
    """One partition a file: these tables have some hundred lines each."""

    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        return [InputPartition(p) for p, _ in files.files(self.path)]

    def read(self, part: InputPartition) -> Iterator[pa.RecordBatch]:
        lines = files.read(part.value, 0).decode("latin-1").splitlines()
        yield pa.RecordBatch.from_arrays([pa.array([part.value] * len(lines), pa.string()), pa.array(range(len(lines)), pa.int64()), pa.array(lines, pa.string())], ["path", "line_no", "line"])


class NumberedLines(DataSource):
    @classmethod
    def name(cls):
        return "numbered_lines"

    def schema(self):
        return "path string, line_no long, line string"

    def reader(self, schema):
        return NumberedLinesReader(self.options["path"])


class ZippedTableReader(DataSourceReader):
    """A zip file can't be split; its member is streamed."""

    def __init__(self, path: str, member: str):
        self.path, self.member = path, member

    def read(self, part) -> Iterator[pa.RecordBatch]:
        store, at = files.filesystem(self.path)
        schema = pa.schema([("row_no", pa.int64()), *((c, pa.string()) for c in CURRENT)])
        with store.open_input_file(at) as f, zipfile.ZipFile(f) as z, z.open(self.member) as member:
            rows, width = [], None
            for no, row in enumerate(csv.reader(io.TextIOWrapper(member, encoding="utf-8", errors="replace", newline=""))):
                if width is not None and len(row) != width:
                    raise ValueError(f"row {no} has {len(row)} fields, not {width}")
                if width is None:
                    width = len(row)
                    continue
                cut = [x.strip(" \t\n\f\r") for x in row[: len(CURRENT)]]
                rows.append({"row_no": no} | dict(zip(CURRENT, cut + [""] * (len(CURRENT) - len(cut)))))
                if len(rows) == 8192:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)


class ZippedTable(DataSource):
    """Options: path, member."""

    @classmethod
    def name(cls):
        return "zipped_table"

    def schema(self):
        return "row_no long, " + ", ".join(f"{c} string" for c in CURRENT)

    def reader(self, schema):
        return ZippedTableReader(self.options["path"], self.options.get("member", "usa.csv"))


def register(spark: SparkSession) -> None:
    """Make the sources known to the session, and let it hand filters to those that take some."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (TaggedRecords, RecordTags, TextIndex, InvertedIndex, LookupCounts, StateVectors, NumberedLines, ZippedTable):
        spark.dataSource.register(source)


def current_records(spark: SparkSession, path: str) -> DataFrame:
    """Current records by normalised key, the last row of a key; rows without a call are left out."""
    rows = spark.read.format("zipped_table").option("path", path).load().withColumn("key", N.lookup_key(F.col("callsign"))).where("key is not null")
    return rows.groupBy("key").agg(F.max_by(F.struct(*CURRENT), "row_no").alias("r")).select("key", "r.*")


def as_snapshots(current: DataFrame) -> DataFrame:
    """Current records in the records' schema: the whole name stands in last_name."""
    filled = lambda c: N.blank_to_null(F.trim(c))
    return current.select(
        F.col("key").alias("callsign"), F.lit(None).cast("int").alias("vintage"), filled("class").alias("license_class"), filled("name").alias("last_name"), filled("address").alias("address"), filled("city").alias("city"),
        filled("state").alias("state_or_province"), filled("zip").alias("postal_code"), filled("county").alias("county"), filled("issue_date").alias("first_issued"), filled("transaction_type").alias("fcc_transaction_type"),
        F.lit("United States").alias("country"), F.lit("united_states").alias("jurisdiction"),
    )


def parse_boundaries(lines: DataFrame, kind: str) -> DataFrame:
    """`# -b min_lon max_lon min_lat max_lat next` headers and `lon lat` lines -> kind, segment_no, declared bounds,
    next_offset, point_no, lon, lat. Points behind a malformed header are left out."""
    text = N.trim_ascii(F.col("line"))
    parts = F.filter(F.split(F.regexp_replace(text, r"\A#\s*-b\s*", ""), r"\s+"), lambda p: p != "")
    numbers = F.transform(parts, lambda p: N.number(p))
    marked = layers.segments(lines.withColumn("n", numbers), text.startswith("#"), "line_no")
    good = F.when(text.startswith("#"), F.struct(*(F.get("n", F.lit(i)).alias(c) for i, c in enumerate(("min_lon", "max_lon", "min_lat", "max_lat"))), F.get("n", F.lit(4)).cast("long").alias("next_offset"), ((F.size("n") == 5) & ~F.exists("n", lambda x: x.isNull())).alias("good")))
    carried = layers.carry_down(marked.withColumn("h", good), F.col("h"), "line_no")
    points = carried.where(~text.startswith("#") & F.col("carried.good") & (F.size("n") >= 2))
    return points.select(F.lit(kind).alias("kind"), "segment_no", "carried.min_lon", "carried.max_lon", "carried.min_lat", "carried.max_lat", "carried.next_offset", F.col("line_no").alias("point_no"), F.get("n", F.lit(0)).alias("lon"), F.get("n", F.lit(1)).alias("lat")).where("lon is not null and lat is not null")


def parse_counties(lines: DataFrame) -> DataFrame:
    """The three dialects of county headers: as boundaries, `#`-marked fields by bars, fields by asterisks."""
    text = F.regexp_replace(N.trim_ascii(F.col("line")), r"\A#\s*", "")
    sep = F.when(text.contains("|"), r"\|").when(text.contains("*"), r"\*").otherwise(r"\s+")
    parts = F.transform(F.split(text, sep), lambda p: N.trim_ascii(p))
    is_header = F.col("line").startswith("#") | text.contains("|") | text.contains("*")
    value = lambda i: N.number(F.get("p", F.lit(i)))
    bounds = [value(i) for i in range(2, 6)]
    known = bounds[0].isNotNull() & bounds[1].isNotNull() & bounds[2].isNotNull() & bounds[3].isNotNull()
    head = F.when(F.col("is_header"), F.struct(F.get("p", F.lit(0)).alias("id"), F.get("p", F.lit(1)).alias("name"), *(F.when(known, b).alias(c) for b, c in zip(bounds, ("min_lon", "max_lon", "min_lat", "max_lat"))), value(6).cast("long").alias("next_offset")))
    marked = layers.segments(lines.withColumn("p", parts).withColumn("is_header", is_header), is_header, "line_no")
    carried = layers.carry_down(marked.withColumn("h", head), F.col("h"), "line_no").where("segment_no > 0")
    return carried.select("segment_no", "carried.*", "is_header", F.col("line_no").alias("point_no"), F.when(~F.col("is_header"), value(0)).alias("lon"), F.when(~F.col("is_header"), value(1)).alias("lat"))
