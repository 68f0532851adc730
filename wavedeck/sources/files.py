"""Files of byte ranges behind the custom data sources, on any store that Arrow opens."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import InputPartition, WriterCommitMessage


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def qualified(spark: SparkSession, path: str) -> str:
    """A path without a scheme in the session's default store, as Spark's own readers take it."""
    store = spark._jsc.hadoopConfiguration().get("fs.defaultFS") or "file:///"
    return path if "://" in path or path.startswith("file:") or store.startswith("file:") else f"{store.rstrip('/')}/{path.lstrip('/')}"


def files(path: str, ending: str = "") -> list[tuple[str, int]]:
    """(path, size) of a file, or of the files in a folder, by name."""
    store, at = filesystem(path)
    info = store.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    found = store.get_file_info(fs.FileSelector(at))
    base = path[: len(path) - len(at)] if path.endswith(at) else ""
    return [(base + f.path, f.size) for f in sorted(found, key=lambda f: f.path) if f.type == fs.FileType.File and f.path.endswith(ending) and not f.base_name.startswith(("_", "."))]


def read(path: str, start: int, stop: int | None = None) -> bytes:
    store, at = filesystem(path)
    with store.open_input_file(at) as f:
        f.seek(min(start, f.size()))
        return f.read() if stop is None else f.read(max(0, stop - start))


@dataclass
class ByteRange(InputPartition):
    path: str
    start: int
    stop: int
    size: int


@dataclass
class Written(WriterCommitMessage):
    path: str


def ranges(path: str, length: int, ending: str = "", unit: int = 1) -> list[ByteRange]:
    """Ranges of about `length` bytes, whole units each."""
    length = max(unit, length // unit * unit)
    return [ByteRange(p, a, min(a + length, n), n) for p, n in files(path, ending) for a in range(0, n, length)]


def begin_folder(path: str) -> None:
    store, at = filesystem(path)
    store.create_dir(at, recursive=True)


def write_part(path: str, data: Iterator[bytes], ending: str) -> str:
    """One new file in the folder, from parts that come one after another."""
    store, at = filesystem(path)
    name = f"{at.rstrip('/')}/part-{uuid.uuid4().hex}{ending}"
    with store.open_output_stream(name) as f:
        for part in data:
            f.write(part)
    return name


def drop(paths: list[str]) -> None:
    for p in paths:
        store, at = filesystem(p)
        store.delete_file(at)
