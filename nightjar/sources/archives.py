"""Zip archives as a table of their entries, read by ranges."""

from __future__ import annotations

import re
import zipfile
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringContains, StringEndsWith, StringStartsWith

from nightjar.sources.listening import ENTRY_KEEP, ENTRY_SKIP

#: compressed bytes of small entries that one task reads, and of one range read
TASK_BYTES, CHUNK = 64 << 20, 4 << 20
TESTS: dict[type, Callable[[str, object], bool]] = {
    EqualTo: lambda v, x: v == x, In: lambda v, x: v in x, StringStartsWith: lambda v, x: v.startswith(x), StringEndsWith: lambda v, x: v.endswith(x), StringContains: lambda v, x: x in v,
}


@dataclass
class Entry:
    archive: str
    name: str
    at: int  # of its local header
    packed: int
    size: int
    method: int
    crc: int


@dataclass
class Entries(InputPartition):
    entries: list[Entry]


def file_of(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*:", path) else (fs.LocalFileSystem(), path)


def archives_at(path: str) -> list[str]:
    """The path itself, or the archives of a folder in order of name."""
    system, place = file_of(path)
    if system.get_file_info(place).type != fs.FileType.Directory:
        return [path]
    found = sorted(i.path for i in system.get_file_info(fs.FileSelector(place, recursive=True)) if i.path.lower().endswith(".zip"))
    return [path.rstrip("/") + p.removeprefix(place.rstrip("/")) for p in found]


def directory(path: str) -> list[Entry]:
    """Files of an archive from its end record and central directory (of ZIP64, too); nothing else is read."""
    system, place = file_of(path)
    with system.open_input_file(place) as f:
        try:
            infos = zipfile.ZipFile(f).infolist()
        except zipfile.BadZipFile as e:
            raise ValueError(f"Not a zip file: {path}") from e
    if not infos:
        raise ValueError(f"Zip contains no files: {path}")
    return [Entry(path, i.filename, i.header_offset, i.compress_size, i.file_size, i.compress_type, i.CRC) for i in infos if not i.is_dir()]


def inflate(e: Entry) -> bytes:
    """An entry's bytes by range reads of its own part of the archive; a damaged entry is an error."""
    if e.method not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
        raise ValueError(f"Unsupported compression method {e.method}: {e.name}")
    system, place = file_of(e.archive)
    with system.open_input_file(place) as f:
        f.seek(e.at)
        head = f.read(30)
        if head[:4] != b"PK\x03\x04":
            raise ValueError(f"Corrupt entry: {e.name}")
        f.seek(e.at + 30 + int.from_bytes(head[26:28], "little") + int.from_bytes(head[28:30], "little"))
        pump, out, left = zlib.decompressobj(-15) if e.method else None, [], e.packed
        while left and (raw := f.read(min(CHUNK, left))):
            left -= len(raw)
            out.append(pump.decompress(raw) if pump else raw)
    data = b"".join([*out, pump.flush() if pump else b""])
    if len(data) != e.size or zlib.crc32(data) != e.crc:
        raise ValueError(f"Corrupt entry: {e.name}")
    return data


class ZipReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.paths = [p for p in options.get("paths", options.get("path", "")).split(",") if p]
        self.keep, self.skip = options.get("keep", ENTRY_KEEP), options.get("skip", ENTRY_SKIP)
        self.tests: list[tuple[str, Callable[[str, object], bool], object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Filters on names are taken; the others are Spark's."""
        for f in filters:
            if type(f) in TESTS and f.attribute in (("entry",), ("archive",)):
                self.tests.append((f.attribute[0], TESTS[type(f)], f.value))
            else:
                yield f

    def _wanted(self, column: str, value: str) -> bool:
        return all(test(value, x) for c, test, x in self.tests if c == column)

    def partitions(self) -> list[InputPartition]:
        """Wanted entries, small neighbours together; archives that a filter leaves out aren't opened."""
        parts, room = [], 0
        for archive in (a for p in self.paths for a in archives_at(p) if self._wanted("archive", a)):
            for e in directory(archive):
                if re.search(self.keep, e.name) and not (self.skip and re.search(self.skip, e.name)) and self._wanted("entry", e.name):
                    if not parts or room < e.packed:
                        parts.append(Entries([]))
                        room = TASK_BYTES
                    parts[-1].entries.append(e)
                    room -= e.packed
        return parts or [Entries([])]

    def read(self, part: Entries) -> Iterator[tuple]:
        for e in part.entries:
            yield e.archive, e.name, e.size, inflate(e).decode("utf-8", "replace")


class ZipSource(DataSource):
    """``spark.read.format("zip_entries").option("paths", "a.zip,s3://bucket/folder")``: one row per listening file of each archive.

    A path is an archive or a folder of archives, on any store that pyarrow opens; ``keep`` and ``skip`` are expressions on entry names.
    Planning reads central directories only.  Filters on ``entry`` and ``archive`` (=, IN, LIKE 'x%', '%x', '%x%') are applied to them, so that what
    isn't wanted is never read; tasks hold one entry at a time, never an archive.
    """

    @classmethod
    def name(cls) -> str:
        return "zip_entries"

    def schema(self) -> str:
        return "archive string, entry string, size long, text string"

    def reader(self, schema) -> ZipReader:
        return ZipReader(self.options)
