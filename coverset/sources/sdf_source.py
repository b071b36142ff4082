"""SDF files as a Spark data source, ``spark.read.format("sdf_records")`` and ``spark.readStream``: one row a record."""

from __future__ import annotations

import os
import sys
from collections.abc import Iterator

from pyarrow import fs as pafs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from coverset.session import attach
from coverset.sources.records import RECORD_MARK, parse_records

MARK = RECORD_MARK.encode()
# Bytes of a file that one task reads by default, and of one read.
SPLIT_BYTES, CHUNK = 64 << 20, 1 << 20
# A batch scan of more ranges gets wider ones (up to SPLIT_BYTES), as every range is a task.
MANY_RANGES = 128
PACKED = (".gz", ".bz2", ".zst")


def open_path(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URL or of a local path."""
    return pafs.FileSystem.from_uri(path if "://" in path else "file://" + os.path.abspath(path.removeprefix("file:")))


def data_files(path: str) -> list[tuple[int, str, int]]:
    """``(modified, path, bytes)`` of a file, or of a folder's files but hidden ones, oldest first."""
    system, place = open_path(path)
    found = system.get_file_info(place)
    if found.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    files = [found] if found.type == pafs.FileType.File else system.get_file_info(pafs.FileSelector(place, recursive=True))
    kept = [f for f in files if f.type == pafs.FileType.File and not any(p[:1] in "._" for p in f.path[len(place) :].split("/") if p)]
    return sorted((f.mtime_ns or 0, f.path, f.size) for f in kept)


class Range(InputPartition):
    """The records after the marks that begin in ``start .. end - 1`` of a file; the first record belongs to the first range."""

    def __init__(self, path: str, start: int, end: int | None):
        super().__init__((path, start, end))
        self.path, self.start, self.end = path, start, end


def ranges(files: list[tuple[int, str, int]], split: int) -> list[Range]:
    made = []
    for _, path, size in files:
        if path.lower().endswith(PACKED):
            made.append(Range(path, 0, None))  # a packed file is read from its beginning
        else:
            made += [Range(path, at, min(at + split, size)) for at in range(0, size, split)]
    return made


def read_range(system: pafs.FileSystem, part: Range) -> Iterator[str]:
    """Texts of the records of a range; a mark counts at the beginning of a line."""
    back = min(part.start, 1)
    if part.end is None:
        stream = system.open_input_stream(part.path)
    else:
        stream = system.open_input_file(part.path)
        stream.seek(part.start - back)
    # ``held`` begins at byte ``at`` of the file; a range's own records begin after its first mark.
    held, at, inside = b"", part.start - back, part.start == 0
    looked, body = 0, 0
    # No more at a time than a small range has.
    chunk = CHUNK if part.end is None else min(CHUNK, max(part.end - part.start, 4096))
    while True:
        found = held.find(MARK, looked)
        if found < 0 or (end := held.find(b"\n", found)) < 0:
            more = stream.read(chunk)
            if more:
                # What lies more than a byte before the record at hand, or the next possible mark, is not needed any more.
                again = found if found >= 0 else max(looked, len(held) - len(MARK) + 1)
                drop = max((body if inside else again) - 1, 0)
                held, at, looked, body = held[drop:] + more, at + drop, again - drop, body - drop
                continue
            if found < 0:
                break
            end = len(held)
        if found + at > 0 and held[found - 1 : found] != b"\n" and not (found == 0 and at == 0):
            looked = found + 1
            continue
        if inside:
            yield held[body:found].decode("utf-8", "replace")
        if part.end is not None and at + found >= part.end:
            return
        inside, body, looked = True, min(end + 1, len(held)), min(end + 1, len(held))
    if inside:
        yield held[body:].decode("utf-8", "replace")


class _Reading:
    def __init__(self, options: dict):
        self.path = options["path"]
        self.split = int(options.get("splitBytes", SPLIT_BYTES))

    def read(self, partition: Range) -> Iterator[tuple[str]]:
        system, _ = open_path(self.path)
        for text in read_range(system, partition):
            if text.strip():
                yield (text,)


class SdfReader(_Reading, DataSourceReader):
    def partitions(self) -> list[Range]:
        files = data_files(self.path)
        fair = -(-sum(size for _, _, size in files) // MANY_RANGES)
        return ranges(files, max(self.split, min(fair, SPLIT_BYTES))) or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[tuple[str]]:
        return super().read(partition) if partition.path else iter(())


class SdfStreamReader(_Reading, DataSourceStreamReader):
    """New files of a folder by time; files that were read are not read again when they change."""

    def initialOffset(self) -> dict:
        return {"files": 0}

    def latestOffset(self) -> dict:
        return {"files": len(data_files(self.path))}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return ranges(data_files(self.path)[start["files"] : end["files"]], self.split)

    def commit(self, end: dict) -> None:
        """Nothing is kept between batches."""


class SdfSource(DataSource):
    """Options: ``path`` (file or folder, local or a URL), ``splitBytes``."""

    @classmethod
    def name(cls) -> str:
        return "sdf_records"

    def schema(self) -> str:
        return "record string"

    def reader(self, schema) -> SdfReader:
        return SdfReader(self.options)

    def streamReader(self, schema) -> SdfStreamReader:
        return SdfStreamReader(self.options)


def register(spark: SparkSession) -> SparkSession:
    # Streams are planned by a process of the driver's that does not get shipped files: the classes travel themselves.
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    attach(spark).dataSource.register(SdfSource)
    return spark


def scan_sdf(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Parsed records through the data source, split by byte ranges."""
    return parse_records(register(spark).read.format("sdf_records").option("splitBytes", split_bytes).load(path))


def stream_sdf(spark: SparkSession, path: str) -> DataFrame:
    """Parsed records of files as they arrive in a folder."""
    return parse_records(register(spark).readStream.format("sdf_records").load(path))
