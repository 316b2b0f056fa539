"""Log folders as a Spark data source: plain, gzip and zip files, told apart by their first bytes.

``spark.read.format("packed_log").load(folder)`` has a row per line, with the file and, for
archives, the member that it stands in. Every member of an archive is a partition of its own, and
so is every gzip file and every range of a plain file; each is read as a stream. What cannot be
read to its end gives a row without a line that says why, and the rest is read on.
"""

from __future__ import annotations

import gzip
import io
import zipfile
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

NAME = "packed_log"
SCHEMA = "path string, member string, line string, error string"
COLUMNS = ["path", "member", "line", "error"]
ZIP, GZIP = b"PK\x03\x04", b"\x1f\x8b"
EMPTY_ZIP = b"PK\x05\x06"
BATCH_LINES = 10_000
RANGE_BYTES = 128 << 20
LISTING_THREADS = 32
BUFFER_BYTES = 1 << 20


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path within it; a path without a scheme is local."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def can_read(path: str) -> bool:
    """Whether the path lies in a store that this source can open by itself."""
    try:
        opened(path)
    except (pa.ArrowException, OSError, ValueError):
        return False
    return True


class Stored(io.RawIOBase):
    """A stored file as Python's readers expect one: a wrong position is an OSError."""

    def __init__(self, path: str, root: str):
        self.file = opened(root)[0].open_input_file(path)

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        return self.file.readinto(buffer)

    def tell(self) -> int:
        return self.file.tell()

    def seek(self, offset: int, whence: int = 0) -> int:
        try:
            return self.file.seek(offset, whence)
        except pa.ArrowInvalid as wrong:
            raise OSError(str(wrong)) from wrong

    def close(self) -> None:
        self.file.close()
        super().close()


def stored(path: str, root: str) -> io.BufferedReader:
    return io.BufferedReader(Stored(path, root), BUFFER_BYTES)


@dataclass
class Piece(InputPartition):
    """A part of a file: an archive member, a whole gzip file or a range of a plain one; or what was wrong with the file."""

    root: str
    path: str
    kind: str
    member: str | None = None
    place: int = 0
    start: int = 0
    end: int = 0
    error: str | None = None


def pieces_of(root: str, info: fs.FileInfo, range_bytes: int) -> list[Piece]:
    """How one file is read; of a zip file only the list of its members is looked at."""
    try:
        with stored(info.path, root) as stream:
            head = stream.read(4)
            if head[:2] == GZIP:
                return [Piece(root, info.path, "gzip")]
            if head in (ZIP, EMPTY_ZIP):
                with zipfile.ZipFile(stream) as archive:
                    return [Piece(root, info.path, "zip", m.filename, place) for place, m in enumerate(archive.infolist()) if not m.is_dir()]
    except (OSError, zipfile.BadZipFile) as failure:
        return [Piece(root, info.path, "", error=f"{type(failure).__name__}: {failure}")]
    return [Piece(root, info.path, "plain", start=at, end=min(info.size, at + range_bytes)) for at in range(0, info.size, range_bytes)]


def lines_of(stream) -> Iterator[str]:
    """Lines of a binary stream, ended by a line feed; bytes that are not UTF-8 are replaced."""
    for line in io.TextIOWrapper(stream, encoding="utf-8", errors="replace", newline="\n"):
        yield line.rstrip("\r\n")


def lines_of_range(stream, start: int, end: int) -> Iterator[str]:
    """Lines that begin in [start, end) of a plain file."""
    at = max(0, start - 1)
    stream.seek(at)
    if start:
        at += len(stream.readline())  # the end of a line that began before
    while at < end and (line := stream.readline()):
        at += len(line)
        yield line.decode("utf-8", "replace").rstrip("\r\n")


class PackedLogReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = options["path"]
        self.range_bytes = int(options.get("rangebytes", RANGE_BYTES))
        self.least = int(options.get("batchlines", BATCH_LINES))

    def partitions(self) -> list[Piece]:
        system, base = opened(self.root)
        info = system.get_file_info(base)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.root)
        files = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(base, recursive=True))
        below = len(base.rstrip("/"))
        wanted = [f for f in files if f.type == fs.FileType.File and not any(part[:1] in (".", "_") for part in f.path[below:].split("/"))]
        with ThreadPoolExecutor(LISTING_THREADS) as pool:
            found = [p for pieces in pool.map(lambda f: pieces_of(self.root, f, self.range_bytes), wanted) for p in pieces]
        return found or [Piece(self.root, base, "")]

    def read(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        waiting: list[str] = []

        def batch(lines: list[str | None], error: str | None = None) -> pa.RecordBatch:
            own = [[piece.path] * len(lines), [piece.member] * len(lines), lines, [error] * len(lines)]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in own], COLUMNS)

        failure = piece.error
        try:
            for line in self._lines(piece):
                waiting.append(line)
                if len(waiting) >= self.least:
                    yield batch(waiting)
                    waiting = []
        except Exception as wrong:  # damaged, encrypted or of an unknown method: the row below says which
            failure = f"{type(wrong).__name__}: {wrong}"
        if waiting:
            yield batch(waiting)
        if failure:
            yield batch([None], failure)

    def _lines(self, piece: Piece) -> Iterator[str]:
        if not piece.kind:
            return
        with stored(piece.path, piece.root) as stream:
            if piece.kind == "plain":
                yield from lines_of_range(stream, piece.start, piece.end)
            elif piece.kind == "gzip":
                with gzip.GzipFile(fileobj=stream) as unpacked:
                    yield from lines_of(unpacked)
            else:
                with zipfile.ZipFile(stream) as archive, archive.open(archive.infolist()[piece.place]) as unpacked:
                    yield from lines_of(unpacked)


class PackedLog(DataSource):
    """Options: ``rangeBytes`` of a plain file read by one task."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PackedLogReader:
        return PackedLogReader(self.options)


def read_packed_log(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """Rows (path, member, line, error) of all files below ``path``."""
    spark.dataSource.register(PackedLog)
    return spark.read.format(NAME).options(**options).load(path)
