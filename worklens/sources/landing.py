"""Landed payloads as a table and as a stream: JSON lines in numbered folders, read in the order in which they landed.

A landing is a folder below the path, named by when it landed, so that names rise; it counts once its
``_SUCCESS`` file is there. A stream's offset is the name of the last landing, not a time of files, so copying or
touching files changes nothing and a restart goes on behind the last committed landing. Files are read in
parallel, a large file by several tasks, and a line in batches, so no task holds a file.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "landed string, file string, at long, line string"
#: Bytes of a file that one task reads, and bytes of lines in one batch.
PART, BATCH = 32 << 20, 4 << 20


class Piece(NamedTuple):
    """Lines of a file that begin in [start, stop)."""

    landed: str
    file: str
    start: int
    stop: int


class _Pieces(InputPartition):
    def __init__(self, pieces: list[Piece]):
        self.pieces = pieces


class _Landings:
    """What both readers do."""

    def __init__(self, options: dict):
        self.path = options["path"].rstrip("/")
        self.part = int(options.get("partBytes", PART))
        self.store, self.root = fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)

    def names(self) -> list[str]:
        """Complete landings in their order."""
        found = self.store.get_file_info(fs.FileSelector(self.root, allow_not_found=True))
        names = sorted(f.base_name for f in found if f.type == fs.FileType.Directory)
        marks = self.store.get_file_info([f"{self.root}/{name}/_SUCCESS" for name in names]) if names else []
        return [name for name, mark in zip(names, marks, strict=True) if mark.type == fs.FileType.File]

    def planned(self, names: list[str]) -> list[_Pieces]:
        """Tasks of about ``part`` bytes: large files are cut, small ones go together."""
        pieces = []
        for name in names:
            for f in sorted(self.store.get_file_info(fs.FileSelector(f"{self.root}/{name}")), key=lambda f: f.path):
                if f.type == fs.FileType.File and not f.base_name.startswith(("_", ".")):
                    pieces += [Piece(name, f.path, a, min(a + self.part, f.size)) for a in range(0, f.size, self.part)]
        tasks: list[_Pieces] = []
        held = self.part
        for piece in pieces:
            size = piece.stop - piece.start
            if held + size > self.part:
                tasks.append(_Pieces([]))
                held = 0
            tasks[-1].pieces.append(piece)
            held += size
        return tasks

    def read(self, partition: _Pieces) -> Iterator[pa.RecordBatch]:
        for piece in partition.pieces:
            places, lines, size = [], [], 0
            for at, line in self._lines(piece):
                places.append(at)
                lines.append(line)
                size += len(line)
                if size >= BATCH:
                    yield _batch(piece, places, lines)
                    places, lines, size = [], [], 0
            if lines:
                yield _batch(piece, places, lines)

    def _lines(self, piece: Piece) -> Iterator[tuple[int, bytes]]:
        """(place, line) of the lines that begin in the piece; its last one may end behind it."""
        with self.store.open_input_file(piece.file) as file:
            at = max(0, piece.start - 1)
            file.seek(at)
            rest, skip = b"", piece.start > 0
            while True:
                block = file.read(1 << 20)
                lines = (rest + block).split(b"\n")
                rest = lines.pop() if block else b""
                for line in lines:
                    if skip:
                        skip = False  # what began in the piece before
                    elif at >= piece.stop:
                        return
                    elif line.strip():
                        yield at, line.rstrip(b"\r")
                    at += len(line) + 1
                if not block:
                    return
                if at >= piece.stop and not skip:
                    return


def _batch(piece: Piece, places: list[int], lines: list[bytes]) -> pa.RecordBatch:
    text = [line.decode("utf-8", "replace") for line in lines]
    columns = [pa.array([piece.landed] * len(text)), pa.array([piece.file] * len(text)), pa.array(places, pa.int64()), pa.array(text, pa.string())]
    return pa.RecordBatch.from_arrays(columns, ["landed", "file", "at", "line"])


class _Table(_Landings, DataSourceReader):
    def partitions(self) -> list[_Pieces]:
        return self.planned(self.names()) or [_Pieces([])]


class _Stream(_Landings, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"landed": ""}

    def latestOffset(self) -> dict:
        return {"landed": max(self.names(), default="")}

    def partitions(self, start: dict, end: dict) -> list[_Pieces]:
        return self.planned([name for name in self.names() if start["landed"] < name <= end["landed"]]) or [_Pieces([])]

    def commit(self, end: dict) -> None:
        """Landings stay where they are."""


class LandedLines(DataSource):
    """Format ``landed_lines``; options ``path`` and ``partBytes``."""

    @classmethod
    def name(cls) -> str:
        return "landed_lines"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Table(self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Stream(self.options)


def lines(spark: SparkSession, path: str, stream: bool = True, part_bytes: int = PART) -> DataFrame:
    """Lines of the landings below ``path``: landed, file, at (place of the line in its file), line."""
    spark.dataSource.register(LandedLines)
    return (spark.readStream if stream else spark.read).format("landed_lines").option("path", path).option("partBytes", part_bytes).load()


def records(landed: DataFrame, schema: str) -> DataFrame:
    """Lines as records of ``schema``, with ``corrupt``: the line itself where it is no such record, else NULL."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "corrupt"}
    return landed.select("landed", F.from_json("line", f"{schema}, corrupt string", options).alias("r")).select("landed", "r.*")


def corrupt(found: DataFrame) -> DataFrame:
    """Lines that could not be read, as errors of their landing."""
    return found.where("corrupt IS NOT NULL").select("landed", F.col("corrupt").alias("line"), F.lit("unreadable record").alias("error"))
