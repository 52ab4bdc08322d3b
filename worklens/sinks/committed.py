"""A sink whose batches appear whole or not at all: tasks write files that nobody reads, one manifest publishes them.

A task gives the names of its files to the driver. The commit writes them into a manifest beside
its place and moves it there; an abort deletes them. A batch that comes again after its commit deletes its own files, so
it leaves nothing behind. Readers go by the manifests alone.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceStreamArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

#: Rows of a file.
ROWS = 1_000_000


@dataclass
class Written(WriterCommitMessage):
    """Files of one task, below the folder."""

    names: list[str] = field(default_factory=list)


class _Sink:
    def __init__(self, options: dict):
        path = options["path"].rstrip("/")
        self.store, self.root = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
        self.batch = options.get("batch")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        done = Written()
        writer = out = None
        rows = 0
        self.store.create_dir(f"{self.root}/data", recursive=True)
        for batch in iterator:
            if batch.num_rows == 0:
                continue
            if writer is None:
                done.names.append(f"{uuid.uuid4().hex}.parquet")
                out = self.store.open_output_stream(f"{self.root}/data/{done.names[-1]}")
                writer, rows = pq.ParquetWriter(out, batch.schema), 0
            writer.write_batch(batch)
            rows += batch.num_rows
            if rows >= ROWS:
                writer.close()
                out.close()
                writer = None
        if writer is not None:
            writer.close()
            out.close()
        return done

    def publish(self, messages: list[Written | None], number: str) -> None:
        names = sorted(name for m in messages if m is not None for name in m.names)
        self.store.create_dir(f"{self.root}/commits", recursive=True)
        there = f"{self.root}/commits/{number}"
        if self.store.get_file_info(there).type != fs.FileType.NotFound:
            self.discard(messages)  # this batch was published before
            return
        with self.store.open_output_stream(f"{self.root}/commits/_{number}.new") as out:
            out.write("".join(f"{name}\n" for name in names).encode())
        self.store.move(f"{self.root}/commits/_{number}.new", there)

    def discard(self, messages: list[Written | None]) -> None:
        for m in messages:
            for name in m.names if m is not None else ():
                self.store.delete_file(f"{self.root}/data/{name}")


class _Batch(_Sink, DataSourceArrowWriter):
    def commit(self, messages: list[Written | None]) -> None:
        self.publish(messages, self.batch or uuid.uuid4().hex)

    def abort(self, messages: list[Written | None]) -> None:
        self.discard(messages)


class _Stream(_Sink, DataSourceStreamArrowWriter):
    def commit(self, messages: list[Written | None], batchId: int) -> None:
        self.publish(messages, f"{batchId:020d}")

    def abort(self, messages: list[Written | None], batchId: int) -> None:
        self.discard(messages)


class Committed(DataSource):
    """Format ``committed_rows``; options ``path`` and, for a batch write that may be repeated, its name ``batch``."""

    @classmethod
    def name(cls) -> str:
        return "committed_rows"

    def schema(self) -> str:
        return "value string"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Batch(self.options)

    def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamArrowWriter:
        return _Stream(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Committed)


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of all published batches."""
    commits = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/commits")
    files = commits.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [r.value for r in spark.read.text(f"{path}/commits").collect()] if files.exists(commits) else []  # one short line per file
    return spark.read.schema(schema).parquet(*[f"{path}/data/{n}" for n in names]) if names else spark.createDataFrame([], schema)
