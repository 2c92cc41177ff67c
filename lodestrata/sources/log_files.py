"""The ``wal_frames`` data source: append-only log files of checksummed frames, read in batch or as a stream.

A file is frames end to end. Rows are (file, offset, txn_id, type, key, value). A frame cut off at a file's end (a crash, or a
writer at work) ends the file there; a wrong checksum anywhere raises. A stream takes each file up once, when it
is first listed, whatever its name; its offsets name the files of the folder, so old files should be merged or moved away. Files that this
source writes have names that sort in the order of their commits, and end at FILE_BYTES.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from lodestrata.functions.codec import FRAME_HEADER_BYTES, Record, TornTail, read_fixed, read_frame
from lodestrata.sources.shared import filesystem

SUFFIX = ".wal"
#: A task starts another file here: a file is read by one task.
FILE_BYTES = 128 << 20


@dataclass
class LogFile(InputPartition):
    path: str


def _files(uri: str) -> list[str]:
    files, base = filesystem(uri)
    return sorted(i.path for i in files.get_file_info(fs.FileSelector(base, allow_not_found=True)) if i.path.endswith(SUFFIX))


def _rows(uri: str, path: str) -> Iterator[tuple]:
    """A file's records, one frame in memory at a time."""
    files, _ = filesystem(uri)
    name, at = path.rsplit("/", 1)[-1], 0
    with files.open_input_stream(path, compression=None, buffer_size=1 << 20) as f:
        while head := f.read(FRAME_HEADER_BYTES):
            size = read_fixed(head, 0, 4)[0] if len(head) == FRAME_HEADER_BYTES else 0
            try:
                record, length = read_frame(head + f.read(size), 0)
            except TornTail:
                return
            yield name, at, record.txn_id, record.type, record.key, record.value
            at += length


class _Reader(DataSourceReader):
    def __init__(self, uri: str):
        self.uri = uri

    def partitions(self) -> list[InputPartition]:
        return [LogFile(p) for p in _files(self.uri)]

    def read(self, partition: LogFile | None) -> Iterator[tuple]:
        # Spark reads a source without partitions by none.
        return _rows(self.uri, partition.path) if partition is not None else iter(())


class _StreamReader(DataSourceStreamReader):
    """An offset names all files that were listed by then."""

    def __init__(self, uri: str):
        self.uri = uri

    def initialOffset(self) -> dict:
        return {"files": []}

    def latestOffset(self) -> dict:
        return {"files": [p.rsplit("/", 1)[-1] for p in _files(self.uri)]}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        _, base = filesystem(self.uri)
        taken = set(start["files"])
        return [LogFile(f"{base}/{name}") for name in end["files"] if name not in taken]

    def read(self, partition: LogFile) -> Iterator[tuple]:
        return _rows(self.uri, partition.path)


@dataclass
class Written(WriterCommitMessage):
    paths: list[str]


class _Writer(DataSourceWriter):
    def __init__(self, uri: str, prefix: str, file_bytes: int):
        self.uri, self.prefix, self.file_bytes = uri, prefix, file_bytes

    def write(self, rows: Iterator) -> Written:
        files, base = filesystem(self.uri)
        files.create_dir(base, recursive=True)
        paths: list[str] = []
        out, size = None, 0
        for r in rows:
            if out is None:
                paths.append(f"{base}/_{uuid.uuid4().hex}.pending")
                out, size = files.open_output_stream(paths[-1], compression=None), 0
            frame = Record(r["txn_id"], r["type"], bytes(r["key"] or b""), bytes(r["value"] or b"")).frame()
            out.write(frame)
            size += len(frame)
            if size >= self.file_bytes:
                out.close()
                out = None
        if out is not None:
            out.close()
        return Written(paths)

    def _each(self, messages: list[Written | None]) -> list[str]:
        return [p for m in messages if m is not None for p in m.paths]

    def commit(self, messages: list[Written | None]) -> None:
        files, base = filesystem(self.uri)
        now = time.time_ns() // 1000
        for i, path in enumerate(self._each(messages)):
            files.move(path, f"{base}/{self.prefix}-{now:020d}-{i:06d}-{uuid.uuid4().hex[:8]}{SUFFIX}")

    def abort(self, messages: list[Written | None]) -> None:
        files, _ = filesystem(self.uri)
        for path in self._each(messages):
            files.delete_file(path)


class LogSource(DataSource):
    """Options: path; for writing, prefix (default ``log``) begins the file names, file_bytes ends a file. Rows to write: txn_id, type, key, value."""

    @classmethod
    def name(cls) -> str:
        return "wal_frames"

    def schema(self) -> str:
        return "file string, offset long, txn_id long, type int, key binary, value binary"

    def _uri(self) -> str:
        path = self.options["path"]
        return path if "://" in path else f"file://{path}"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self._uri())

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _StreamReader(self._uri())

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("a log is only appended to")
        return _Writer(self._uri(), self.options.get("prefix", "log"), int(self.options.get("file_bytes", FILE_BYTES)))
