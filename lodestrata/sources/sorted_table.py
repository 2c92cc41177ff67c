"""The ``sorted_table`` data source: files of prefix-compressed blocks, an index, and a footer.

    spark.dataSource.register(SortedTableSource)
    df.repartitionByRange("key").sortWithinPartitions("key").write.format("sorted_table").mode("append").save(path)
    load(spark, path).filter("key = X'...'")

A file is [data blocks][membership filter][index][footer]. Planning reads each file's tail by range
reads; equality and bounds on the key prune files by
their filters and blocks by their dividers. One partition is a run of neighbouring blocks of one file.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

from lodestrata.functions.codec import FOOTER_BYTES, CorruptData, Footer, Handle, read_footer
from lodestrata.operators.blocks import RESTART_INTERVAL, DataBlockBuilder, DataBlockReader, IndexBlockBuilder, IndexBlockReader
from lodestrata.operators.bloom import BloomFilter
from lodestrata.sources.shared import filesystem

SUFFIX = ".sst"
BLOCK_BYTES = 64 << 10
#: Bytes of blocks that one partition reads.
SPLIT_BYTES = 32 << 20
#: A task starts another file here, which bounds the keys that it holds for the file's filter.
FILE_BYTES = 256 << 20


class TableBuilder:
    """One file's bytes, handed to ``write`` as they are ready; keys must strictly increase."""

    def __init__(self, write, block_bytes: int = BLOCK_BYTES, restart_interval: int = RESTART_INTERVAL, filter_rate: float | None = 0.01):
        self._write, self._block_bytes, self._interval, self._rate = write, block_bytes, restart_interval, filter_rate
        self._block = DataBlockBuilder(restart_interval)
        self._first: bytes | None = None
        self._last: bytes | None = None
        self._index = IndexBlockBuilder()
        self._keys: list[bytes] = []
        self._at = 0
        self.n = 0

    @property
    def size(self) -> int:
        return self._at

    def _put(self, data: bytes) -> Handle:
        self._write(data)
        handle = Handle(self._at, len(data))
        self._at += len(data)
        return handle

    def add(self, key: bytes, value: bytes) -> None:
        if self._last is not None and key <= self._last:
            raise ValueError("keys must strictly increase")
        if self._first is None:
            self._first = key
        self._block.add(key, value)
        self._last = key
        self.n += 1
        if self._rate is not None:
            self._keys.append(key)
        if self._block.current_size() >= self._block_bytes:
            self._end_block()

    def _end_block(self) -> None:
        if self._first is not None:
            self._index.add(self._first, self._put(self._block.finish()))
            self._block, self._first = DataBlockBuilder(self._interval), None

    def finish(self) -> None:
        self._end_block()
        place = Handle(0, 0)
        if self._rate is not None and self._keys:
            bloom = BloomFilter(len(self._keys), self._rate)
            bloom.add_all(self._keys)
            place = self._put(bloom.serialize())
        index = self._put(self._index.finish())
        self._put(Footer(place, index).encode())


class TableFile:
    """An open file's filter and index; blocks are read by place."""

    def __init__(self, read_at, size: int):
        self._read_at = read_at
        if size < FOOTER_BYTES:
            raise CorruptData("a sorted table is too small")
        self.footer = read_footer(self._take(Handle(size - FOOTER_BYTES, FOOTER_BYTES)))
        self.index = IndexBlockReader(self._take(self.footer.index))
        self.bloom = BloomFilter.deserialize(self._take(self.footer.filter)) if self.footer.filter.size else None

    def _take(self, handle: Handle) -> bytes:
        data = self._read_at(handle.offset, handle.size)
        if len(data) != handle.size:
            raise CorruptData("a sorted table is cut off")
        return data

    def block(self, handle: Handle) -> DataBlockReader:
        return DataBlockReader(self._take(handle))

    def get(self, key: bytes) -> bytes | None:
        if self.bloom is not None and not self.bloom.may_contain(key):
            return None
        handle = self.index.find(key)
        return None if handle is None else self.block(handle).get(key)


@dataclass
class Bounds:
    """What pushed filters demand of the key."""

    low: bytes | None = None
    low_open: bool = False
    high: bytes | None = None
    high_open: bool = False
    equal: bytes | None = None
    never: bool = False

    def add(self, f: Filter) -> bool:
        """Takes the filter over if it is a bound of the key."""
        if getattr(f, "attribute", None) != ("key",) or not isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual):
            return False
        value = bytes(f.value)
        if isinstance(f, EqualTo):
            self.never |= self.equal is not None and self.equal != value
            self.equal = value
        elif isinstance(f, GreaterThan | GreaterThanOrEqual):
            is_open = isinstance(f, GreaterThan)
            if self.low is None or value > self.low or value == self.low and is_open:
                self.low, self.low_open = value, is_open
        else:
            is_open = isinstance(f, LessThan)
            if self.high is None or value < self.high or value == self.high and is_open:
                self.high, self.high_open = value, is_open
        return True

    def admits(self, key: bytes) -> bool:
        if self.never or self.equal is not None and key != self.equal:
            return False
        if self.low is not None and (key < self.low or key == self.low and self.low_open):
            return False
        return self.high is None or key < self.high or key == self.high and not self.high_open

    def blocks(self, table: TableFile) -> list[Handle]:
        """Handles of the blocks that may hold an admitted key."""
        if self.never:
            return []
        if self.equal is not None and table.bloom is not None and not table.bloom.may_contain(self.equal):
            return []
        starts = table.index.dividers
        low = max((x for x in (self.low, self.equal) if x is not None), default=None)
        high = min((x for x in (self.high, self.equal) if x is not None), default=None)
        kept = []
        for i, handle in enumerate(table.index.handles):
            after = starts[i + 1] if i + 1 < len(starts) else None
            if (low is None or after is None or low < after) and (high is None or starts[i] <= high):
                kept.append(handle)
        return kept


@dataclass
class Run(InputPartition):
    path: str
    handles: list[tuple[int, int]]


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path, self.bounds = path, Bounds()

    def partitions(self) -> list[InputPartition]:
        files, base = filesystem(self.path)
        out: list[InputPartition] = []
        for info in sorted(files.get_file_info(fs.FileSelector(base, recursive=False)), key=lambda x: x.path):
            if not info.path.endswith(SUFFIX):
                continue
            with files.open_input_file(info.path) as f:
                handles = self.bounds.blocks(TableFile(lambda at, n, f=f: f.read_at(n, at), info.size))
            part, size = [], 0
            for h in handles:
                part.append(tuple(h))
                size += h.size
                if size >= SPLIT_BYTES:
                    out.append(Run(info.path, part))
                    part, size = [], 0
            if part:
                out.append(Run(info.path, part))
        return out

    def read(self, partition: Run | None) -> Iterator[tuple[bytes, bytes]]:
        if partition is None:  # how Spark reads a source without partitions
            return
        files, _ = filesystem(self.path)
        with files.open_input_file(partition.path) as f:
            for at, n in partition.handles:
                data = f.read_at(n, at)
                if len(data) != n:
                    raise CorruptData("a sorted table is cut off")
                for key, value in DataBlockReader(data):
                    if self.bounds.admits(key):
                        yield key, value


class _PruningReader(_Reader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if not self.bounds.add(f):
                yield f


def _shown(pending: str) -> str:
    """The name under which a pending file is committed."""
    folder, name = pending.rsplit("/", 1)
    return f"{folder}/part-{name[1:].removesuffix('.pending')}{SUFFIX}"


@dataclass
class Written(WriterCommitMessage):
    paths: list[str]


class _Writer(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool, block_bytes: int, interval: int, rate: float | None, file_bytes: int):
        self.path, self.overwrite, self.block_bytes, self.interval, self.rate, self.file_bytes = path, overwrite, block_bytes, interval, rate, file_bytes

    def write(self, rows: Iterator) -> Written:
        files, base = filesystem(self.path)
        files.create_dir(base, recursive=True)
        written: list[str] = []
        builder = out = last = None
        for row in rows:
            key = bytes(row["key"])
            if last is not None and key <= last:
                raise ValueError("keys must strictly increase")
            if builder is None:
                # Invisible to readers until the job commits.
                written.append(f"{base}/_{uuid.uuid4().hex}.pending")
                out = files.open_output_stream(written[-1], compression=None)
                builder = TableBuilder(out.write, self.block_bytes, self.interval, self.rate)
            builder.add(key, bytes(row["value"]))
            last = key
            if builder.size >= self.file_bytes:
                builder.finish()
                out.close()
                builder = None
        if builder is not None:
            builder.finish()
            out.close()
        return Written(written)

    def _each(self, messages: list[Written | None]) -> list[str]:
        return [p for m in messages if m is not None for p in m.paths]

    def commit(self, messages: list[Written | None]) -> None:
        files, base = filesystem(self.path)
        old = [i.path for i in files.get_file_info(fs.FileSelector(base, allow_not_found=True)) if i.path.endswith(SUFFIX)] if self.overwrite else []
        for p in self._each(messages):
            files.move(p, _shown(p))
        for p in old:
            files.delete_file(p)

    def abort(self, messages: list[Written | None]) -> None:
        files, _ = filesystem(self.path)
        for p in self._each(messages):
            files.delete_file(p)


class SortedTableSource(DataSource):
    """Options: path (a URI that pyarrow's file systems know), block_bytes, restart_interval, file_bytes, filter_rate (0: no filter).

    Spark refuses a reader that takes filters while its pushdown is off, so pruning is an option too: see load().
    """

    @classmethod
    def name(cls) -> str:
        return "sorted_table"

    def schema(self) -> str:
        return "key binary, value binary"

    def _path(self) -> str:
        path = self.options["path"]
        return path if "://" in path else f"file://{path}"

    def reader(self, schema: StructType) -> DataSourceReader:
        pruning = self.options.get("pushdown", "false") == "true"
        return (_PruningReader if pruning else _Reader)(self._path())

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        rate = float(self.options.get("filter_rate", 0.01))
        return _Writer(self._path(), overwrite, int(self.options.get("block_bytes", BLOCK_BYTES)), int(self.options.get("restart_interval", RESTART_INTERVAL)), rate or None, int(self.options.get("file_bytes", FILE_BYTES)))


def load(spark: SparkSession, path: str) -> DataFrame:
    """The files of a folder with filter pushdown, which is switched on for the session."""
    spark.dataSource.register(SortedTableSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("sorted_table").option("pushdown", "true").load(path)


#: Open files whose filters and indexes a task keeps.
OPEN_FILES = 64


def lookup(probes: DataFrame, path: str, key: str = "key") -> DataFrame:
    """(key, value) of the probes that a folder's files hold: through a file's filter, its index and the restart points of one block.

    A task opens the files one after another and asks each for all keys of a batch; a key is in one file at most. Null keys are in none.
    """
    uri = path if "://" in path else f"file://{path}"
    names = [(i.path, i.size) for i in sorted(filesystem(uri)[0].get_file_info(fs.FileSelector(filesystem(uri)[1], recursive=False)), key=lambda x: x.path) if i.path.endswith(SUFFIX)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = filesystem(uri)
        tables: dict[str, TableFile] = {}
        for b in batches:
            wanted, found = {k for k in b.column(0).to_pylist() if k is not None}, {}
            for name, size in names if wanted else []:
                if name not in tables:
                    if len(tables) >= OPEN_FILES:
                        tables.pop(next(iter(tables)))
                    tables[name] = TableFile(lambda at, n, f=files.open_input_file(name): f.read_at(n, at), size)
                for k in wanted:
                    if (value := tables[name].get(k)) is not None:
                        found[k] = value
                wanted -= found.keys()
            hits = [(k, found[k]) for k in b.column(0).to_pylist() if k in found]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in hits], pa.binary()), pa.array([v for _, v in hits], pa.binary())], ["key", "value"])

    return probes.select(F.col(key).cast("binary").alias("key")).mapInArrow(run, "key binary, value binary")
