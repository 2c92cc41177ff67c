"""Sorted, prefix-compressed blocks and the sparse index that routes keys to them.

The codecs below write and read the bytes of one block; the DataFrame operators plan them for a whole
table: encoding by block, floor routing, routed lookups.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions.codec import HANDLE_BYTES, MAX_U32, CorruptData, Handle, fixed32, read_fixed, read_handle, read_varint32, varint32
from lodestrata.functions.keys import shared_prefix_bytes
from lodestrata.operators.ranks import in_ranges, with_rank

RESTART_INTERVAL = 16
ENTRY_BYTES = 12
#: Dividers are broadcast up to this many; a longer index is merged with the probes by range instead.
BROADCAST_DIVIDERS = 1_000_000


def _common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return next(i for i in range(n) if a[i] != b[i])


class DataBlockBuilder:
    """Entries in strictly increasing key order; every restart_interval-th key is stored whole."""

    def __init__(self, restart_interval: int = RESTART_INTERVAL):
        if restart_interval < 1:
            raise ValueError("the restart interval must be 1 at least")
        self.interval = restart_interval
        self._body = bytearray()
        self._restarts = [0]
        self._last: bytes | None = None
        self._n = 0
        self._done: bytes | None = None

    def add(self, key: bytes, value: bytes) -> None:
        if self._done is not None:
            raise ValueError("the block is finished")
        if self._last is not None and key <= self._last:
            raise ValueError("keys must strictly increase")
        if max(len(key), len(value)) > MAX_U32:
            raise ValueError("an entry is too long")
        shared = 0
        if self._n % self.interval:
            shared = _common(self._last or b"", key)
        elif self._n:
            self._restarts.append(len(self._body))
        self._body += fixed32(shared) + fixed32(len(key) - shared) + fixed32(len(value)) + key[shared:] + value
        self._last = key
        self._n += 1

    def current_size(self) -> int:
        """The block's bytes if it ended here; once finished, its bytes."""
        return len(self._done) if self._done is not None else len(self._body) + 4 * (len(self._restarts) + 1)

    def finish(self) -> bytes:
        if self._done is None:
            self._done = bytes(self._body) + b"".join(map(fixed32, self._restarts)) + fixed32(len(self._restarts))
        return self._done


def _trailer(block: bytes) -> tuple[list[int], int]:
    """The offsets at a block's end, ascending and within it, and where they start."""
    if len(block) < 4:
        raise CorruptData("a block is too small")
    n, _ = read_fixed(block, len(block) - 4, 4)
    start = len(block) - 4 - 4 * n
    if start < 0:
        raise CorruptData("a block's offset table exceeds it")
    offsets = [read_fixed(block, start + 4 * i, 4)[0] for i in range(n)]
    if any(b <= a for a, b in zip(offsets, offsets[1:], strict=False)) or offsets and (offsets[0] != 0 or offsets[-1] > start):
        raise CorruptData("a block's offsets are out of order")
    return offsets, start


class DataBlockReader:
    """Entries of an encoded block: in order, or one by key through the restart points."""

    def __init__(self, block: bytes):
        self._block = block
        self._restarts, self._end = _trailer(block)
        if not self._restarts:
            raise CorruptData("a data block has no restart point")

    def _entry(self, at: int, before: bytes) -> tuple[bytes, bytes, int]:
        if at + ENTRY_BYTES > self._end:
            raise CorruptData("an entry's header is cut off")
        shared, at = read_fixed(self._block, at, 4)
        n_key, at = read_fixed(self._block, at, 4)
        n_value, at = read_fixed(self._block, at, 4)
        if shared > len(before) or at + n_key + n_value > self._end:
            raise CorruptData("an entry's lengths exceed its block")
        return before[:shared] + self._block[at : at + n_key], self._block[at + n_key : at + n_key + n_value], at + n_key + n_value

    def _from(self, at: int) -> Iterator[tuple[bytes, bytes]]:
        key: bytes | None = None
        while at < self._end:
            found, value, at = self._entry(at, key or b"")
            if key is not None and found <= key:
                raise CorruptData("keys are out of order")
            key = found
            yield key, value

    def __iter__(self) -> Iterator[tuple[bytes, bytes]]:
        return self._from(0)

    def _restart_key(self, i: int) -> bytes:
        if self._restarts[i] < self._end and read_fixed(self._block, self._restarts[i], 4)[0]:
            raise CorruptData("a restart point shares a prefix")
        return self._entry(self._restarts[i], b"")[0]

    def get(self, key: bytes) -> bytes | None:
        if not self._end:
            return None
        run = bisect_right(range(len(self._restarts)), key, key=self._restart_key) - 1
        if run < 0:
            return None
        for found, value in self._from(self._restarts[run]):
            if found >= key:
                return value if found == key else None
        return None


class IndexBlockBuilder:
    """Divider keys in strictly increasing order, each with the handle of its block."""

    def __init__(self) -> None:
        self._entries: list[bytes] = []
        self._last: bytes | None = None
        self._done: bytes | None = None

    def add(self, divider: bytes, handle: Handle) -> None:
        if self._done is not None:
            raise ValueError("the index is finished")
        if self._last is not None and divider <= self._last:
            raise ValueError("dividers must strictly increase")
        self._entries.append(varint32(len(divider)) + divider + handle.encode())
        self._last = divider

    def finish(self) -> bytes:
        if self._done is None:
            offsets, at = [], 0
            for e in self._entries:
                offsets.append(fixed32(at))
                at += len(e)
            self._done = b"".join(self._entries) + b"".join(offsets) + fixed32(len(offsets))
        return self._done


class IndexBlockReader:
    """Floor lookups in an encoded index; everything is checked on opening."""

    def __init__(self, block: bytes):
        offsets, end = _trailer(block)
        self.dividers: list[bytes] = []
        self.handles: list[Handle] = []
        for i, at in enumerate(offsets):
            stop = offsets[i + 1] if i + 1 < len(offsets) else end
            n, at = read_varint32(block[:stop], at)
            if at + n + HANDLE_BYTES != stop:
                raise CorruptData("an index entry's lengths don't match")
            divider = block[at : at + n]
            if self.dividers and divider <= self.dividers[-1]:
                raise CorruptData("dividers are out of order")
            self.dividers.append(divider)
            self.handles.append(read_handle(block, at + n)[0])

    def find(self, key: bytes) -> Handle | None:
        """The handle of the last divider at or before the key; None before the first."""
        i = bisect_right(self.dividers, key) - 1
        return self.handles[i] if i >= 0 else None


# Whole tables


def number_blocks(rows: DataFrame, entries_per_block: int, key: str = "key") -> DataFrame:
    """rows with block_no and entry_no (both from 0) in key order; keys must be unique."""
    ranked = with_rank(rows, key, "__rn")
    place = F.col("__rn") - 1
    return ranked.withColumns({"block_no": F.floor(place / entries_per_block).cast("long"), "entry_no": (place % entries_per_block).cast("long")}).drop("__rn")


def prefix_layout(numbered: DataFrame, restart_interval: int = RESTART_INTERVAL) -> DataFrame:
    """What the encoder would write for each entry: shared, non_shared, value_len and its offset in the block.

    numbered has block_no, entry_no, key and value. Blocks are independent, so both windows stay within one.
    """
    order = Window.partitionBy("block_no").orderBy("entry_no")
    n_key, n_value = F.octet_length("key"), F.octet_length("value")
    before = F.lag("key").over(order)
    shared = F.when(F.col("entry_no") % restart_interval == 0, F.lit(0)).otherwise(shared_prefix_bytes(before, F.col("key"))).cast("long")
    laid = numbered.withColumn("shared", shared).withColumn("non_shared", n_key.cast("long") - F.col("shared")).withColumn("value_len", n_value.cast("long"))
    size = F.lit(ENTRY_BYTES) + F.col("non_shared") + F.col("value_len")
    return laid.withColumn("offset", (F.sum(size).over(order) - size).cast("long"))


def size_estimates(layout: DataFrame, restart_interval: int = RESTART_INTERVAL) -> DataFrame:
    """(block_no, n_entries, size): each block's encoded bytes, from the layout alone."""
    n = F.count("*")
    body = F.sum(F.lit(ENTRY_BYTES) + F.col("non_shared") + F.col("value_len"))
    restarts = F.floor((n + restart_interval - 1) / restart_interval).cast("long")
    return layout.groupBy("block_no").agg(n.alias("n_entries"), (body + 4 * (restarts + 1)).alias("size"))


def order_violations(rows: DataFrame, seq: str = "seq", key: str = "key", group: str | None = None) -> DataFrame:
    """Rows whose key does not exceed the one before them, in the order of a unique seq (within a group, if one is named).

    Rows are dealt by ranges of group and seq; the first of a range is held against the last of
    the range before, so that no task sees all rows, nor all of a group.
    """
    placed = in_ranges(rows, *([group] if group else []), seq)
    own = F.struct(F.col(key).alias("key"), (F.col(group) if group else F.lit(0)).alias("group"))
    before = F.lag(own).over(Window.partitionBy("__range").orderBy("__place"))
    # One row a range.
    lasts = placed.groupBy("__range").agg(F.max_by(own, "__place").alias("__last"))
    carried = lasts.select("__range", F.lag("__last").over(Window.orderBy("__range")).alias("__carried"))
    held = placed.withColumn("__before", before).join(carried, "__range").withColumn("__before", F.coalesce("__before", "__carried"))
    same = F.col("__before.group").eqNullSafe(F.col(group)) if group else F.lit(True)
    held = held.withColumn("previous", F.when(same, F.col("__before.key")))
    return held.filter(F.col(key) <= F.col("previous")).select(*rows.columns, "previous")


def encode_blocks(numbered: DataFrame, restart_interval: int = RESTART_INTERVAL) -> DataFrame:
    """(block_no, first_key, block): the bytes of each block of number_blocks()."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, first, builder = None, None, None
        done: list[tuple] = []
        for b in batches:
            for no, key, value in zip(*[b.column(c).to_pylist() for c in ("block_no", "key", "value")], strict=True):
                if no != number:
                    if builder is not None:
                        done.append((number, first, builder.finish()))
                    number, first, builder = no, key, DataBlockBuilder(restart_interval)
                builder.add(key, value)
            if done:
                yield _rows(done)
                done = []
        if builder is not None:
            yield _rows([(number, first, builder.finish())])

    rows = numbered.select("block_no", "key", "value").repartition("block_no").sortWithinPartitions("block_no", "key")
    return rows.mapInArrow(encode, "block_no long, first_key binary, block binary")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.binary()), pa.array(columns[2], pa.binary())], ["block_no", "first_key", "block"])


def decode_blocks(blocks: DataFrame) -> DataFrame:
    """(block_no, key, value) of every entry of encoded blocks."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for no, block in zip(b.column("block_no").to_pylist(), b.column("block").to_pylist(), strict=True):
                entries = list(DataBlockReader(block))
                keys, values = [k for k, _ in entries], [v for _, v in entries]
                yield pa.RecordBatch.from_arrays([pa.array([no] * len(entries), pa.int64()), pa.array(keys, pa.binary()), pa.array(values, pa.binary())], ["block_no", "key", "value"])

    return blocks.select("block_no", "block").mapInArrow(decode, "block_no long, key binary, value binary")


def build_index(sizes: DataFrame, firsts: DataFrame) -> DataFrame:
    """(block_no, divider, offset, size): handles of blocks laid end to end in the order of block_no.

    sizes: (block_no, size); firsts: (block_no, divider). Offsets are sums over ranges of blocks, then within
    one, so that no task sees the whole index.
    """
    group = F.floor(F.col("block_no") / 10_000)
    grouped = sizes.select("block_no", "size").withColumn("__g", group)
    totals = grouped.groupBy("__g").agg(F.sum("size").alias("__t"))
    # One row for each ten thousand blocks.
    starts = totals.withColumn("__s", F.sum("__t").over(Window.orderBy("__g")) - F.col("__t")).drop("__t")
    within = F.sum("size").over(Window.partitionBy("__g").orderBy("block_no")) - F.col("size")
    placed = grouped.withColumn("__w", within).join(starts, "__g").withColumn("offset", (F.col("__w") + F.col("__s")).cast("long"))
    return placed.join(firsts, "block_no").select("block_no", "divider", "offset", "size")


def route(probes: DataFrame, index: DataFrame, key: str = "key", divider: str = "divider", target: str = "block_no") -> DataFrame:
    """probes with the target of the last divider at or before the key; null before the first one.

    A sparse index is small: its sorted dividers are broadcast and bisected, after their number is checked. A longer
    one is routed by ranges (see route_by_range).
    """
    if index.limit(BROADCAST_DIVIDERS + 1).count() > BROADCAST_DIVIDERS:
        return route_by_range(probes, index, key, divider, target)
    entries = sorted((bytes(r[0]), r[1]) for r in index.select(F.col(divider).cast("binary"), F.col(target).cast("long")).collect())
    shared = probes.sparkSession.sparkContext.broadcast(([d for d, _ in entries], [t for _, t in entries]))

    @F.pandas_udf("long")
    def floor(keys):  # noqa: ANN001, ANN202
        import pandas as pd

        dividers, targets = shared.value
        found = [bisect_right(dividers, bytes(k)) - 1 if k is not None else -1 for k in keys]
        return pd.Series([targets[i] if i >= 0 else None for i in found], dtype="Int64")

    return probes.withColumn(target, floor(F.col(key).cast("binary")))


def route_by_range(probes: DataFrame, index: DataFrame, key: str = "key", divider: str = "divider", target: str = "block_no", bins: int | None = None) -> DataFrame:
    """As route(), for an index of any size: dividers and probes meet in ranges of the key, as many as their number asks for, or ``bins``.

    A range takes the last divider before it along, so that its rows need no other range. Equal probes are in no
    order, so that ranges also split them.
    """
    marks = index.select(F.col(divider).cast("binary").alias("__k"), F.col(target).cast("long").alias("__t")).filter("__k is not null")
    asked = probes.select(F.struct(*probes.columns).alias("__row"), F.col(key).cast("binary").alias("__k"), F.lit(None).cast("long").alias("__t"), F.lit(1).alias("__tag"))
    # The rows of one key: dividers by their targets, then probes by chance.
    asked = asked.withColumn("__tie", (F.rand(17) * (1 << 62)).cast("long"))
    marks = marks.select(F.lit(None).cast(asked.schema["__row"].dataType).alias("__row"), "__k", "__t", F.lit(0).alias("__tag"), F.col("__t").alias("__tie"))
    placed = in_ranges(marks.unionByName(asked), "__k", "__tag", "__tie", parts=bins)
    # One row a range.
    lasts = placed.groupBy("__range").agg(F.max(F.when(F.col("__tag") == 0, F.struct("__place", "__t"))).alias("__last"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    carried = lasts.select("__range", F.last("__last.__t", ignorenulls=True).over(before).alias("__before"))
    upto = Window.partitionBy("__range").orderBy("__place").rowsBetween(Window.unboundedPreceding, 0)
    found = placed.withColumn("__f", F.last("__t", ignorenulls=True).over(upto)).filter("__tag = 1").join(carried, "__range")
    return found.select("__row.*", F.when(F.col("__k").isNotNull(), F.coalesce("__f", "__before")).alias(target))


def point_lookup(probes: DataFrame, entries: DataFrame, index: DataFrame, key: str = "key") -> DataFrame:
    """probes with block_no and value: routed to one block each, then joined on block and key; null where missing."""
    routed = route(probes, index, key)
    return routed.join(entries.select("block_no", F.col("key").alias(key), "value"), ["block_no", key], "left")
