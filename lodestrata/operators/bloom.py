"""A serialisable Bloom filter over byte keys, built and probed in batches.

Positions follow published double hashing with an odd step, in 64-bit words that wrap. All keys of one
length are hashed together as columns of little-endian words.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.codec import CorruptData, fixed32, fixed64, read_fixed

#: Fixed values of the format and of its hash: header words, seeds, SplitMix64's constants.
HEADER_MAGIC = 0x46424B56
HEADER_VERSION = 1
HEADER_BYTES = 24
SEED_START = 0x243F6A8885A308D3
SEED_STEP = 0x13198A2E03707344
GOLDEN = 0x9E3779B97F4A7C15
MIX_A = 0xBF58476D1CE4E5B9
MIX_B = 0x94D049BB133111EB
LEAST_RATE, MOST_RATE = 1e-9, 0.999999

#: A filter is broadcast to its probes up to this size; beyond it probes go straight to an exact join.
BROADCAST_BYTES = 64 << 20


def size_bits(n: int, rate: float) -> int:
    """Bits for n keys at a false-positive rate; the rate is clamped to what can be had, NaN is refused."""
    if math.isnan(rate):
        raise ValueError("the rate must be a number")
    if n == 0:
        return 1
    if rate <= 0:
        rate = LEAST_RATE
    elif rate >= 1:
        rate = MOST_RATE
    return max(1, math.ceil(-float(n) * math.log(rate) / (math.log(2) * math.log(2))))


def hash_count(n: int, bits: int) -> int:
    """Hashes a key: bits / n * ln 2, half rounded up, one at least."""
    if n == 0 or bits == 0:
        return 1
    return max(1, math.floor(bits / n * math.log(2) + 0.5))


def size_bits_column(n: Column, rate: Column) -> Column:
    clamped = F.when(rate <= 0, F.lit(LEAST_RATE)).when(rate >= 1, F.lit(MOST_RATE)).otherwise(rate)
    bits = F.ceil(-n.cast("double") * F.log(clamped) / (F.log(F.lit(2.0)) * F.log(F.lit(2.0)))).cast("long")
    return F.when(n == 0, F.lit(1).cast("long")).otherwise(F.greatest(bits, F.lit(1).cast("long")))


def hash_count_column(n: Column, bits: Column) -> Column:
    k = F.floor(bits.cast("double") / n.cast("double") * F.log(F.lit(2.0)) + 0.5).cast("long")
    return F.when((n == 0) | (bits == 0), F.lit(1).cast("long")).otherwise(F.greatest(k, F.lit(1).cast("long")))


def _word(n: int) -> np.uint64:
    return np.uint64(n & (2**64 - 1))


def hash64(keys: Iterable[bytes], seed: int) -> np.ndarray:
    """64-bit hashes of the keys."""
    keys = list(keys)
    out = np.empty(len(keys), np.uint64)
    lengths = np.fromiter(map(len, keys), np.int64, len(keys))
    for size in np.unique(lengths).tolist():
        which = np.flatnonzero(lengths == size)
        width = -(-size // 8) * 8
        padded = np.zeros((len(which), width), np.uint8)
        if size:
            padded[:, :size] = np.frombuffer(b"".join(keys[i] for i in which), np.uint8).reshape(-1, size)
        columns = np.ascontiguousarray(padded).view("<u8").astype(np.uint64) if width else np.empty((len(which), 0), np.uint64)
        x = np.full(len(which), _word(seed ^ (GOLDEN + size)), np.uint64)
        whole = size // 8
        for j in range(whole):
            x += columns[:, j] + _word(GOLDEN)
            x ^= x >> np.uint64(30)
            x *= _word(MIX_A)
            x ^= x >> np.uint64(27)
            x *= _word(MIX_B)
        if whole < columns.shape[1]:
            x += columns[:, whole]
        x ^= x >> np.uint64(30)
        x *= _word(MIX_A)
        x ^= x >> np.uint64(27)
        x *= _word(MIX_B)
        x ^= x >> np.uint64(31)
        out[which] = x
    return out


def positions(keys: Iterable[bytes], bits: int, k: int) -> np.ndarray:
    """(keys, k) bit places. The running sum wraps at 2^64 before it is reduced."""
    keys = list(keys)
    m = _word(bits)
    at = hash64(keys, SEED_START) % m
    step = (hash64(keys, SEED_STEP) << np.uint64(1)) | np.uint64(1)
    out = np.empty((len(keys), k), np.int64)
    for i in range(k):
        out[:, i] = at
        at = (at + step) % m
    return out


class BloomFilter:
    """m bits, least significant first in each byte, and k hashes."""

    def __init__(self, expected: int, rate: float = 0.01):
        self.bits = size_bits(expected, rate)
        self.k = hash_count(expected, self.bits)
        self.data = np.zeros((self.bits + 7) // 8, np.uint8)

    @property
    def byte_size(self) -> int:
        return len(self.data)

    def add_all(self, keys: Iterable[bytes]) -> None:
        at = positions(keys, self.bits, self.k).ravel()
        np.bitwise_or.at(self.data, at >> 3, (1 << (at & 7)).astype(np.uint8))

    def add(self, key: bytes) -> None:
        self.add_all([key])

    def may_contain_all(self, keys: Iterable[bytes]) -> np.ndarray:
        at = positions(keys, self.bits, self.k)
        return ((self.data[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool).all(axis=1)

    def may_contain(self, key: bytes) -> bool:
        return bool(self.may_contain_all([key])[0])

    def merge(self, data: bytes) -> None:
        self.data |= np.frombuffer(data, np.uint8)

    def serialize(self) -> bytes:
        return fixed32(HEADER_MAGIC) + fixed32(HEADER_VERSION) + fixed64(self.bits) + fixed32(self.k) + fixed32(0) + self.data.tobytes()

    @classmethod
    def deserialize(cls, data: bytes) -> BloomFilter:
        """The filter of serialize()'s bytes; CorruptData for anything else."""
        if len(data) < HEADER_BYTES:
            raise CorruptData("a filter's header is cut off")
        magic, at = read_fixed(data, 0, 4)
        version, at = read_fixed(data, at, 4)
        bits, at = read_fixed(data, at, 8)
        k, at = read_fixed(data, at, 4)
        if (magic, version) != (HEADER_MAGIC, HEADER_VERSION):
            raise CorruptData("not a filter, or of another version")
        if not bits or not k or -(-bits // 8) != len(data) - HEADER_BYTES:
            raise CorruptData("a filter's parameters don't match its size")
        out = cls.__new__(cls)
        out.bits, out.k, out.data = bits, k, np.frombuffer(data, np.uint8, offset=HEADER_BYTES).copy()
        return out


#: Bytes of a filter that one task or-s together; a filter moves in pieces of this size.
PIECE_BYTES = 1 << 16


def build(df: DataFrame, key: str, expected: int | None = None, rate: float = 0.01) -> BloomFilter:
    """The filter of a binary column: partial filters a task, or-ed piece by piece, then put together.

    Null keys are no keys. What reaches the driver is the filter, whose size follows from expected (the
    count of keys if not given); one above BROADCAST_BYTES is refused.
    """
    keys = df.select(F.col(key).cast("binary").alias("key")).filter("key is not null")
    n = keys.count() if expected is None else expected
    out = BloomFilter(n, rate)
    if out.byte_size > BROADCAST_BYTES:
        raise ValueError(f"a filter of {n} keys takes {out.byte_size} bytes; join exactly instead")
    bits, k = out.bits, out.k

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = np.zeros((bits + 7) // 8, np.uint8)
        for b in batches:
            at = positions(b.column(0).to_pylist(), bits, k).ravel()
            np.bitwise_or.at(data, at >> 3, (1 << (at & 7)).astype(np.uint8))
        for piece in range(0, len(data), PIECE_BYTES):
            part = data[piece : piece + PIECE_BYTES]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int64()), pa.array([part.tobytes()], pa.binary())], ["piece", "data"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces: dict[int, np.ndarray] = {}
        for b in batches:
            for piece, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                part = np.frombuffer(data, np.uint8)
                pieces[piece] = pieces[piece] | part if piece in pieces else part
        if pieces:
            yield pa.RecordBatch.from_arrays([pa.array(list(pieces), pa.int64()), pa.array([p.tobytes() for p in pieces.values()], pa.binary())], ["piece", "data"])

    schema = "piece long, data binary"
    for piece, data in keys.mapInArrow(partial, schema).repartition("piece").mapInArrow(merge, schema).collect():
        out.data[piece : piece + len(data)] = np.frombuffer(bytes(data), np.uint8)
    return out


def probe(df: DataFrame, key: str, bloom: BloomFilter, flag: str = "maybe") -> DataFrame:
    """df with a boolean: false where the key is surely absent from the filter; null keys are absent."""
    shared = df.sparkSession.sparkContext.broadcast(bloom)

    @F.pandas_udf("boolean")
    def maybe(keys):  # noqa: ANN001, ANN202
        import pandas as pd

        return pd.Series(shared.value.may_contain_all([bytes(k) for k in keys]))

    present = F.col(key).isNotNull()
    return df.withColumn(flag, F.when(present, maybe(F.coalesce(F.col(key).cast("binary"), F.lit(b"")))).otherwise(F.lit(False)))


def semi_join(probes: DataFrame, build_side: DataFrame, key: str, rate: float = 0.01) -> DataFrame:
    """The probes whose key is in build_side, exactly: the filter drops most others before the join's shuffle.

    A build side whose filter would be too large to broadcast is joined directly.
    """
    n = build_side.count()
    if (size_bits(n, rate) + 7) // 8 > BROADCAST_BYTES:
        return probes.join(build_side.select(key), key, "left_semi")
    passed = probe(probes, key, build(build_side, key, n, rate), "__maybe").filter("__maybe").drop("__maybe")
    return passed.join(build_side.select(key), key, "left_semi")
