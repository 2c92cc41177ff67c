"""Write-ahead log rows and frames as DataFrames.

Rows are (seq LONG, txn_id LONG, type INT, key BINARY, value BINARY) with a unique seq. A transaction id
of 2^63 or more does not fit a LONG and is refused.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions import codec

ROW = "seq long, txn_id long, type int, key binary, value binary"


def type_label(code: Column) -> Column:
    """BEGIN, PUT, DELETE, COMMIT or ABORT; null for an unknown code."""
    return F.element_at(F.array(*[F.lit(x) for x in codec.RECORD_LABELS]), F.when((code >= codec.BEGIN) & (code <= codec.ABORT), code + 1))


def encode_frames(log: DataFrame) -> DataFrame:
    """(seq, frame): each row's frame; records that break their type's rules raise."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = [b.column(c).to_pylist() for c in ("txn_id", "type", "key", "value")]
            frames = [codec.Record(t, k, key or b"", value or b"").frame() for t, k, key, value in zip(*columns, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("seq"), pa.array(frames, pa.binary())], ["seq", "frame"])

    return log.select("seq", "txn_id", "type", "key", "value").mapInArrow(encode, "seq long, frame binary")


def decode_frames(frames: DataFrame) -> DataFrame:
    """Log rows of (seq, frame), one frame a row; damage raises."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for frame in b.column("frame").to_pylist():
                record, end = codec.read_frame(frame, 0)
                if end != len(frame):
                    raise codec.CorruptData("bytes follow a frame")
                rows.append(record)
            columns = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
            kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("seq"), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], ["seq", "txn_id", "type", "key", "value"])

    return frames.select("seq", "frame").mapInArrow(decode, ROW)


def payload_checksums(log: DataFrame) -> DataFrame:
    """(seq, crc): the CRC-32 of each row's payload."""
    frames = encode_frames(log)
    return frames.select("seq", F.crc32(F.substring("frame", codec.FRAME_HEADER_BYTES + 1, codec.MAX_U32 >> 1)).alias("crc"))
