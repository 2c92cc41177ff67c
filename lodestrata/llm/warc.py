"""Dictionary-compressed WARC archives.

An archive is a ``.warc.zst`` file: a leading skippable frame that holds a Zstandard dictionary, then
each WARC/1.1 record as a frame of its own, compressed with that dictionary. The dictionary is built
from the archive's own first records (up to ``sample_bytes``, of each its first SAMPLE_RECORD_BYTES), so it needs no pass before the
write. Where these are too few or too alike to train one, their beginnings are the dictionary, as plain content that the frame holds compressed.
Records are archived whole.

Each executor streams its rows into archives of about ``archive_bytes``: memory holds the sample and
one record at a time. A file's name holds the task attempt that wrote it, and the manifest (a Parquet
table that Spark commits) names the files of successful attempts only, so retries neither clash nor count
twice. The folder must be reachable by pyarrow's file systems under its own URI.
"""

from __future__ import annotations

import base64
import contextlib
import hashlib
import io
import struct
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm import common
from lodestrata.sources.shared import filesystem

#: Fixed values of the published formats: the skippable frame's magic, and Zstandard's own.
DICTIONARY_MAGIC = 0x184D2A5D
ZSTD_MAGIC = 0xFD2FB528
DICTIONARY_HEAD = b"\x37\xa4\x30\xec"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: One record's share of the dictionary's sample, and of a dictionary of plain content.
SAMPLE_RECORD_BYTES = 128 << 10
PLAIN_RECORD_BYTES = 2 << 10
MANIFEST = "archive string, n_records long, n_bytes long"
RECORDS = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary"


def record_id(name: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, name)}>"


def response_id(page_id: int, digest: str) -> str:
    """The id of the only response with this page_id and payload: revisits can name it without having seen it."""
    return record_id(f"page/{page_id}/{digest}")


def base32_sha1(digest: bytes) -> str:
    return base64.b32encode(digest).decode("ascii")


def _uri(url: str) -> str:
    """A url as a header value: controls and spaces are percent-encoded."""
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def build_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, n_bytes: int, date: str, place: str = "", alone: bool = True) -> bytes:
    """One uncompressed record. A revisit has the response's HTTP headers but no payload.

    place is unlike that of any other record; alone tells that one row only has the response's page_id and payload.
    """
    alone = alone and (page_id if refers_to is None else refers_to) is not None
    own = response_id(page_id, digest) if refers_to is None and alone else record_id(f"place/{place}")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {own}", f"WARC-Date: {date}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_uri(url)}")
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", *([f"WARC-Refers-To: {response_id(refers_to, digest)}"] if alone else []), f"X-Refers-To-Page-ID: {refers_to}"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8") + b"\r\n\r\n" + block + b"\r\n\r\n"


def train(samples: list[bytes], dict_bytes: int) -> bytes:
    """A trained dictionary; where the samples are too few or too alike for one, their beginnings."""
    # A dictionary larger than a fraction of its sample can't be trained.
    size = min(dict_bytes, sum(map(len, samples)) // 10)
    if len(samples) >= 8 and size >= 1024:
        with contextlib.suppress(zstandard.ZstdError):
            return zstandard.train_dictionary(size, samples).as_bytes()
    return b"".join(x[:PLAIN_RECORD_BYTES] for x in samples[: max(1, dict_bytes // PLAIN_RECORD_BYTES)])


class _Archive:
    """One file being written: records wait until the sample is full, then stream."""

    def __init__(self, files: fs.FileSystem, path: str, dict_bytes: int, sample_bytes: int, level: int):
        self.files, self.path, self.dict_bytes, self.sample_bytes, self.level = files, path, dict_bytes, sample_bytes, level
        self.waiting: list[bytes] = []
        self.waited = self.taken = self.n = 0
        self.out = self.compressor = None

    def _open(self) -> None:
        self.out = self.files.open_output_stream(self.path, compression=None)
        data = train([r[:SAMPLE_RECORD_BYTES] for r in self.waiting], self.dict_bytes)
        kept = data if data[:4] == DICTIONARY_HEAD else zstandard.ZstdCompressor(level=self.level).compress(data)
        self.out.write(struct.pack("<II", DICTIONARY_MAGIC, len(kept)) + kept)
        self.compressor = zstandard.ZstdCompressor(level=self.level, dict_data=zstandard.ZstdCompressionDict(data), write_checksum=True, write_content_size=True)
        for r in self.waiting:
            self.out.write(self.compressor.compress(r))
        self.waiting = []

    def add(self, record: bytes) -> None:
        self.n += 1
        self.taken += len(record)
        if self.out is None:
            self.waiting.append(record)
            self.waited += len(record)
            if self.waited >= self.sample_bytes:
                self._open()
        else:
            self.out.write(self.compressor.compress(record))

    def close(self) -> tuple[str, int, int]:
        if self.out is None:
            self._open()
        self.out.close()
        return self.path, self.n, self.taken


def _writer(root: str, archive_bytes: int, dict_bytes: int, sample_bytes: int, level: int, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = filesystem(root)
        files.create_dir(base, recursive=True)
        task, seq, current, done = TaskContext.get(), 0, None, []
        for b in batches:
            columns = [b.column(c) for c in ("page_id", "url", "payload", "digest", "refers_to", "n_bytes", "alone")]
            for i in range(b.num_rows):
                page_id, url, payload, digest, refers_to, n_bytes, alone = (c[i].as_py() for c in columns)
                if current is None:
                    name = f"{base}/part-{task.partitionId():05d}-{task.taskAttemptId()}-{seq:04d}.warc.zst"
                    current, seq = _Archive(files, name, dict_bytes, sample_bytes, level), seq + 1
                current.add(build_record(page_id, url, payload or b"", base32_sha1(digest), refers_to, n_bytes, date, f"{current.path}/{current.n}", alone))
                if current.taken >= archive_bytes:
                    done.append(current.close())
                    current = None
        if current is not None:
            done.append(current.close())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], ["archive", "n_records", "n_bytes"])

    return run


def label_copies(pages: DataFrame, payload: str = "html", page_id: str = "page_id", url: str = "url", min_revisit_bytes: int = 0) -> DataFrame:
    """page_id, url, payload (bytes; null for revisits), digest (SHA-1), n_bytes, refers_to (null for responses) and alone (whether
    one row only has the response's page_id and payload). Page ids are integers.

    Of rows with equal payloads of at least min_revisit_bytes, those with the largest page_id are
    responses and the others refer to it; a null page_id is always a response. The rows of a hot payload are
    counted before any shuffle, and the join that follows moves single rows, so Spark may split them.
    """
    content = F.encode(F.coalesce(F.col(f"`{payload}`"), F.lit("")), "UTF-8")
    rows = pages.select(F.col(f"`{page_id}`").cast("long").alias("page_id"), F.col(f"`{url}`").alias("url"), content.alias("payload"), F.unhex(F.sha1(content)).alias("digest"), F.octet_length(content).cast("long").alias("n_bytes"))
    pairs = rows.select("digest", "page_id").groupBy("digest", "page_id").agg(F.count("*").alias("n"))
    groups = pairs.groupBy("digest").agg(F.max(F.struct("page_id", "n")).alias("last"), F.sum("n").alias("copies")).filter("copies > 1")
    groups = common.cut(groups.select("digest", F.col("last.page_id").alias("winner"), (F.col("last.n") == 1).alias("lone")), "warc-copies")
    joined = rows.join(groups, "digest", "left")
    refers = F.when((F.col("page_id") != F.col("winner")) & (F.col("n_bytes") >= min_revisit_bytes), F.col("winner"))
    out = joined.withColumn("refers_to", refers)
    return out.select("page_id", "url", F.when(F.col("refers_to").isNull(), F.col("payload")).alias("payload"), "digest", "n_bytes", "refers_to", F.coalesce("lone", F.lit(True)).alias("alone"))


def write_archives(labelled: DataFrame, root: str, archive_bytes: int = 64 << 20, dict_bytes: int = 64 << 10, sample_bytes: int = 1 << 20, level: int = 3, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Writes the rows of label_copies() below root; returns the manifest (archive, n_records, n_bytes).

    An empty table writes no archive. Records of any size are whole; one larger than archive_bytes
    closes its archive.
    """
    spark = labelled.sparkSession
    manifest = labelled.mapInArrow(_writer(f"{root}/archives", archive_bytes, dict_bytes, sample_bytes, level, date), MANIFEST)
    manifest.write.parquet(f"{root}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{root}/manifest")


def read_records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of an open .warc.zst stream: headers (lower-case names) and block."""
    head = stream.read(8)
    data = None
    if len(head) == 8 and struct.unpack("<I", head[:4])[0] == DICTIONARY_MAGIC:
        data = stream.read(struct.unpack("<I", head[4:])[0])
        if struct.unpack("<I", data[:4])[0] == ZSTD_MAGIC:
            data = zstandard.ZstdDecompressor().decompress(data)
        head = b""
    decompressor = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data) if data else None)
    source = _Rejoined(head, stream)
    reader = io.BufferedReader(decompressor.stream_reader(source, read_across_frames=True), 1 << 20)
    while True:
        version = reader.readline()
        if not version:
            return
        if not version.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {version[:40]!r}")
        headers = dict(_headers(iter(reader.readline, b"\r\n")))
        n = int(headers["content-length"])
        block = reader.read(n)
        if len(block) != n or reader.read(4) != b"\r\n\r\n":
            raise ValueError("a WARC record is cut short")
        yield headers, block


class _Rejoined:
    """A stream whose first bytes were already read."""

    def __init__(self, head: bytes, rest):
        self.head, self.rest = head, rest

    def read(self, n: int = -1) -> bytes:
        if self.head:
            out, self.head = self.head, b""
            return out
        return self.rest.read(n)


def _headers(lines: Iterable[bytes]) -> Iterator[tuple[str, str]]:
    for line in lines:
        if not line:
            raise ValueError("a WARC record's header is cut short")
        name, _, value = line.decode("utf-8").partition(":")
        yield name.strip().lower(), value.strip()


def _parse(headers: dict[str, str], block: bytes) -> tuple:
    http, _, payload = block.partition(b"\r\n\r\n")
    fields = dict(_headers(http.split(b"\r\n")[1:]))
    digest = headers["warc-payload-digest"].removeprefix("sha1:")
    number = lambda k: int(headers[k]) if k in headers else None
    kind = headers["warc-type"]
    if kind == "response":
        if base32_sha1(hashlib.sha1(payload).digest()) != digest:
            raise ValueError(f"payload of {headers['warc-record-id']} does not match its digest")
        n, kept = len(payload), payload
    else:
        n, kept = int(fields["content-length"]), None
    return number("x-page-id"), headers.get("warc-target-uri"), kind, number("x-refers-to-page-id"), digest, n, kept


def _reader(root: str, payloads: bool):
    names = [c.split()[0] for c in RECORDS.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = filesystem(root)
        for b in batches:
            for archive in b.column("archive").to_pylist():
                rows, held = [], 0
                with files.open_input_stream(archive, compression=None) as stream:
                    for headers, block in read_records(stream):
                        row = _parse(headers, block)
                        rows.append(row if payloads else (*row[:-1], None))
                        held += len(block) if payloads else 256
                        if held >= 4 << 20:
                            yield batch(rows)
                            rows, held = [], 0
                if rows:
                    yield batch(rows)

    return run


def read_archives(spark: SparkSession, root: str, payloads: bool = True) -> DataFrame:
    """The records of every archive that the manifest names; each response's payload is held against its digest."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{root}/manifest")
    spread = manifest.select("archive").repartition(max(1, spark.sparkContext.defaultParallelism))
    return spread.mapInArrow(_reader(root, payloads), RECORDS)
