"""Token counts through a digest cache.

The cache is a Parquet table (content_digest, tokenizer_digest, n_tokens), parted by tokenizer, that only ever grows. A call reads its
own tokenizer's part, and keeps of it what its documents ask for before anything is grouped. A
document's normalised content (null counts as the empty text) and the tokenizer file's bytes are
digested with SHA-256; documents whose pair of digests is stored take the stored count. Of the rest
each distinct content is encoded once, and the new counts are appended.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm import common

CACHE_SCHEMA = "content_digest binary, tokenizer_digest string, n_tokens long"
#: Characters handed to the tokenizer at once: its working memory is some hundred bytes a token.
ENCODE_CHARS = 1 << 20
_LOADED: dict = {}


def tokenizer_digest(path: str) -> str:
    """The version of a tokenizer: SHA-256 of its vocabulary file."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def load_encoder(path: str):
    """texts -> counts, by the library that reads the file: tokenizers (.json) or sentencepiece (.model)."""
    if path not in _LOADED:
        if path.endswith(".json"):
            import os

            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            tok = Tokenizer.from_file(path)
            tok.no_truncation()
            tok.no_padding()
            _LOADED[path] = lambda texts: [len(e) for e in tok.encode_batch_fast(texts, add_special_tokens=False)]
        elif path.endswith(".model"):
            import sentencepiece

            sp = sentencepiece.SentencePieceProcessor(model_file=path)
            _LOADED[path] = lambda texts: [len(ids) for ids in sp.encode(texts, num_threads=1)]
        else:
            raise ValueError(f"no library is known for {path}")
    return _LOADED[path]


def _slices(texts: list[str]) -> Iterator[list[str]]:
    part, chars = [], 0
    for t in texts:
        part.append(t)
        chars += len(t)
        if chars >= ENCODE_CHARS:
            yield part
            part, chars = [], 0
    if part:
        yield part


def _encode(path: str, version: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _LOADED and tokenizer_digest(path) != version:
            # Counts by another file would be stored under this one's digest.
            raise ValueError(f"this machine's {path} is not the driver's")
        encode = load_encoder(path)
        for b in batches:
            counts: list[int] = []
            for part in _slices(b.column("content").to_pylist()):
                counts += encode(part)
            yield pa.RecordBatch.from_arrays([b.column("content_digest"), pa.array(counts, pa.int64())], ["content_digest", "n_tokens"])

    return run


def cached(spark: SparkSession, cache_path: str) -> DataFrame:
    """The cache; an absent one is empty."""
    target = spark._jvm.org.apache.hadoop.fs.Path(cache_path)
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        return spark.createDataFrame([], CACHE_SCHEMA)
    return spark.read.schema(CACHE_SCHEMA).parquet(cache_path)


def append_misses(contents: DataFrame, cache_path: str, tokenizer_path: str) -> DataFrame | None:
    """Encodes the distinct contents (content_digest, content) that the cache lacks and appends their counts.

    Returns the distinct digests of contents, or None if nothing was stored for this tokenizer before.
    """
    spark, version, wanted = contents.sparkSession, tokenizer_digest(tokenizer_path), None
    known = cached(spark, cache_path).filter(F.col("tokenizer_digest") == version).select("content_digest")
    if not known.isEmpty():
        # Only digests move to find the misses; texts move for the misses alone.
        wanted = common.cut(contents.select("content_digest").distinct(), "token-wanted")
        contents = contents.join(common.cut(wanted.join(known, "content_digest", "left_anti"), "token-misses"), "content_digest", "left_semi")
    # Copies fold together before the shuffle, so a content that fills a third of the table is one row a task.
    misses = contents.groupBy("content_digest").agg(F.first("content").alias("content"))
    counts = misses.mapInArrow(_encode(tokenizer_path, version), "content_digest binary, n_tokens long")
    counts.select("content_digest", F.lit(version).alias("tokenizer_digest"), "n_tokens").write.mode("append").partitionBy("tokenizer_digest").parquet(cache_path)
    return wanted


def count_tokens(docs: DataFrame, tokenizer_path: str, cache_path: str, text: str = "text") -> DataFrame:
    """docs with n_bytes (UTF-8) and n_tokens; columns of docs with those names, in any case, are replaced, all others stay.

    Null text counts as empty: 0 bytes, 0 tokens. Equal texts, repeated rows and rows with equal ids
    each keep their row. Texts are encoded whole, however long. An empty table gives an empty one.
    Counts are appended to cache_path before the result is planned, so a later call finds them.
    """
    spark, version = docs.sparkSession, tokenizer_digest(tokenizer_path)
    content = F.coalesce(common.col(text), F.lit(""))
    digest = F.unhex(F.sha2(F.encode(content, "UTF-8"), 256))
    wanted = append_misses(docs.select(digest.alias("content_digest"), content.alias("content")), cache_path, tokenizer_path)
    stored = cached(spark, cache_path).filter(F.col("tokenizer_digest") == version)
    if wanted is not None:
        stored = stored.join(wanted, "content_digest", "left_semi")
    # Two writers may have stored the same digest; their counts are equal.
    stored = common.cut(stored.groupBy("content_digest").agg(F.first("n_tokens").alias("n_tokens")), "token-counts")
    keep = common.others(docs, "n_bytes", "n_tokens")
    mine, theirs = common.helpers(docs, "digest", "stored")
    rows = docs.select(*[common.col(c) for c in keep], F.octet_length(content).cast("long").alias("n_bytes"), digest.alias(mine))
    right = stored.select(F.col("content_digest").alias(theirs), "n_tokens")
    return rows.join(right, F.col(mine) == F.col(theirs), "left").select(*[common.col(c) for c in keep], "n_bytes", "n_tokens")
