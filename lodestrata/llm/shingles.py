"""Word shingles of whole texts, hashed a batch at a time with numpy.

A word's hash is a polynomial over its bytes modulo 2^64 (prefix sums give all words of a batch at
once), mixed with the word's length; a shingle's is a polynomial over its words' hashes, mixed again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15 | 1, -1, 1 << 64))
#: Bytes that are hashed together: small enough for the processor's cache.
CHUNK_BYTES = 1 << 18
#: Bytes of text whose shingles are in memory together.
SLICE_BYTES = 4 << 20

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse."""
    if len(_powers[0]) < n:
        size = 1 << int(n - 1).bit_length()
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose output bits depend on all input bits (published SplitMix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Words:
    """Which bytes part words, and what each byte counts as."""

    def __init__(self, separators: bytes):
        self.parts = np.zeros(256, bool)
        self.parts[list(separators)] = True
        self.folded = np.arange(256, dtype=np.uint64)
        self.folded[65:91] += np.uint64(32)


#: Words between the white space that [^\x20\x09-\x0D]+ names; A-Z folded.
BY_SPACE = Words(bytes([0x20, *range(0x09, 0x0E)]))
#: Words of letters, digits and any non-ASCII bytes; A-Z folded.
BY_PUNCTUATION = Words(bytes(c for c in range(128) if not chr(c).isalnum()))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, and each row's bounds in them; null rows are empty."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    column = column.fill_null("") if column.null_count else column
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def _hash_words(raw: np.ndarray, bounds: np.ndarray, words: Words, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, ...]:
    """Hashes of the words of raw and their number for each row; then hashes of the words' first bytes for each length in prefixes."""
    n = len(raw)
    inside = np.empty(n + 2, bool)
    inside[0] = inside[-1] = False
    np.logical_not(words.parts[raw], out=inside[1:-1])
    first = np.zeros(n + 1, bool)
    first[bounds[:-1]] = True
    first[n] = True
    here, before = inside[1:], inside[:-1]
    starts = np.flatnonzero(here & (~before | first))
    ends = np.flatnonzero(before & (~here | first))
    power, inverse = _power_tables(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(words.folded[raw] * power[:n], out=sums[1:])
    hashes = (sums[ends] - sums[starts]) * inverse[starts]
    hashes += (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    counts = np.searchsorted(starts, bounds[1:]) - np.searchsorted(starts, bounds[:-1])
    heads = []
    for k in prefixes:
        stops = np.minimum(starts + k, ends)
        heads.append(mix((sums[stops] - sums[starts]) * inverse[starts] + np.uint64(k << 32)))
    return mix(hashes), counts, *heads


def word_prefix_hashes(raw: np.ndarray, bounds: np.ndarray, words: Words, prefixes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Like word_hashes, and the hashes of the words' first bytes for each length in prefixes."""
    hashes, counts, *heads = _hash_words(raw, bounds, words, prefixes)
    return hashes, np.concatenate([[0], np.cumsum(counts)]).astype(np.int64), heads


def word_hashes(raw: np.ndarray, bounds: np.ndarray, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all rows in a row, and each row's bounds in them. Rows are hashed in chunks of about CHUNK_BYTES."""
    found, counts, i, n = [], [], 0, len(bounds) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + CHUNK_BYTES, "right")) - 1)
        h, c, *_ = _hash_words(raw[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i], words)
        found.append(h)
        counts.append(c)
        i = j
    hashes = np.concatenate(found) if found else np.empty(0, np.uint64)
    return hashes, np.concatenate([[0], np.cumsum(np.concatenate(counts) if counts else [])]).astype(np.int64)


def shingle_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every k words in a row; shingle i starts at word i."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = hashes[:n].copy()
    for j in range(1, k):
        out *= _BASE
        out += hashes[j : j + n]
    return mix(out)


def whole_hash(hashes: np.ndarray) -> np.uint64:
    """The hash of a word sequence shorter than a shingle, told apart by its length."""
    return mix(shingle_hashes(hashes, len(hashes)) + np.uint64(len(hashes)))[0]


def row_slices(bounds: np.ndarray, n_bytes: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows of about n_bytes together; a longer row is one by itself."""
    i, n = 0, len(bounds) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + n_bytes, "right")) - 1)
        yield i, j
        i = j


def shingle_sets(raw: np.ndarray, bounds: np.ndarray, k: int, words: Words) -> Iterator[np.ndarray]:
    """Each row's sorted distinct shingle hashes; with fewer than k words the whole sequence is one; without any, none.

    Rows are hashed a slice at a time, so that memory does not grow with the batch.
    """
    for i, j in row_slices(bounds):
        hashes, at = word_hashes(raw[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i], words)
        all_of = shingle_hashes(hashes, k)
        for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if e - s >= k:
                x = np.sort(all_of[s : e - k + 1])
                yield x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) > 1 else x
            else:
                yield np.array([whole_hash(hashes[s:e])], np.uint64) if e > s else np.empty(0, np.uint64)
