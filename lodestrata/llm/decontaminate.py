"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly.

A short item hardly changes a long document's MinHash, so the search is between things of like size: items
are parted by size, and for each part the documents' shingles are cut into overlapping windows little
longer than its largest item, such that wherever an item lies, one window holds all of it. The least
Jaccard similarity that an item contained to the threshold can have with that window follows from the
sizes, and from it the number of MinHash functions (one a band) that leaves a chance of at most MISS
that none agrees. Windows run over the rows of a batch as one stream: those that cross two documents
only add candidates.

A candidate document is then held against the item exactly: the item's distinct shingles that occur
anywhere in the whole document, compared as words.

One pass over the documents, which hashes each text once, searches all items up to ITEMS_AT_ONCE and CHARS_AT_ONCE, which bound what is
broadcast; a larger set of items takes a pass for each block of so many. Documents never move.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from lodestrata.llm import common, shingles

#: The chance at most that a contained item shares no MinHash with its window.
MISS = 1e-6
#: Shingles whose minima are taken first; windows are runs of such blocks.
BLOCK = 8
#: What is broadcast at once: items and their characters (some four bytes of index for each).
ITEMS_AT_ONCE = 100_000
CHARS_AT_ONCE = 32 << 20
#: Items whose words a worker holds as a set, once they have been candidates.
WORD_SETS = 4096
_SPACED = bytes(32 if shingles.BY_PUNCTUATION.parts[c] else int(shingles.BY_PUNCTUATION.folded[c]) for c in range(256))


def _lowered(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return shingles.text_bytes(pc.utf8_lower(column))


def _words(raw: bytes) -> list[bytes]:
    return raw.translate(_SPACED).split()


@dataclass
class Part:
    """Items of like size: the windows' step and width in blocks, and for each function the items' minima, sorted."""

    step: int
    width: int
    minima: list[tuple[np.ndarray, np.ndarray, np.ndarray]]


def _size_bounds(largest: int) -> list[int]:
    """Upper ends of the size classes: doubling at first, then growing by half."""
    ends = [1]
    while ends[-1] < largest:
        ends.append(ends[-1] * 2 if ends[-1] < 8 else ends[-1] * 3 // 2)
    return ends


class ItemIndex:
    """A block of items: their words' shingles, and the MinHash minima of each size class."""

    def __init__(self, ids: list, texts: list[str], k: int, percent: int, seed: int = 11):
        self.ids, self.k, self.percent = ids, k, percent
        raw, bounds = _lowered(pa.array(texts, pa.string()))
        hashes, at = shingles.word_hashes(raw, bounds, shingles.BY_PUNCTUATION)
        everything = shingles.shingle_hashes(hashes, k)
        self.shingles: list[np.ndarray] = []
        self.texts: list[bytes] = []
        self._words: dict[int, set] = {}
        self.short: dict[tuple, list[int]] = {}
        spans: list[int] = []
        for i, (s, e) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
            self.texts.append(raw[bounds[i] : bounds[i + 1]].tobytes())
            self.shingles.append(np.unique(everything[s : max(s, e - k + 1)]))
            spans.append(max(0, e - s - k + 1))
            if 0 < e - s < k:
                self.short.setdefault(tuple(_words(self.texts[i])), []).append(i)
        self.functions: list[tuple[np.uint32, np.uint32]] = []
        self.parts: list[Part] = []
        rng = np.random.default_rng(seed)
        low = 0
        for high in _size_bounds(max(spans, default=0)):
            members = [i for i, n in enumerate(spans) if low < n <= high]
            low = high
            if not members:
                continue
            step = -(-high // BLOCK)
            width = step + -(-(high + BLOCK - 2) // BLOCK) + 1
            least = min(len(self.shingles[i]) for i in members)
            shared = -(-percent * least // 100)
            similarity = shared / (least + width * BLOCK - shared)
            n = math.ceil(math.log(MISS) / math.log(1 - similarity))
            while len(self.functions) < n:
                a, r = rng.integers(0, 1 << 32, 2, dtype=np.uint64)
                self.functions.append((np.uint32(a | 1), np.uint32(r)))
            minima = []
            for a, r in self.functions[:n]:
                values = np.array([(((self.shingles[i] >> np.uint64(32)).astype(np.uint32) ^ r) * a).min() for i in members], np.uint32)
                order = np.argsort(values, kind="stable")
                seen = np.zeros(1 << 16, bool)
                seen[values >> np.uint32(16)] = True
                minima.append((values[order], np.array(members, np.int32)[order], seen))
            self.parts.append(Part(step, width, minima))

    def words(self, item: int) -> set:
        """The item's distinct shingles as words."""
        if item not in self._words:
            if len(self._words) >= WORD_SETS:
                self._words.clear()
            w = _words(self.texts[item])
            self._words[item] = {tuple(w[j : j + self.k]) for j in range(len(w) - self.k + 1)}
        return self._words[item]

    def candidates(self, stream: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(first, end, item): places of a stream of shingle hashes whose window shares a minimum with an item."""
        n = len(stream)
        if not n or not self.functions:
            return
        blocks = -(-n // BLOCK)
        top = (stream >> np.uint64(32)).astype(np.uint32)
        padded = np.concatenate([top, np.full(blocks * BLOCK - n, top[-1], np.uint32)])
        lanes = np.ascontiguousarray(padded.reshape(blocks, BLOCK).T)
        scratch = np.empty_like(lanes)
        found: set[tuple[int, int, int]] = set()
        for f, (a, r) in enumerate(self.functions):
            np.bitwise_xor(lanes, r, out=scratch)
            np.multiply(scratch, a, out=scratch)
            spans = {1: scratch.min(axis=0)}
            for part in self.parts:
                if f >= len(part.minima):
                    continue
                values, items, seen = part.minima[f]
                lows = _window_minima(spans, part.width)[:: part.step]
                maybe = np.flatnonzero(seen[lows >> np.uint32(16)])
                first = np.searchsorted(values, lows[maybe], "left")
                same = values[np.minimum(first, len(values) - 1)] == lows[maybe]
                for at, s in zip(maybe[same].tolist(), first[same].tolist(), strict=True):
                    e = int(np.searchsorted(values, values[s], "right"))
                    for item in items[s:e].tolist():
                        found.add((at * part.step * BLOCK, (at * part.step + part.width) * BLOCK, item))
        yield from found


def _window_minima(spans: dict[int, np.ndarray], width: int) -> np.ndarray:
    """Minima of every run of width blocks (shorter at the end), from runs of powers of two."""
    size = 1
    while size * 2 <= width:
        if size * 2 not in spans:
            x = spans[size]
            y = x.copy()
            np.minimum(x[:-size], x[size:], out=y[:-size]) if size < len(x) else None
            spans[size * 2] = y
        size *= 2
    x = spans[size]
    shift = width - size
    if not shift or shift >= len(x):
        return x
    y = x.copy()
    np.minimum(x[:-shift], x[shift:], out=y[:-shift])
    return y


def _hits(index: ItemIndex, column: pa.Array) -> list[tuple[int, int, int, int]]:
    """(row, item, shared, n_item) of every text of the column that contains an item."""
    k = index.k
    raw, bounds = _lowered(column)
    hits: list[tuple[int, int, int, int]] = []
    for i, j in shingles.row_slices(bounds):
        hashes, at = shingles.word_hashes(raw[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i], shingles.BY_PUNCTUATION)
        stream = shingles.shingle_hashes(hashes, k)
        pairs: set[tuple[int, int]] = set()
        for s, e, item in index.candidates(stream):
            first = int(np.searchsorted(at, s, "right")) - 1
            pairs.update((row, item) for row in range(first, int(np.searchsorted(at, min(e, at[-1]), "left"))))
        if index.short:
            for row in np.flatnonzero((np.diff(at) > 0) & (np.diff(at) < k)).tolist():
                w = _words(raw[bounds[i + row] : bounds[i + row + 1]].tobytes())
                hits += [(i + row, item, 1, 1) for item in index.short.get(tuple(w), [])]
        last = -1
        words: list[bytes] = []
        for row, item in sorted(pairs):
            s, e = at[row], at[row + 1] - k + 1
            wanted = index.shingles[item]
            if e <= s:
                continue
            place = np.searchsorted(wanted, stream[s:e])
            same = np.flatnonzero(wanted[np.minimum(place, len(wanted) - 1)] == stream[s:e])
            if 100 * len(same) < index.percent * len(wanted):
                continue
            if row != last:
                words, last = _words(raw[bounds[i + row] : bounds[i + row + 1]].tobytes()), row
            n = len({t for x in same.tolist() if (t := tuple(words[x : x + k])) in index.words(item)})
            if 100 * n >= index.percent * len(index.words(item)):
                hits.append((i + row, item, n, len(index.words(item))))
    return hits


def _search(shared_index, item_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: ItemIndex = shared_index.value
        for b in batches:
            if hits := _hits(index, b.column("text")):
                rows, items, shared, sizes = (np.array(x) for x in zip(*hits, strict=True))
                ids = b.column("doc_id").take(pa.array(rows))
                found = pa.array([index.ids[i] for i in items], item_type)
                yield pa.RecordBatch.from_arrays([ids, found, pa.array(shared / sizes), pa.array(shared), pa.array(sizes)], ["doc_id", "item_id", "containment", "shared", "n_item"])

    return run


def _without(shared_index, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = np.ones(b.num_rows, bool)
            keep[[row for row, *_ in _hits(shared_index.value, b.column(text).fill_null(""))]] = False
            yield b.filter(pa.array(keep))

    return run


def _item_blocks(items: DataFrame) -> Iterator[tuple[list, list[str]]]:
    ids: list = []
    texts: list[str] = []
    chars = 0
    for r in items.toLocalIterator():
        ids.append(r["item_id"])
        texts.append(r["text"] or "")
        chars += len(texts[-1])
        if len(ids) >= ITEMS_AT_ONCE or chars >= CHARS_AT_ONCE:
            yield ids, texts
            ids, texts, chars = [], [], 0
    if ids:
        yield ids, texts


def contained_items(docs: DataFrame, items: DataFrame, k: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, containment, shared, n_item) where a document holds at least percent of an item's distinct shingles.

    Words are runs of ASCII letters and digits and of non-ASCII characters of the lower-cased text; a shingle is k
    words. An item of fewer than k words is contained only in a document of exactly these words; an item or document without
    words (or null) in and of nothing. Items with a null id are left out, as their hits could not be named: decontaminate() searches them too. Repeated rows give repeated rows; empty tables an empty result.
    Windows find an item whose shingles lie together; those of one that is scattered over a document in pieces are
    found if a window holds enough of them. Ids may be of any type, which the result has too.
    """
    spark = docs.sparkSession
    texts = docs.select(common.col(doc_id).alias("doc_id"), F.coalesce(common.col(text), F.lit("")).alias("text"))
    wanted = items.select(common.col(item_id).alias("item_id"), common.col(item_text).alias("text")).filter("item_id is not null")
    kind = wanted.schema["item_id"].dataType
    result = StructType().add("doc_id", texts.schema["doc_id"].dataType).add("item_id", kind).add("containment", "double").add("shared", "long").add("n_item", "long")
    found = None
    for ids, block in _item_blocks(wanted):
        index = spark.sparkContext.broadcast(ItemIndex(ids, block, k, percent))
        hits = texts.mapInArrow(_search(index, to_arrow_type(kind)), result)
        found = hits if found is None else found.unionAll(hits)
    return found if found is not None else spark.createDataFrame([], result)


def decontaminate(docs: DataFrame, items: DataFrame, k: int = 5, percent: int = 80, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs without the rows whose text contains an item, as contained_items() finds them; all columns stay.

    Rows go by their own text, whatever their ids, and so do items: one with a null id counts like any other. Each block of items is one more step of the same pass: nothing is shuffled.
    """
    wanted = items.select(common.col(item_id).alias("item_id"), common.col(item_text).alias("text"))
    for ids, block in _item_blocks(wanted):
        index = docs.sparkSession.sparkContext.broadcast(ItemIndex(ids, block, k, percent))
        docs = docs.mapInArrow(_without(index, text), docs.schema)
    return docs
