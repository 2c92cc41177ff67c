"""N-gram Jaccard self-join, without loss of links, by multiple-global-order filtering.

Each document is the set of its distinct word shingles. Sort two sets by one global order of all
shingles: if their Jaccard similarity reaches the threshold, their prefixes (a set's first
n - ceil(threshold * n) + 1 shingles) share a shingle, under whatever order. So candidates must share a
prefix shingle under each of several different orders.

Every order puts rare shingles first: the leading part of its key is the (logarithm of the) number of
documents that hold the shingle, estimated by a count sketch over the whole corpus, whose counters grow with the corpus up to
2^MAX_SKETCH_BITS; the rest is a hash that differs from order to order. An estimate may be off, which costs time but no link, as any
total order will do.

1. Sets are computed in numpy a batch at a time; documents with equal sets fold to one representative.
2. Representatives are joined on the prefix shingles of the first order. In each shingle's bucket
   everything is first held against one document, that with the fewest rarer shingles: a group of m near copies costs
   m pairs. Pairs must pass the size filter, the positional filter and the other orders, and are then verified on
   their whole texts.
3. What these links leave in different components of a bucket is joined in full, under the same
   filters. Pairs inside a component need no further link. A bucket in which more than SPLIT documents are left is split by
   the prefixes of the second order: its pairs must share a shingle of these too.

Shingles are compared by 64-bit hashes: within a pair of sets of n shingles, two different ones are taken for one with a chance
of n^2 / 2^64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from lodestrata.llm import common, shingles
from lodestrata.llm.components import connected_components

#: The sketch: a counter for every BYTES_A_COUNTER of text, from 2^MIN_SKETCH_BITS to 2^MAX_SKETCH_BITS of them, moved in blocks. The upper end
#: bounds what is broadcast (a byte each) and what a task counts in (four bytes each).
MIN_SKETCH_BITS, MAX_SKETCH_BITS = 20, 24
BYTES_A_COUNTER = 256
BLOCK = 1 << 15
#: Counting tasks for each core of the cluster: each sends one sketch, however many files it reads.
COUNTS_A_CORE = 4
#: Documents of a bucket, other than the head's, beyond which the second order splits it.
SPLIT = 2000
#: Seeds of the further orders. Their prefixes are kept as 32-bit hashes: a clash only lets a pair through.
ORDER_SEEDS = (0x5851F42D4C957F2D, 0x14057B7EF767814F)
SIGNATURES = "doc_id long, n long, digest binary, o1 array<long>, o2 array<int>, o3 array<int>"


def sketch_bits(n_bytes: int) -> int:
    """The logarithm of the number of counters for a corpus of so many bytes."""
    return min(MAX_SKETCH_BITS, max(MIN_SKETCH_BITS, (n_bytes // BYTES_A_COUNTER).bit_length()))


def _sketch(k: int, words: shingles.Words, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, some = np.zeros(1 << bits, np.uint32), False
        for b in batches:
            raw, bounds = shingles.text_bytes(b.column("text"))
            for s in shingles.shingle_sets(raw, bounds, k, words):
                if len(s):
                    np.add.at(counts, (s >> np.uint64(64 - bits)).astype(np.int64), 1)
                    some = True
        if some:
            pack = zstandard.ZstdCompressor(level=1)
            for i in range(0, len(counts), BLOCK):
                part = counts[i : i + BLOCK]
                if part.any():
                    planes = part.view(np.uint8).reshape(-1, 4).T.tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array([i // BLOCK], pa.int32()), pa.array([pack.compress(planes)], pa.binary())], ["block", "counts"])

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    unpack = zstandard.ZstdDecompressor()
    for b in batches:
        for block, data in zip(b.column("block").to_pylist(), b.column("counts").to_pylist(), strict=True):
            planes = np.frombuffer(unpack.decompress(data), np.uint8).reshape(4, -1)
            part = np.ascontiguousarray(planes.T).view(np.uint32).ravel()
            sums[block] = sums.get(block, 0) + part.astype(np.uint64)
    for block, total in sums.items():
        classes = np.floor(np.log2(np.maximum(total, 1).astype(np.float64))).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([classes.tobytes()], pa.binary())], ["block", "classes"])


def frequency_classes(texts: DataFrame, k: int, words: shingles.Words) -> np.ndarray:
    """log2 of the documents counted for each counter of the sketch, a byte each."""
    n_bytes = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    bits = sketch_bits(n_bytes)
    few = texts.coalesce(COUNTS_A_CORE * texts.sparkSession.sparkContext.defaultParallelism)
    parts = few.mapInArrow(_sketch(k, words, bits), "block int, counts binary")
    merged = parts.repartition("block").mapInArrow(_merge, "block int, classes binary")
    classes = np.zeros(1 << bits, np.uint8)
    for block, data in merged.collect():
        classes[block * BLOCK : (block + 1) * BLOCK] = np.frombuffer(bytes(data), np.uint8)
    return classes


def prefix_length(n: int, percent: int) -> int:
    return n - (percent * n + 99) // 100 + 1


def _smallest(keys: np.ndarray, p: int) -> np.ndarray:
    """Places of the p smallest keys, in order."""
    at = np.argpartition(keys, p - 1)[:p] if p < len(keys) else np.arange(len(keys))
    return at[np.argsort(keys[at], kind="stable")]


def _signatures(k: int, percent: int, words: shingles.Words, classes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = classes.value
        shift = np.uint64(64 - (len(table).bit_length() - 1))
        for b in batches:
            raw, bounds = shingles.text_bytes(b.column("text"))
            n, digests, first, rest = [], [], [], [[] for _ in ORDER_SEEDS]
            for s in shingles.shingle_sets(raw, bounds, k, words):
                n.append(len(s))
                digests.append(int(s.sum(dtype=np.uint64)).to_bytes(8, "little") + int(shingles.mix(s ^ np.uint64(ORDER_SEEDS[0])).sum(dtype=np.uint64)).to_bytes(8, "little"))
                if not len(s):
                    first.append(s.view(np.int64))
                    for r in rest:
                        r.append(np.empty(0, np.int32))
                    continue
                p = prefix_length(len(s), percent)
                rank = table[(s >> shift).astype(np.int64)].astype(np.uint64) << np.uint64(58)
                first.append(s[_smallest(rank | (s >> np.uint64(6)), p)].view(np.int64))
                for r, seed in zip(rest, ORDER_SEEDS, strict=True):
                    other = shingles.mix(s ^ np.uint64(seed))
                    at = np.argpartition(rank | (other >> np.uint64(6)), p - 1)[:p] if p < len(s) else slice(None)
                    r.append((other[at] & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32))
            lists = []
            for x, kind in ((first, pa.int64()), (rest[0], pa.int32()), (rest[1], pa.int32())):
                at = np.concatenate([[0], np.cumsum([len(y) for y in x])]).astype(np.int32)
                lists.append(pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(x) if x else [], kind)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), *lists], ["doc_id", "n", "digest", "o1", "o2", "o3"])

    return run


def _reaches(n1: Column, at1: Column, n2: Column, at2: Column, percent: int) -> Column:
    """The size filter, and the positional filter for a first shared shingle at places at1 and at2."""
    sizes = F.lit(100) * F.least(n1, n2) >= F.lit(percent) * F.greatest(n1, n2)
    bound = F.lit(1) + F.least(n1 - at1 - 1, n2 - at2 - 1)
    return sizes & (F.lit(100 + percent) * bound >= F.lit(percent) * (n1 + n2))


def _verify(k: int, percent: int, words: shingles.Words):
    def sets(batch: pa.RecordBatch, which: str) -> list[np.ndarray]:
        """Each row's set; one text in neighbouring rows of one id is hashed once."""
        ids, all_texts = batch.column(which).to_numpy(), batch.column(f"text_{which}").fill_null("")
        change = np.concatenate([[True], (ids[1:] != ids[:-1]) | pc.not_equal(all_texts[1:], all_texts[:-1]).to_numpy(zero_copy_only=False)])
        texts = all_texts.take(pa.array(np.flatnonzero(change)))
        found = list(shingles.shingle_sets(*shingles.text_bytes(texts), k, words))
        return [found[i] for i in np.cumsum(change) - 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                b = whole.slice(start, 256)
                linked = []
                for x, y in zip(sets(b, "a"), sets(b, "b"), strict=True):
                    shared = len(np.intersect1d(x, y, assume_unique=True))
                    linked.append(shared > 0 and 100 * shared >= percent * (len(x) + len(y) - shared))
                yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(linked, pa.bool_())], ["a", "b", "linked"])

    return run


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text", words: shingles.Words = shingles.BY_SPACE) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of docs.

    Two documents link when 100 * shared >= percent * all of their shingles; component_id is the smallest
    doc_id that links reach, the document's own included. A text of fewer than k words is one shingle,
    one of none (or null) has the empty set and links with nothing, not even its like. Repeated rows stay; rows that
    share a doc_id are one node. A null doc_id takes no part and has a null component. An empty table gives
    an empty result. percent must be 1 to 100. Ids may be of any type that has an order: integers are returned as longs.
    """
    if not 1 <= percent <= 100:
        raise ValueError("percent must be 1 to 100")
    rows = docs.select(common.col(doc_id).alias("doc_id"), common.col(text).alias("text"))
    if isinstance(rows.schema["doc_id"].dataType, IntegralType):
        return _components(rows.withColumn("doc_id", F.col("doc_id").cast("long")), k, percent, words)
    # Numbers in the order of the ids stand for them.
    named = rows.select(F.col("doc_id").alias("name")).na.drop().distinct().orderBy("name").withColumn("node", F.monotonically_increasing_id())
    named = common.cut(named, "jaccard-names")
    found = _components(rows.join(named, F.col("doc_id") == F.col("name"), "left").select(F.col("node").alias("doc_id"), "text"), k, percent, words)
    both = found.join(named.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumnRenamed("name", "own")
    both = both.join(named.select(F.col("node").alias("component_id"), "name"), "component_id", "left")
    return both.select(F.col("own").alias("doc_id"), "n_shingles", F.col("name").alias("component_id"))


def _components(texts: DataFrame, k: int, percent: int, words: shingles.Words) -> DataFrame:
    """jaccard_components() of (doc_id, text) with ids that are longs."""
    spark = texts.sparkSession
    classes = spark.sparkContext.broadcast(frequency_classes(texts, k, words))
    signed = common.cut(texts.mapInArrow(_signatures(k, percent, words, classes), SIGNATURES), "jaccard-signatures")

    # Equal sets fold to the smallest id; the empty set to nothing.
    filled = signed.filter("n > 0 and doc_id is not null")
    folded = common.cut(filled.groupBy("digest", "n").agg(F.min("doc_id").alias("rep")), "jaccard-classes")
    reps = signed.filter("n > 0").join(folded.select(F.col("rep").alias("doc_id"), "digest", "n"), ["doc_id", "digest", "n"], "left_semi")
    sets = common.cut(reps.select(F.col("doc_id").alias("doc"), "n", "o1"), "jaccard-sets")
    every = sets.select("doc", "n", F.posexplode("o1").alias("at", "token"))
    # Most tokens are of one document. Of the rest, a bucket folds to its head before the shuffle; the joins move single rows, so that Spark may split them.
    shared = common.cut(every.groupBy("token").agg(F.count("*").alias("m")).filter("m > 1").select("token"), "jaccard-shared")
    common.tidy(spark)
    buckets = common.cut(every.join(shared.hint("merge"), "token", "left_semi"), "jaccard-buckets")
    common.release(sets, shared)
    heads = common.cut(buckets.groupBy("token").agg(F.min(F.struct("at", "doc", "n")).alias("head")), "jaccard-heads")
    named = heads.select("token", F.col("head.doc").alias("head"), F.col("head.n").alias("head_n"), F.col("head.at").alias("head_at"))
    tokens = common.cut(buckets.join(named.hint("merge"), "token"), "jaccard-tokens")
    common.release(buckets, heads)
    common.tidy(spark)

    star = tokens.filter((F.col("doc") != F.col("head")) & _reaches(F.col("n"), F.col("at"), F.col("head_n"), F.col("head_at"), percent))
    star = star.select(F.least("doc", "head").alias("a"), F.greatest("doc", "head").alias("b")).distinct()
    checked = _check(star, signed, texts, k, percent, words)
    known = _labels(checked)

    # What is left: pairs of different components in one bucket. At least one of them is not of the head's.
    def labelled(rows: DataFrame, node: str, name: str) -> DataFrame:
        joined = rows.join(known.select(F.col("node").alias(node), F.col("component").alias("__c")), node, "left")
        return joined.withColumn(name, F.coalesce("__c", node)).drop("__c")

    marked = common.cut(labelled(labelled(tokens, "doc", "c"), "head", "head_c"), "jaccard-marked")
    common.release(tokens)
    common.tidy(spark)
    rest = _rest(marked, signed, percent)
    rest = rest.join(checked.select("a", "b"), ["a", "b"], "left_anti")
    more = _check(rest, signed, texts, k, percent, words)
    common.release(marked)
    final = common.cut(_labels(checked.unionAll(more)), "jaccard-components")
    common.release(checked, more)
    common.tidy(spark)

    named = folded.join(final.select(F.col("node").alias("rep"), "component"), "rep", "left").select("digest", "n", F.coalesce("component", "rep").alias("component"))
    named = common.cut(named, "jaccard-named")
    out = signed.select("doc_id", "n", "digest").join(named, ["digest", "n"], "left")
    component = F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("component", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def _rest(marked: DataFrame, signed: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of documents of different components that share a bucket and pass its filters, each once."""
    outside = marked.filter("c <> head_c")
    sizes = common.cut(outside.groupBy("token").agg(F.count("*").alias("outside")), "jaccard-outside")

    def pairs(rows: DataFrame, *keys: str) -> DataFrame:
        side = lambda x: [*keys, *[F.col(c).alias(f"{c}{x}") for c in ("doc", "n", "at", "c")]]
        both = rows.filter("c <> head_c").select(*side(1)).join(rows.select(*side(2)), list(keys))
        both = both.filter((F.col("c1") != F.col("c2")) & _reaches(F.col("n1"), F.col("at1"), F.col("n2"), F.col("at2"), percent))
        return both.select(F.least("doc1", "doc2").alias("a"), F.greatest("doc1", "doc2").alias("b"))

    small = marked.join(sizes.filter(F.col("outside") <= SPLIT), "token", "left_semi")
    large = marked.join(sizes.filter(F.col("outside") > SPLIT), "token", "left_semi")
    seconds = signed.select(F.col("doc_id").alias("doc"), F.explode("o2").alias("second")).distinct()
    split = common.cut(large.join(seconds, "doc"), "jaccard-split")
    return pairs(small, "token").unionAll(pairs(split, "token", "second")).distinct()


def text_classes(docs: DataFrame, k: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(copy, class) of the texts that links connect with other rows: common.text_key() and a number that a component shares.

    Where ids are null or repeat, the nodes are the different texts themselves.
    """
    rows = docs.select(common.col(doc_id).alias("doc_id"), common.text_key(text).alias("copy"), common.col(text).alias("text"))
    # A class is a number: of the smallest id of integers, else of a text.
    plain = isinstance(rows.schema["doc_id"].dataType, IntegralType) and distinct_ids(docs, doc_id)
    rows = rows.withColumn("doc_id", F.col("doc_id").cast("long")) if plain else rows
    nodes = rows if plain else common.cut(rows.filter("text is not null").groupBy("copy").agg(F.first("text").alias("text")).select(F.col("copy").alias("doc_id"), "text"), "class-texts")
    linked = common.cut(jaccard_components(nodes, k, percent).filter("component_id <> doc_id").select("doc_id", "component_id"), "class-links")
    members = linked.unionAll(linked.select("component_id", "component_id").distinct())
    if not plain:
        return members.select(F.col("doc_id").alias("copy"), F.col("component_id").alias("class"))
    return rows.select("doc_id", "copy").join(members, "doc_id").groupBy("copy").agg(F.min("component_id").alias("class"))


def distinct_ids(docs: DataFrame, doc_id: str = "doc_id") -> bool:
    """Whether every row has an id of its own."""
    return docs.groupBy(common.col(doc_id).alias("id")).count().filter("count > 1 or id is null").isEmpty()


def _labels(checked: DataFrame) -> DataFrame:
    return connected_components(checked.filter("linked").select("a", "b"))


def _check(pairs: DataFrame, signed: DataFrame, texts: DataFrame, k: int, percent: int, words: shingles.Words) -> DataFrame:
    """(a, b, linked) of the pairs that the other orders let through, verified on whole texts."""
    pairs = common.cut(pairs, "jaccard-pairs")
    orders = signed.filter("n > 0")
    mine = lambda x: orders.select(F.col("doc_id").alias(x), F.col("o2").alias(f"o2_{x}"), F.col("o3").alias(f"o3_{x}"))
    passed = pairs.join(mine("a"), "a").join(mine("b"), "b").filter(F.arrays_overlap("o2_a", "o2_b") & F.arrays_overlap("o3_a", "o3_b"))
    passed = common.cut(passed.select("a", "b").distinct(), "jaccard-candidates")
    text = lambda x: texts.select(F.col("doc_id").alias(x), F.col("text").alias(f"text_{x}"))
    both = passed.join(text("b"), "b").join(text("a"), "a").select("a", "text_a", "b", "text_b")
    found = both.mapInArrow(_verify(k, percent, words), "a long, b long, linked boolean")
    verified = common.cut(found.groupBy("a", "b").agg(F.max("linked").alias("linked")), "jaccard-verified")
    common.release(pairs, passed)
    return verified
