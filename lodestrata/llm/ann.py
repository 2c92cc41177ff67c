"""Approximate nearest neighbours by largest inner product: score-aware quantisation and table scans.

Vectors are cut into two-dimensional subspaces, each with sixteen codewords: four bits a subspace. The
codebooks minimise the score-aware loss, which weighs the part of the residual that is parallel to
the vector ``eta`` times its orthogonal part, since the parallel part is what changes large inner products.
They are fitted by block coordinate descent (codes, then codewords, each in closed form) on at most
SAMPLE_VECTORS vectors of each length; every vector is then encoded, and each has its codes in the index. A query meets the
vectors of its own length.

The index is a table of segments: vectors go to a segment by a hash, a segment holds SEGMENT_BYTES of them with their codes, and copies are folded
before they move. A search packs its queries likewise and holds every block of queries against every segment, in one job and without a shuffle of either. In a task,
each block builds its queries' tables a tile of TABLE_BYTES at a time, scans the segment's codes through them (two four-bit codes share one
table of 256 sums), and reranks the best ``rerank`` of the segment by exact double-precision inner products on the original vectors, which lie in the same row. What is found thus depends
on the vectors alone, neither on the order of rows nor on their partitions, and never is less than a rerank of the best ``rerank`` of the whole index would find. The k best of
each task meet in one small window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.llm import common

#: Bounds of the training sample of each length: vectors, and their bytes.
SAMPLE_VECTORS = 16384
SAMPLE_BYTES = 64 << 20
#: Bytes of vectors in a segment of the index and in a block of queries, and of the tables that a task holds at once.
SEGMENT_BYTES = 4 << 20
QUERY_BYTES = 1 << 20
TABLE_BYTES = 32 << 20
#: Candidates that a task keeps of blocks it has met, before it sends them on.
HELD = 1 << 20
CODEWORDS = 16
SUBSPACE_DIMS = 2
PACKED = "dims int, ids binary, vectors binary, codes binary, copies binary"
HITS = "query_id long, vec_id long, score double, copies long"


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, embedding (as it is) and dims of the vectors that take part.

    Those with a null id, null, zero, or with null or non-finite components, do not.
    """
    rows = vectors.select(common.col(vec_id).cast("long").alias("vec_id"), common.col(embedding).alias("embedding"))
    e = F.col("embedding")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    rows = rows.filter(F.col("vec_id").isNotNull() & e.isNotNull()).filter(finite & F.exists(e, lambda x: x != 0))
    return rows.withColumn("dims", F.size("embedding"))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


class Quantiser:
    """Codebooks (subspaces, 16, 2) and the weight eta of the parallel residual."""

    def __init__(self, books: np.ndarray, dims: int, eta: float):
        self.books, self.dims, self.eta = books, dims, eta

    @staticmethod
    def _split(x: np.ndarray) -> np.ndarray:
        """(n, dims) to (n, subspaces, 2), padded with zeros to an even number of subspaces."""
        width = -(-x.shape[1] // (2 * SUBSPACE_DIMS)) * 2 * SUBSPACE_DIMS
        return np.pad(x, ((0, 0), (0, width - x.shape[1]))).reshape(len(x), -1, SUBSPACE_DIMS)

    @classmethod
    def fit(cls, x: np.ndarray, threshold: float = 0.2, rounds: int = 8, seed: int = 7) -> Quantiser:
        dims = x.shape[1]
        parts = cls._split(x)
        n, m, _ = parts.shape
        eta = max(1.0, (dims - 1) * threshold**2 / (1 - threshold**2))
        rng = np.random.default_rng(seed)
        books = np.stack([parts[rng.integers(0, n, CODEWORDS), j] + rng.normal(0, 1e-9, (CODEWORDS, SUBSPACE_DIMS)) for j in range(m)])
        q = cls(books, dims, eta)
        weight = (eta - 1) / np.maximum((x**2).sum(1), 1e-300)
        codes = q.codes(x, sweeps=1, weigh=False)
        for _ in range(rounds):
            parallel = q._parallel(parts, codes)
            for j in range(m):
                own = parts[:, j]
                rest = parallel.sum(1) - parallel[:, j]
                for c in range(CODEWORDS):
                    at = codes[:, j] == c
                    if not at.any():
                        q.books[j, c] = own[rng.integers(0, n)]
                        continue
                    v, w = own[at], weight[at]
                    # Setting the gradient of the loss in the codeword to zero gives a 2 x 2 system.
                    left = at.sum() * np.eye(SUBSPACE_DIMS) + (v * w[:, None]).T @ v
                    right = v.sum(0) + (v * (w * (rest[at] + (v * v).sum(1)))[:, None]).sum(0)
                    q.books[j, c] = np.linalg.solve(left, right)
                parallel[:, j] = ((own - q.books[j][codes[:, j]]) * own).sum(1)
            codes = q.codes(x, start=codes)
        return q

    def _parallel(self, parts: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Each subspace's share of <residual, vector>."""
        return np.stack([((parts[:, j] - self.books[j][codes[:, j]]) * parts[:, j]).sum(1) for j in range(parts.shape[1])], 1)

    def codes(self, x: np.ndarray, sweeps: int = 2, start: np.ndarray | None = None, weigh: bool = True) -> np.ndarray:
        """Codes (n, subspaces) by coordinate descent on the score-aware loss; first guess: nearest codewords."""
        parts = self._split(x)
        m = parts.shape[1]
        far = [((parts[:, j, None] - self.books[j]) ** 2).sum(2) for j in range(m)]
        along = [(parts[:, j] ** 2).sum(1)[:, None] - parts[:, j] @ self.books[j].T for j in range(m)]
        codes = start.copy() if start is not None else np.stack([f.argmin(1) for f in far], 1)
        if not weigh:
            return codes
        weight = ((self.eta - 1) / np.maximum((x**2).sum(1), 1e-300))[:, None]
        rows = np.arange(len(x))
        total = sum(along[j][rows, codes[:, j]] for j in range(m))
        for _ in range(sweeps):
            for j in range(m):
                rest = total - along[j][rows, codes[:, j]]
                codes[:, j] = (far[j] + weight * (rest[:, None] + along[j]) ** 2).argmin(1)
                total = rest + along[j][rows, codes[:, j]]
        return codes

    def pack(self, codes: np.ndarray) -> np.ndarray:
        """Two codes a byte."""
        return (codes[:, 0::2] * CODEWORDS + codes[:, 1::2]).astype(np.uint8)

    def tables(self, query: np.ndarray) -> np.ndarray:
        """(bytes, 256) sums of the query's inner products with the two codewords that a byte names."""
        parts = self._split(query[None])[0]
        one = np.einsum("jcd,jd->jc", self.books, parts).astype(np.float32)
        return (one[0::2, :, None] + one[1::2, None, :]).reshape(-1, CODEWORDS * CODEWORDS)


def fit(rows: DataFrame, sample: int = SAMPLE_VECTORS) -> dict[int, Quantiser]:
    """A quantiser for each length of the usable vectors, from at most ``sample`` of each, taken by their hashes."""
    size = 8 * F.col("dims")
    got = common.hashed_sample(rows, ["vec_id", "embedding"], sample, size, SAMPLE_BYTES, per="dims")
    lengths = got.column("dims").to_numpy()
    # A vector longer than the sample's bytes allow has no codes of its own; all of its length are then compared exactly.
    return {int(d): Quantiser.fit(_matrix(got.filter(pa.array(lengths == d)).column("embedding").combine_chunks(), int(d))) for d in np.unique(lengths)}


def _folded(rows: pa.RecordBatch, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, vectors and numbers of copies of a batch's different rows, which are all of one length."""
    ids, vectors = rows.column("vec_id").to_numpy(), _matrix(rows.column("embedding"), dims)
    copies = np.ones(len(ids), np.int64)
    if len(np.unique(ids)) < len(ids):
        whole = np.concatenate([ids[:, None].astype(np.int64), vectors.view(np.int64)], axis=1)
        _, first, copies = np.unique(whole, axis=0, return_index=True, return_counts=True)
        ids, vectors = ids[first], vectors[first]
    return ids, vectors, copies


def _encode(shared):
    """(dims, segment, vec_id, vector, codes, copies) of the different rows of each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quantisers: dict[int, Quantiser] = shared.value
        for b in batches:
            parts = b.column("part").to_numpy()
            lengths = b.column("dims").to_numpy()
            for d, part in {(int(d), int(p)) for d, p in zip(lengths, parts, strict=True)}:
                ids, vectors, copies = _folded(b.filter(pa.array((lengths == d) & (parts == part))), d)
                codes = [b""] * len(ids)
                if d in quantisers:
                    codes = [r.tobytes() for r in quantisers[d].pack(quantisers[d].codes(vectors))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([d] * len(ids), pa.int32()), pa.array([part] * len(ids), pa.int64()), pa.array(ids), pa.array([v.tobytes() for v in vectors], pa.binary()), pa.array(codes, pa.binary()), pa.array(copies)],
                    ["dims", "part", "vec_id", "vector", "codes", "copies"],
                )

    return run


def _pack(width: int):
    """Segments of the sorted rows of (dims, part): their copies folded anew, width bytes of vectors a row."""

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        d, ids, vectors, codes, copies = rows[0][0], [r[2] for r in rows], [r[3] for r in rows], [r[4] for r in rows], [r[5] for r in rows]
        return pa.RecordBatch.from_arrays(
            [pa.array([d], pa.int32()), pa.array([np.array(ids, np.int64).tobytes()], pa.binary()), pa.array([b"".join(vectors)], pa.binary()), pa.array([b"".join(codes)], pa.binary()), pa.array([np.array(copies, np.int64).tobytes()], pa.binary())],
            ["dims", "ids", "vectors", "codes", "copies"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for b in batches:
            for row in zip(*[b.column(i).to_pylist() for i in range(6)], strict=True):
                if rows and rows[-1][:4] == row[:4]:
                    rows[-1] = (*row[:5], rows[-1][5] + row[5])
                    continue
                if rows and (rows[-1][:2] != row[:2] or len(rows) * 8 * row[0] >= width):
                    yield flush(rows)
                    rows = []
                rows.append(row)
        if rows:
            yield flush(rows)

    return run


def pack(rows: DataFrame, quantisers: dict[int, Quantiser], width: int, label: str) -> DataFrame:
    """The usable rows as PACKED segments of about width bytes of vectors, written to the shared folder.

    The segment of a row follows from its id and vector and from the number of rows of its length.
    """
    counts = {r["dims"]: r["count"] for r in rows.groupBy("dims").count().collect()}
    if not counts:
        return rows.sparkSession.createDataFrame([], PACKED)
    parts = F.create_map(*[F.lit(x) for d, n in counts.items() for x in (d, max(1, -(-n * d * 8 // width)))])
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("vec_id", "embedding", F.lit("part")), F.element_at(parts, F.col("dims")).cast("long")))
    shared = rows.sparkSession.sparkContext.broadcast(quantisers)
    coded = dealt.mapInArrow(_encode(shared), "dims int, part long, vec_id long, vector binary, codes binary, copies long")
    together = coded.repartition("dims", "part").sortWithinPartitions("dims", "part", "vec_id", "vector")
    return common.cut(together.mapInArrow(_pack(width), PACKED), label)


def _best(scores: np.ndarray, n: int) -> np.ndarray:
    """Places of the n largest scores; of equal ones at the edge, the first places."""
    if len(scores) <= n:
        return np.arange(len(scores))
    edge = np.partition(scores, len(scores) - n)[len(scores) - n]
    above = np.flatnonzero(scores > edge)
    return np.concatenate([above, np.flatnonzero(scores == edge)[: n - len(above)]])


def _nearest(quantiser: Quantiser | None, ids: np.ndarray, queries: np.ndarray, vec_ids: np.ndarray, vectors: np.ndarray, codes: np.ndarray, k: int, rerank: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each query, the scores and places of its k nearest in a segment, itself apart."""
    tile = len(ids) if quantiser is None else max(1, TABLE_BYTES // (4 * CODEWORDS * CODEWORDS * len(codes)))
    scores, term = np.empty(len(vec_ids), np.float32), np.empty(len(vec_ids), np.float32)
    for s in range(0, len(ids), tile):
        tables = [quantiser.tables(q) for q in queries[s : s + tile]] if quantiser is not None else None
        for i in range(s, min(s + tile, len(ids))):
            own = vec_ids == ids[i]
            if tables is None:
                at = np.flatnonzero(~own)
            else:
                np.take(tables[i - s][0], codes[0], out=scores, mode="clip")
                for p in range(1, len(codes)):
                    np.take(tables[i - s][p], codes[p], out=term, mode="clip")
                    scores += term
                scores[own] = -np.inf
                at = _best(scores, rerank)
                at = at[~own[at]]
            exact = (vectors[at] * queries[i]).sum(1)
            first = np.lexsort((vec_ids[at], -exact))[:k]
            yield exact[first], at[first]


def _scan(shared, k: int, rerank: int):
    """The k nearest of every query in all segments that a task meets."""

    def sent(kept: dict) -> pa.RecordBatch:
        n = [len(x[0]) for x in kept.values()]
        out = [np.repeat(np.array([q for q, _ in kept], np.int64), n), *[np.concatenate([x[j] for x in kept.values()]) for j in (1, 0, 2)]]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in out], ["query_id", "vec_id", "score", "copies"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quantisers: dict[int, Quantiser] = shared.value
        kept: dict[tuple, tuple] = {}
        for b in batches:
            for d, ids, queries, dims, vec_ids, vectors, codes, copies in zip(*[b.column(i).to_pylist() for i in range(8)], strict=True):
                if d != dims:
                    continue
                vec_ids, copies = np.frombuffer(vec_ids, np.int64), np.frombuffer(copies, np.int64)
                vectors, ids, queries = np.frombuffer(vectors).reshape(-1, d), np.frombuffer(ids, np.int64), np.frombuffer(queries).reshape(-1, d)
                codes = np.frombuffer(codes, np.uint8).reshape(len(vec_ids), -1).T.copy()
                for q, (s, at) in zip(ids.tolist(), _nearest(quantisers.get(d), ids, queries, vec_ids, vectors, codes, k, rerank), strict=True):
                    found = s, vec_ids[at], copies[at]
                    if before := kept.get((q, d)):
                        found = tuple(np.concatenate(x) for x in zip(before, found, strict=True))
                        first = np.lexsort((found[1], -found[0]))[:k]
                        found = tuple(x[first] for x in found)
                    if len(found[0]):
                        kept[q, d] = found
                if len(kept) * k >= HELD:
                    yield sent(kept)
                    kept = {}
        if kept:
            yield sent(kept)

    return run


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, rerank: int = 200, vec_id: str = "vec_id", embedding: str = "embedding", query_bytes: int = QUERY_BYTES, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of each query's k nearest found, itself apart.

    Both tables hold vec_id and embedding; vectors that usable() leaves out take no part on either side. A query is held against the vectors of
    its own length, and of several rows with one id that with the smallest hash is the query. Scores are exact; ties go to the smaller vec_id. With
    fewer candidates than k, all are returned; an empty table gives an empty result. Repeated rows are
    candidates each. Other columns play no part.
    """
    spark = vectors.sparkSession
    rows, asked = usable(vectors, vec_id, embedding), usable(queries, vec_id, embedding)
    quantisers = fit(rows)
    index = pack(rows, quantisers, segment_bytes, "ann-index")
    one = asked.groupBy("vec_id").agg(F.min_by(F.struct("embedding", "dims"), F.xxhash64("embedding")).alias("q")).select("vec_id", "q.embedding", "q.dims")
    blocks = pack(one, {}, query_bytes, "ann-queries").select(F.col("dims").alias("query_dims"), F.col("ids").alias("query_ids"), F.col("vectors").alias("query_vectors"))
    # A stated set of queries, in blocks, against all rows: a row of the product is a whole block and a whole segment.
    pairs = blocks.crossJoin(index)
    hits = pairs.mapInArrow(_scan(spark.sparkContext.broadcast(quantisers), k, rerank), HITS)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = hits.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)
    each = best.select("query_id", "vec_id", "score", F.explode(F.sequence(F.lit(1).cast("long"), F.least("copies", F.lit(k).cast("long")))).alias("copy"))
    ranked = each.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
