"""Toxicity by non-negative positive-unlabelled learning, in numpy over all unlabelled texts.

A text's features are its distinct words, and their first four and five bytes, hashed to buckets. Training sees confirmed
toxic texts and unlabelled ones, never negatives. With the class prior p, the risk over unlabelled texts that
are taken for negative, less p times the same risk over positives, estimates the negatives' risk; where
that estimate falls below zero a step undoes the overfitting instead (the non-negative estimator).

The positives are a sample bounded in rows and bytes. The unlabelled side is the whole corpus:

1. One pass counts in how many unlabelled texts each bucket of the positives occurs. The buckets that are most significantly
   commoner among positives, at most MAX_FEATURES, are the model's features.
2. A second pass turns each text to the set of features it holds; equal sets fold to one row and a count.
3. Each step of the descent is a pass over these folded rows: every task sends one vector of sums.

All sums are of integers (fixed-point values of single texts), so neither the order of rows nor their partitions
change the model by a bit. Scoring is a pass over the whole texts without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm import common, shingles

#: Bounds of the sample of labelled positives, in rows and bytes of text.
MAX_POSITIVES = 4000
POSITIVE_BYTES = 32 << 20
#: Features of a model, picked by their significance.
MAX_FEATURES = 256
#: A bucket is looked at if so many positives, and so large a share of them, have it.
LEAST_POSITIVES = 3
LEAST_SHARE = 0.002
#: Standard errors that a feature's rate among positives must exceed its rate among unlabelled texts by.
SIGNIFICANT = 4.0
TABLE_BITS = 18
PREFIXES = (4, 5)
#: The fixed-point unit of sums over texts: 10^9 texts with values up to 64 stay below 2^63.
UNIT = 1 << 24
#: Different feature sets that one task of a step reads, by the number of texts.
TEXTS_A_TASK = 1 << 20


def _text_slices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    raw, bounds = shingles.text_bytes(pc.utf8_lower(column))
    for i, j in shingles.row_slices(bounds):
        yield raw[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]


def features(column: pa.Array, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct features, ascending, and the rows' bounds in them; numbers: a bucket's feature, or -1."""
    found, sizes = [np.empty(0, np.int64)], [np.zeros(1, np.int64)]
    most, total = int(numbers.max()) + 1, 0
    for raw, bounds in _text_slices(column):
        hashes, at, heads = shingles.word_prefix_hashes(raw, bounds, shingles.BY_PUNCTUATION, PREFIXES)
        rows = np.repeat(np.arange(len(at) - 1), np.diff(at))
        pairs = []
        for x in (hashes, *heads):
            feature = numbers[(x >> np.uint64(64 - TABLE_BITS)).astype(np.int64)]
            known = np.flatnonzero(feature >= 0)
            pairs.append(rows[known] * most + feature[known])
        distinct = np.unique(np.concatenate(pairs))
        found.append(distinct % max(most, 1))
        ends = np.searchsorted(distinct, np.arange(1, len(at)) * most)
        sizes.append(ends + total)
        total += len(distinct)
    return np.concatenate(found), np.concatenate(sizes)


def row_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Each row's sum, added up within the row alone, so that it is the same in every batch."""
    n = np.diff(bounds)
    return np.bincount(np.repeat(np.arange(len(n)), n), values, len(n))


class Classifier:
    """Weights of features, which numbers names by bucket (-1: none), and a bias."""

    def __init__(self, numbers: np.ndarray, weights: np.ndarray, bias: float):
        self.numbers, self.weights, self.bias = numbers, weights, bias

    def logits(self, column: pa.Array) -> np.ndarray:
        found, at = features(column, self.numbers)
        return row_sums(self.weights[found], at) + self.bias

    def scores(self, column: pa.Array) -> np.ndarray:
        return logistic(self.logits(column))


def logistic(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def negative_sums(weights: np.ndarray, bias: float, found: np.ndarray, bounds: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Fixed-point sums over texts that are taken for negative: the loss, its derivative, and that by feature.

    The loss of a logit z is log(1 + exp(z)), its derivative logistic(z); a row stands for ``counts`` equal texts.
    """
    z = row_sums(weights[found], bounds) + bias
    slope = np.rint(logistic(z) * UNIT).astype(np.int64) * counts
    out = np.zeros(2 + len(weights), np.int64)
    out[0] = (np.rint(np.logaddexp(0, z) * UNIT).astype(np.int64) * counts).sum()
    out[1] = slope.sum()
    np.add.at(out[2:], found, np.repeat(slope, np.diff(bounds)))
    return out


def risk_gradient(prior: float, positive: tuple[np.ndarray, np.ndarray], unlabelled: np.ndarray, n_unlabelled: int, weights: np.ndarray, bias: float) -> tuple[float, np.ndarray]:
    """The negatives' estimated risk, and the direction of the non-negative estimator's descent: bias, then weights.

    unlabelled: negative_sums() of the unlabelled texts. The positives' own risk has the loss log(1 + exp(-z)).
    """
    found, at = positive
    n = len(at) - 1
    there = unlabelled / UNIT / n_unlabelled
    here = negative_sums(weights, bias, found, at, np.ones(n, np.int64)) / UNIT / n
    negative, slope = there - prior * here, np.empty(1 + len(weights))
    slope[:] = negative[1:]
    if negative[0] < 0:
        return float(negative[0]), -slope
    held = np.bincount(found, minlength=len(weights)) / n
    slope[0] -= prior * (1 - here[1])
    slope[1:] -= prior * (held - here[2:])
    return float(negative[0]), slope


def descend(prior: float, positive: tuple[np.ndarray, np.ndarray], sums: Callable[[np.ndarray, float], np.ndarray], n_unlabelled: int, n_features: int, steps: int = 50, rate: float = 0.2, sparsity: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and bias after ``steps`` of Adam on the whole data; sums(weights, bias) are negative_sums() of all unlabelled texts.

    Weights are kept non-negative and shrunk by ``sparsity`` (an L1 penalty): words are evidence of
    toxicity or none, so that a long text does not outweigh what it holds.
    """
    w, b = np.zeros(n_features), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(1 + n_features), np.zeros(1 + n_features)
    for t in range(1, steps + 1):
        risk, g = risk_gradient(prior, positive, sums(w, b), n_unlabelled, w, b)
        if risk >= 0:
            g[1:] += sparsity
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        step = rate * (1 - t / (steps + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        b -= float(step[0])
        w = np.maximum(w - step[1:], 0.0)
    return w, b


def buckets_of(positive: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The buckets that enough positives have, and in how many they occur."""
    found, _ = features(positive, np.arange(1 << TABLE_BITS))
    counts = np.bincount(found, minlength=1 << TABLE_BITS)
    often = np.flatnonzero(counts >= max(LEAST_POSITIVES, LEAST_SHARE * len(positive)))
    return often, counts[often]


def choose(buckets: np.ndarray, in_positives: np.ndarray, n_positives: int, in_unlabelled: np.ndarray, n_unlabelled: int) -> np.ndarray:
    """The buckets that are commoner among positives by SIGNIFICANT standard errors, the clearest first; of equal ones the first."""
    rate = in_unlabelled / n_unlabelled
    clear = (in_positives / n_positives - rate) / np.sqrt(np.maximum(rate * (1 - rate), 1.0 / n_unlabelled) / n_positives)
    order = np.argsort(-clear, kind="stable")
    return buckets[order[clear[order] >= SIGNIFICANT][:MAX_FEATURES]]


def numbered(buckets: np.ndarray) -> np.ndarray:
    out = np.full(1 << TABLE_BITS, -1, np.int64)
    out[buckets] = np.arange(len(buckets))
    return out


def document_frequencies(rows: DataFrame, buckets: np.ndarray) -> np.ndarray:
    """In how many texts of rows each bucket occurs. A task sends at most one row a bucket."""
    shared = rows.sparkSession.sparkContext.broadcast(numbered(buckets))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(buckets), np.int64)
        for b in batches:
            found, _ = features(b.column(0), shared.value)
            counts += np.bincount(found, minlength=len(counts))
        some = np.flatnonzero(counts)
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], ["feature", "n"])

    total = rows.mapInArrow(count, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n"))
    out = np.zeros(len(buckets), np.int64)
    for feature, n in total.collect():
        out[feature] = n
    return out


def folded(rows: DataFrame, numbers: np.ndarray, n_rows: int) -> DataFrame:
    """(found, n): the different sets of features that texts hold, as 16-bit numbers, and how many texts hold each."""
    shared = rows.sparkSession.sparkContext.broadcast(numbers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, at = features(b.column(0), shared.value)
            data = found.astype("<u2").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([data[2 * s : 2 * e] for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.binary())], ["found"])

    counted = rows.mapInArrow(run, "found binary").groupBy("found").agg(F.count("*").alias("n"))
    return common.cut(counted.coalesce(1 + n_rows // TEXTS_A_TASK), "toxicity-features")


def _unlabelled_sums(sets: DataFrame, n_features: int) -> Callable[[np.ndarray, float], np.ndarray]:
    def sums(weights: np.ndarray, bias: float) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(2 + n_features, np.int64)
            for b in batches:
                rows = b.column("found").to_pylist()
                at = np.concatenate([[0], np.cumsum([len(x) // 2 for x in rows])]).astype(np.int64)
                total += negative_sums(weights, bias, np.frombuffer(b"".join(rows), "<u2").astype(np.int64), at, b.column("n").to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

        total = np.zeros(2 + n_features, np.int64)
        for (part,) in sets.mapInArrow(run, "sums binary").collect():
            total += np.frombuffer(bytes(part), np.int64)
        return total

    return sums


def fit(docs: DataFrame, toxic_ids: DataFrame, prior: float, doc_id: str = "doc_id", text: str = "text") -> Classifier:
    """A classifier from docs whose id is in toxic_ids (column doc_id) as positives, and all docs as unlabelled.

    prior is the share of toxic texts among all. Null texts and ids take no part, nor does a positive of over half a megabyte. Without
    positives, unlabelled texts, features or a prior between 0 and 1, the score of every text is the prior.
    """
    rows = docs.select(common.col(doc_id).alias("doc_id"), common.col(text).alias("text")).filter("text is not null and doc_id is not null")
    ids = toxic_ids.select("doc_id").na.drop()
    ids = common.hashed_sample(ids, ["doc_id"], MAX_POSITIVES, F.lit(1), 64 * MAX_POSITIVES).column(0).to_pylist()
    known = rows.filter(F.col("doc_id").isin(ids)) if ids else rows.limit(0)
    positive = common.hashed_sample(known, ["doc_id", "text"], MAX_POSITIVES, F.octet_length("text"), POSITIVE_BYTES).column("text").combine_chunks()
    flat = Classifier(np.full(1 << TABLE_BITS, -1, np.int64), np.zeros(0), float(np.log(max(prior, 1e-6) / (1 - min(prior, 1 - 1e-6)))))
    n_rows = rows.count()
    if not len(positive) or not n_rows or not 0 < prior < 1:
        return flat
    texts = rows.select("text")
    buckets, here = buckets_of(positive)
    chosen = choose(buckets, here, len(positive), document_frequencies(texts, buckets), n_rows) if len(buckets) else buckets
    if not len(chosen):
        return flat
    numbers = numbered(chosen)
    weights, bias = descend(prior, features(positive, numbers), _unlabelled_sums(folded(texts, numbers, n_rows), len(chosen)), n_rows, len(chosen))
    used = weights > 0
    return Classifier(numbered(chosen[used]), weights[used], bias)


def score(docs: DataFrame, classifier: Classifier, text: str = "text", columns: list[str] | None = None) -> DataFrame:
    """docs, or these columns of it, with score (0 to 1) as the last one; a null text counts as empty and scores by the bias alone.

    Repeated rows score alike; an empty table gives an empty one. Columns named score, in any case, are replaced; all others stay as
    they are.
    """
    shared = docs.sparkSession.sparkContext.broadcast(classifier)
    rows, mine, at = common.with_text(docs, text, columns, "score")
    names = mine.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = shared.value.scores(b.column(at).fill_null(""))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(scores)], [*names, "score"])

    return rows.mapInArrow(run, mine.schema.add("score", "double"))
