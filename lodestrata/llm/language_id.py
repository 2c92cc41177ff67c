"""Language identification by a bidirectional gated recurrent network over bytes, in numpy.

Each byte of a text is an input; one network runs forwards and one backwards; a linear layer over both states
labels every position with a distribution over languages, and a document's probabilities are the
mean over its positions. Texts are read whole, cut into segments of SEGMENT bytes that start from a zero state, so that
thousands of segments advance together as the columns of one matrix.

The network is trained by backpropagation through time with Adam on segments drawn from at most MAX_TEXTS
labelled texts of each language, chosen and ordered by their hashes: neither the order of rows nor their partitions matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.llm import common, shingles

#: Bounds of the training sample: texts and bytes of text for each language, and languages (the most frequent).
MAX_TEXTS = 1000
TEXT_BYTES = 16 << 20
MAX_LANGUAGES = 500
SEGMENT = 128
#: Segments that advance together: their gates fit the processor's cache.
COLUMNS = 2048
HIDDEN = 16
UNDETERMINED = "und"
_BLANK = 32


class Direction:
    """One gated recurrent layer; gates are rows (reset, update, candidate), segments are columns.

    The input weights and biases are a table by byte. The gates' logistic function is 0.5 + 0.5 tanh(x / 2).
    """

    def __init__(self, rng: np.random.Generator, hidden: int):
        self.h = hidden
        self.table = rng.normal(0, 0.3, (3 * hidden, 256)).astype(np.float32)
        self.recur = rng.normal(0, hidden**-0.5, (3 * hidden, hidden)).astype(np.float32)
        self.bias = np.zeros((hidden, 1), np.float32)

    def params(self) -> list[np.ndarray]:
        return [self.table, self.recur, self.bias]

    def states(self, x: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
        """States (steps, hidden, columns) of bytes x (steps, columns); with keep, what backward() needs."""
        h, (steps, n) = self.h, x.shape
        out = np.empty((steps, h, n), np.float32)
        state = np.zeros((h, n), np.float32)
        a, g, held = np.empty((3 * h, n), np.float32), np.empty((3 * h, n), np.float32), []
        for t in range(steps):
            np.take(self.table, x[t], axis=1, out=a, mode="clip")
            np.dot(self.recur, state, out=g)
            gates, cand = a[: 2 * h], g[2 * h :]
            gates += g[: 2 * h]
            gates *= 0.5
            np.tanh(gates, out=gates)
            gates *= 0.5
            gates += 0.5
            r, z, new = a[:h], a[h : 2 * h], a[2 * h :]
            cand += self.bias
            if keep:
                held.append((r.copy(), z.copy(), cand.copy(), state))
            cand *= r
            new += cand
            np.tanh(new, out=new)
            if keep:
                held[-1] += (new.copy(),)
            np.subtract(state, new, out=out[t])
            out[t] *= z
            out[t] += new
            state = out[t]
        return out, held

    def backward(self, x: np.ndarray, held: list, grads: np.ndarray) -> list[np.ndarray]:
        """Gradients of the parameters, from those of all states, by backpropagation through time."""
        h = self.h
        d_table, d_recur, d_bias = np.zeros_like(self.table), np.zeros_like(self.recur), np.zeros_like(self.bias)
        flow = np.zeros_like(grads[0])
        for t in range(len(x) - 1, -1, -1):
            r, z, cand, before, new = held[t]
            d = grads[t] + flow
            d_new = d * (1 - z) * (1 - new * new)
            d_z = d * (before - new) * z * (1 - z)
            d_r = d_new * cand * r * (1 - r)
            d_in = np.concatenate([d_r, d_z, d_new])
            d_rec = np.concatenate([d_r, d_z, d_new * r])
            d_recur += d_rec @ before.T
            d_bias += d_rec[2 * h :].sum(1, keepdims=True)
            flow = d * z + self.recur.T @ d_rec
            hot = np.zeros((256, x.shape[1]), np.float32)
            hot[x[t], np.arange(x.shape[1])] = 1
            d_table += d_in @ hot.T
        return [d_table, d_recur, d_bias]


class Network:
    def __init__(self, labels: list[str], hidden: int = HIDDEN, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.labels = labels
        self.forwards, self.backwards = Direction(rng, hidden), Direction(rng, hidden)
        self.out = [rng.normal(0, hidden**-0.5, (len(labels), hidden)).astype(np.float32) for _ in range(2)]
        self.offset = np.zeros((len(labels), 1), np.float32)

    def params(self) -> list[np.ndarray]:
        return [*self.forwards.params(), *self.backwards.params(), *self.out, self.offset]

    def positions(self, x: np.ndarray) -> np.ndarray:
        """Probabilities (steps, labels, columns) at every byte of x (steps, columns)."""
        f, _ = self.forwards.states(x)
        b, _ = self.backwards.states(x[::-1])
        logits = np.matmul(self.out[0], f) + np.matmul(self.out[1], b[::-1]) + self.offset
        return _softmax(logits)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross-entropy over all positions and its gradients; y: a label for each column."""
        f, held_f = self.forwards.states(x, keep=True)
        b, held_b = self.backwards.states(x[::-1], keep=True)
        back = b[::-1]
        p = _softmax(np.matmul(self.out[0], f) + np.matmul(self.out[1], back) + self.offset)
        columns = np.arange(x.shape[1])
        loss = -float(np.log(np.maximum(p[:, y, columns], 1e-12)).mean())
        d = p
        d[:, y, columns] -= 1
        d /= x.size
        d_out = [np.einsum("tcn,thn->ch", d, f, optimize=True), np.einsum("tcn,thn->ch", d, back, optimize=True)]
        g_f = self.forwards.backward(x, held_f, np.matmul(self.out[0].T, d))
        g_b = self.backwards.backward(x[::-1], held_b, np.matmul(self.out[1].T, d[::-1]))
        return loss, [*g_f, *g_b, *d_out, d.sum((0, 2))[:, None]]


def _softmax(x: np.ndarray) -> np.ndarray:
    x -= x.max(axis=1, keepdims=True)
    np.exp(x, out=x)
    x /= x.sum(axis=1, keepdims=True)
    return x


def train(texts: list[bytes], labels: list[str], steps: int = 450, columns: int = 192, length: int = 48, rate: float = 0.01, seed: int = 3) -> Network | None:
    """A network from labelled texts (UTF-8); None without any. Each language is drawn equally often."""
    names = sorted(set(labels))
    if not names:
        return None
    rng = np.random.default_rng(seed)
    net = Network(names, seed=seed)
    by = [[t for t, y in zip(texts, labels, strict=True) if y == name and t] or [b" "] for name in names]
    params = net.params()
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for t in range(1, steps + 1):
        y = rng.integers(0, len(names), columns)
        x = np.full((columns, length), _BLANK, np.uint8)
        for i, c in enumerate(y):
            text = by[c][rng.integers(len(by[c]))]
            s = int(rng.integers(max(1, len(text) - length + 1)))
            # A fifth are short, and so mostly blank, as short texts are.
            part = np.frombuffer(text[s : s + (length if rng.random() < 0.8 else int(rng.integers(3, length)))], np.uint8)
            x[i, : len(part)] = part
        _, grads = net.gradients(np.ascontiguousarray(x.T), y)
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        scale = min(1.0, 1.0 / max(norm, 1e-9))
        c = rate * (1 - 0.9 * t / steps) * np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
        for p, g, a, q in zip(params, grads, m, v, strict=True):
            a += 0.1 * (g * scale - a)
            q += 0.001 * ((g * scale) ** 2 - q)
            p -= c * a / (np.sqrt(q) + 1e-8)
    return net


def document_probabilities(net: Network, column: pa.Array) -> np.ndarray:
    """(rows, labels): the mean of every position's distribution; uniform for empty texts."""
    raw, bounds = shingles.text_bytes(column)
    n, k = len(bounds) - 1, len(net.labels)
    sizes = np.diff(bounds)
    parts = -(-sizes // SEGMENT)
    first = np.concatenate([[0], np.cumsum(parts)])
    sums = np.zeros((n, k))
    owner = np.repeat(np.arange(n), parts)
    for s in range(0, int(first[-1]), COLUMNS):
        e = min(s + COLUMNS, int(first[-1]))
        rows = owner[s:e]
        start = bounds[rows] + (np.arange(s, e) - first[rows]) * SEGMENT
        length = np.minimum(SEGMENT, bounds[rows + 1] - start)
        steps = np.arange(SEGMENT)[:, None]
        inside = steps < length
        x = np.where(inside, raw[np.minimum(start + steps, len(raw) - 1)], np.uint8(_BLANK))
        p = net.positions(x)
        p *= inside[:, None, :]
        np.add.at(sums, rows, p.sum(axis=0).T)
    return np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], 1 / k)


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", by: str = "doc_id") -> Network | None:
    """A network from a bounded sample of labelled's rows that have text and a language; None without any.

    A text of over a quarter of a megabyte is not in the sample.
    """
    rows = labelled.select(common.col(by).alias("id"), common.col(text).alias("text"), common.col(lang).cast("string").alias("lang")).filter("text is not null and lang is not null")
    counts = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGUAGES).collect()
    if not counts:
        return None
    rows = rows.filter(F.col("lang").isin([r["lang"] for r in counts]))
    got = common.hashed_sample(rows, ["id", "text"], MAX_TEXTS, F.octet_length("text"), TEXT_BYTES, per="lang")
    return train([t.encode("utf-8") for t in got.column("text").to_pylist()], got.column("lang").to_pylist())


def predict(docs: DataFrame, net: Network | None, text: str = "text", lang_pred: str = "lang_pred", score: str = "score", columns: list[str] | None = None) -> DataFrame:
    """docs, or these columns of it, with lang_pred and score, its mean probability over all bytes, as the last columns.

    ``und`` with score 0 where the text is null or has no letter, or nothing was learnt. Of equally likely languages the first
    by name counts. Repeated rows get equal results, an empty table none; columns named lang_pred or score, in any case, are
    replaced, all others stay as they are.
    """
    rows, mine, at = common.with_text(docs, text, columns, lang_pred, score)
    if net is None:
        return mine.withColumns({lang_pred: F.lit(UNDETERMINED), score: F.lit(0.0)})
    shared = docs.sparkSession.sparkContext.broadcast(net)
    names = mine.columns
    (flag,) = common.helpers(rows, "letters")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        labels = np.array(model.labels, dtype=object)
        for b in batches:
            p = document_probabilities(model, b.column(at))
            best = p.argmax(1) if b.num_rows else np.empty(0, np.int64)
            letters = b.column(b.num_columns - 1).to_numpy(zero_copy_only=False).astype(bool)
            pred = np.where(letters, labels[best], UNDETERMINED)
            likely = np.where(letters, np.clip(p[np.arange(len(best)), best], 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(pred, pa.string()), pa.array(likely, pa.float64())], [*names, lang_pred, score])

    lettered = rows.withColumn(flag, has_letter(common.col(rows.columns[at])))
    return lettered.mapInArrow(run, mine.schema.add(lang_pred, "string").add(score, "double"))


def has_letter(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(r"\p{L}")
