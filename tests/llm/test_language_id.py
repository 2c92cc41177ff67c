import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestrata.llm import language_id as lid

from made_up import SYLLABLES, sentence


@pytest.fixture(scope="module")
def net():
    rng = random.Random(1)
    texts = [(sentence(rng, lang, 40).encode(), lang) for lang in SYLLABLES for _ in range(100)]
    return lid.train([t for t, _ in texts], [y for _, y in texts], steps=120, columns=96)


def test_gradients_equal_differences():
    net = lid.Network(["a", "b"], hidden=3, seed=1)
    rng = np.random.default_rng(0)
    x, y = rng.integers(97, 103, (5, 4)).astype(np.uint8), np.array([0, 1, 1, 0])
    for p in net.params():
        p[...] = rng.normal(0, 0.5, p.shape)
    _, grads = net.gradients(x, y)
    for p, g in zip(net.params(), grads, strict=True):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old, step = p[at], 1e-2
        p[at] = old + step
        up, _ = net.gradients(x, y)
        p[at] = old - step
        down, _ = net.gradients(x, y)
        p[at] = old
        assert (up - down) / (2 * step) == pytest.approx(g[at], rel=0.05, abs=2e-4)


def test_held_out_accuracy(net):
    rng = random.Random(99)
    rows = [(sentence(rng, lang, 25), lang) for lang in SYLLABLES for _ in range(50)]
    p = lid.document_probabilities(net, pa.array([t for t, _ in rows]))
    assert np.mean([net.labels[k] == y for k, (_, y) in zip(p.argmax(1), rows, strict=True)]) > 0.97


def test_every_byte_counts_once(net):
    texts = ["", "short", "x" * 128, "yz" * 200, "é" * 500]
    raw_mean = []
    for t in texts:
        data = t.encode()
        total = np.zeros(len(net.labels))
        for s in range(0, len(data), lid.SEGMENT):
            part = np.frombuffer(data[s : s + lid.SEGMENT].ljust(lid.SEGMENT), np.uint8)[:, None]
            total += net.positions(part)[: len(data[s : s + lid.SEGMENT])].sum(0)[:, 0]
        raw_mean.append(total / len(data) if data else np.full(len(net.labels), 1 / len(net.labels)))
    assert np.allclose(lid.document_probabilities(net, pa.array(texts)), raw_mean, atol=1e-4)


def test_odd_rows(spark, docs, corpus, empty, net):
    got = lid.predict(docs.withColumns({"lang_pred": F.lit("old"), "whole": F.lit("q"), "Letters": F.lit(1), "SCORE": F.lit(2)}), net)
    assert got.columns == [*docs.columns, "whole", "Letters", "lang_pred", "score"]
    assert {(r["whole"], r["Letters"]) for r in got.collect()} == {("q", 1)}
    assert lid.predict(docs, net, columns=["doc_id"]).columns == ["doc_id", "lang_pred", "score"]
    rows = {r["doc_id"]: r for r in got.collect()}
    assert got.count() == len(corpus)
    assert all(rows[i]["lang_pred"] == "und" and rows[i]["score"] == 0 for i in (300, 301, 302, 303))
    assert rows[305]["lang_pred"] == "en"
    assert lid.predict(empty, net).count() == 0
    assert lid.fit(empty) is None
    assert {r["lang_pred"] for r in lid.predict(docs, None).collect()} == {"und"}
    assert lid.fit(docs.filter("lang is null")) is None


def test_order_and_partitions_change_nothing(spark, corpus, docs):
    nets = []
    for n in (1, 7):
        rows = [r for r in corpus if r[0] is not None and r[0] < 60]
        random.Random(n).shuffle(rows)
        nets.append(lid.fit(spark.createDataFrame(rows, docs.schema).repartition(n)))
    assert all((a == b).all() for a, b in zip(nets[0].params(), nets[1].params(), strict=True))
