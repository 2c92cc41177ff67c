import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestrata.llm import common, queries, toxicity

from made_up import sentence


def auc(score, y):
    order = np.argsort(np.argsort(score))
    n1 = y.sum()
    return (order[y == 1].sum() - n1 * (n1 - 1) / 2) / (n1 * (len(y) - n1))


@pytest.fixture(scope="module")
def labelled():
    rng = random.Random(2)
    out = []
    for i in range(1600):
        toxic = i % 8 == 0
        words = sentence(rng, "en", rng.randint(20, 80)).split()
        for _ in range(rng.randint(1, 3) if toxic else 0):
            words[rng.randrange(len(words))] = rng.choice(["vileword", "grossword", "nastyx", "nastyy"])
        out.append((i, " ".join(words), int(toxic)))
    return out


def table(spark, rows):
    return spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")


def ids(spark, rows):
    return spark.createDataFrame([(i,) for i, _, y in rows if y] + [(None,)], "doc_id long")


@pytest.fixture(scope="module")
def model(spark, labelled):
    return toxicity.fit(table(spark, labelled[:1200]), ids(spark, labelled[:1200]), 0.125)


def test_held_out_accuracy(spark, labelled, model):
    got = {r["doc_id"]: r["score"] for r in toxicity.score(table(spark, labelled[1200:]).withColumn("score", F.lit("old")), model).collect()}
    score, y = np.array([got[i] for i, *_ in labelled[1200:]]), np.array([y for *_, y in labelled[1200:]])
    assert auc(score, y) > 0.99
    assert ((score >= 0.3) == (y == 1)).mean() > 0.97
    assert (model.weights > 0).all()


def plain_risk(prior, positive, unlabelled, w, b):
    """The negatives' risk and the objective that a step descends, text by text."""
    z = lambda x: sum(w[i] for i in x) + b
    taken = lambda rows: sum(math.log1p(math.exp(z(x))) for x in rows) / len(rows)
    negative = taken(unlabelled) - prior * taken(positive)
    own = prior * sum(math.log1p(math.exp(-z(x))) for x in positive) / len(positive)
    return negative, own + negative if negative >= 0 else -negative


def as_rows(rows):
    return np.array([i for x in rows for i in x], np.int64), np.concatenate([[0], np.cumsum([len(x) for x in rows])]).astype(np.int64)


@pytest.mark.parametrize("prior", [0.1, 0.9])
def test_risk_and_gradient_equal_brute_force(prior):
    rng = random.Random(4)
    positive = [sorted(rng.sample(range(6), rng.randint(1, 4))) for _ in range(20)]
    unlabelled = [sorted(rng.sample(range(6), rng.randint(0, 3))) for _ in range(50)]
    w, b = np.array([rng.uniform(0, 2) for _ in range(6)]), 0.3
    found, at = as_rows(unlabelled)
    sums = toxicity.negative_sums(w, b, found, at, np.ones(50, np.int64))
    risk, g = toxicity.risk_gradient(prior, as_rows(positive), sums, 50, w, b)
    want, here = plain_risk(prior, positive, unlabelled, w, b)
    assert risk == pytest.approx(want, abs=1e-6)
    # Both branches of the estimator are met.
    assert (want < 0) == (prior == 0.9)
    for i in range(7):
        step = np.zeros(7)
        step[i] = 1e-5
        up, down = (plain_risk(prior, positive, unlabelled, w + sign * step[1:], b + sign * step[0])[1] for sign in (1, -1))
        assert g[i] == pytest.approx((up - down) / 2e-5, abs=1e-4)


def test_query_equals_brute_force(spark, labelled, tmp_path):
    """The whole query against the same learning with one text after another."""
    rows = labelled[:600]
    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r["doc_id"]: r for r in queries.op2_pu_toxicity(spark, str(tmp_path)).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 4 == 2 for i, *_ in rows}
    learnt = [(t, y) for i, t, y in rows if not held[i]]

    def buckets(text):
        words = [w for w in re.split(r"[^0-9a-z]+", text.lower()) if w]
        raw, bounds = toxicity.shingles.text_bytes(pa.array([" ".join(words)]))
        whole, _, heads = toxicity.shingles.word_prefix_hashes(raw, bounds, toxicity.shingles.BY_PUNCTUATION, toxicity.PREFIXES)
        return {int(h) >> (64 - toxicity.TABLE_BITS) for x in (whole, *heads) for h in x}

    positive, every = [buckets(t) for t, y in learnt if y], [buckets(t) for t, _ in learnt]
    clear = []
    for x in sorted(set().union(*positive)):
        n, rate = sum(x in p for p in positive), sum(x in e for e in every) / len(every)
        if n >= max(toxicity.LEAST_POSITIVES, toxicity.LEAST_SHARE * len(positive)):
            clear.append((-(n / len(positive) - rate) / math.sqrt(max(rate * (1 - rate), 1 / len(every)) / len(positive)), x))
    names = [x for c, x in sorted(clear) if -c >= toxicity.SIGNIFICANT][: toxicity.MAX_FEATURES]
    numbers = {x: i for i, x in enumerate(names)}
    sets = lambda rows: [sorted(numbers[x] for x in r if x in numbers) for r in rows]
    found, at = as_rows(sets(every))
    prior = len(positive) / len(every)
    w, b = toxicity.descend(prior, as_rows(sets(positive)), lambda w, b: toxicity.negative_sums(w, b, found, at, np.ones(len(every), np.int64)), len(every), len(names))
    for i, t, _ in rows:
        z = sum(w[numbers[x]] for x in buckets(t) if x in numbers) + b
        assert got[i]["score"] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-9)
        assert (got[i]["held_out"], got[i]["predicted"]) == (held[i], int(got[i]["score"] >= 0.3))


def test_order_and_partitions_change_nothing(spark, labelled):
    again = [(i + 5000, t, y) for i, t, y in labelled[:1200:3]]
    rows = labelled[:1200] + again
    models = []
    for n in (1, 7):
        random.Random(n).shuffle(rows)
        models.append(toxicity.fit(table(spark, rows).repartition(n), ids(spark, rows).repartition(n), 0.125))
    assert models[0].bias == models[1].bias
    assert (models[0].weights == models[1].weights).all()
    assert (models[0].numbers == models[1].numbers).all()


def test_odd_rows(spark, docs, corpus, empty, model):
    got = toxicity.score(docs.withColumns({"labels": F.lit(1), "content": F.lit(2), "Score": F.lit(3), "whole": F.lit(4)}), model)
    assert got.count() == len(corpus)
    assert got.columns == [*docs.columns, "labels", "content", "whole", "score"]
    assert got.filter("score < 0 or score > 1 or score is null").count() == 0
    assert {r["doc_id"] for r in got.filter("text is null").collect()} == {300}
    assert toxicity.score(empty, model).count() == 0
    # Nothing to learn from: the prior is the score.
    assert toxicity.fit(empty, empty, 0.2).scores(pa.array(["x"]))[0] == pytest.approx(0.2)
    assert toxicity.fit(docs, empty, 0.2).scores(pa.array(["x"]))[0] == pytest.approx(0.2)


def test_a_long_text_is_read_whole(model):
    calm = " ".join(f"other{i}" for i in range(50000))
    low, high = model.scores(pa.array([calm, calm + " vileword"]))
    assert high > low


def test_split_is_by_crc(spark):
    rows = spark.range(50).select("id", common.crc32_mod(F.col("id"), 4).alias("m")).collect()
    assert all(r["m"] == zlib.crc32(str(r["id"]).encode()) % 4 for r in rows)
