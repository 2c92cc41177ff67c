import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.llm import mixing

TARGETS = {"en": 0.4, "de": 0.3, "fr": 0.2, "es": 0.1}


@pytest.fixture(scope="module")
def labelled(docs):
    return docs.filter("doc_id < 60").select("doc_id", F.col("lang").alias("domain"))


def brute_rates(n, p, targets, steps=200):
    """The same minimum by plain projected gradient in the token metric, one document at a time in numpy."""
    goal, r = np.array(targets) / sum(targets) * n.sum(), np.ones(len(n))
    size = 1 / np.linalg.eigvalsh((p * n[:, None]).T @ p).max()
    for _ in range(steps * 50):
        r = np.maximum(0, r - size * p @ ((n * r) @ p - goal))
    return r, goal


def test_expected_tokens_meet_the_targets(spark, docs, labelled):
    got = mixing.mix(docs, labelled, TARGETS).toPandas()
    p = got[[f"p_{d}" for d in sorted(TARGETS)]].to_numpy()
    n = got.n_tokens.to_numpy().astype(float)
    r, goal = brute_rates(n, p, [TARGETS[d] for d in sorted(TARGETS)])
    mine = got.rate.to_numpy()
    assert (mine >= 0).all()
    reached, best = (n * mine) @ p, (n * r) @ p
    assert np.linalg.norm(reached - goal) <= np.linalg.norm(best - goal) + 1e-3 * n.sum()
    assert np.allclose(reached / n.sum(), goal / n.sum(), atol=1e-3)


def test_posteriors_equal_numpy(spark, docs, corpus, labelled):
    model = mixing.fit_domains(docs, labelled)
    got = {r["doc_id"]: r for r in mixing.posteriors(docs, model).collect()}
    bucket = {}
    words = {w for _, t, *_ in corpus for w in (t or "").lower().split()}
    for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", mixing._bucket(F.col("w")).alias("b")).collect():
        bucket[r["w"]] = r["b"]
    counts = {d: np.zeros(mixing.BUCKETS) for d in model.domains}
    label = {i: lang for i, _, lang, *_ in corpus if i is not None and i < 60}
    for i, t, *_ in corpus:
        for w in (t or "").lower().split() if i in label else []:
            counts[label[i]][bucket[w]] += 1
    logs = np.array([np.log((counts[d] + 1) / (counts[d].sum() + mixing.BUCKETS)) for d in model.domains])
    prior = np.array([np.log(sum(v == d for v in label.values()) / len(label)) for d in model.domains])
    for i, t, *_ in corpus:
        b = [bucket[w] for w in (t or "").lower().split()]
        x = prior + (logs[:, b].sum(1) / mixing.TEMPER if b else 0)
        x = np.exp(x - x.max())
        assert np.allclose([got[i][f"p{k}"] for k in range(len(model.domains))], x / x.sum(), atol=1e-6)
        assert got[i]["n_tokens"] == len(b)


def test_unreachable_targets_give_zero_rates(spark):
    docs = spark.createDataFrame([(i, "aa bb cc" if i < 5 else "xx yy zz") for i in range(10)], "doc_id long, text string")
    labelled = spark.createDataFrame([(0, "a"), (1, "a"), (5, "x"), (6, "x")], "doc_id long, domain string")
    got = mixing.mix(docs, labelled, {"a": 1.0})
    assert got.filter("doc_id < 5").agg(F.min("rate")).first()[0] > 1
    assert got.filter("doc_id >= 5").agg(F.max("rate")).first()[0] < 0.3
    applied = mixing.apply_rates(docs.withColumn("rate", F.lit("old")), got)
    assert applied.columns == ["doc_id", "text", "n_tokens", "rate"]


def test_odd_tables(spark, docs, corpus, empty, labelled):
    different = len({(i, t) for i, t, *_ in corpus})
    got = mixing.mix(docs.withColumns({"word": F.lit(1), "bucket": F.lit(2), "p0": F.lit(3), "copy": F.lit(4)}), labelled.unionAll(labelled.limit(3)), TARGETS)
    assert got.count() == different
    assert got.filter("rate is null or rate < 0").count() == 0
    assert mixing.apply_rates(docs, got).count() <= len(corpus)
    assert mixing.mix(empty, labelled.limit(0), TARGETS).count() == 0
    assert {r["rate"] for r in mixing.mix(docs, labelled.limit(0), TARGETS).collect()} == {1.0}
    with pytest.raises(ValueError, match="no labelled"):
        mixing.mix(docs, labelled, {"en": 1, "xx": 1})
    for bad in ({"en": -1.0, "de": 2.0}, {"en": 0.0}):
        with pytest.raises(ValueError, match="targets"):
            mixing.mix(docs, labelled, bad)


def test_no_python_on_the_main_path(spark, docs, labelled):
    plan = mixing.posteriors(docs, mixing.fit_domains(docs, labelled))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
