import os
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.llm import ann


def table(spark, matrix, ids=None):
    rows = [(int(i), [float(x) for x in v]) for i, v in zip(ids if ids is not None else range(len(matrix)), matrix, strict=True)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)


def exact(matrix, i, k):
    s = matrix @ matrix[i]
    s[i] = -np.inf
    return np.lexsort((np.arange(len(matrix)), -s))[: min(k, len(matrix) - 1)], s


def test_recall_and_scores(spark):
    m = np.random.default_rng(1).normal(size=(3000, 32)).astype(np.float32).astype(np.float64)
    m *= np.random.default_rng(2).uniform(0.5, 2, (3000, 1)).astype(np.float32)
    m = m.astype(np.float32).astype(np.float64)
    df = table(spark, m)
    got = ann.search(df, df.filter("vec_id % 20 = 0"), k=10, rerank=60).toPandas()
    found = 0
    for i in range(0, 3000, 20):
        want, s = exact(m, i, 10)
        mine = got[got.query_id == i].sort_values("rank")
        assert mine["rank"].tolist() == list(range(1, 11))
        assert np.allclose(mine.score, s[mine.vec_id], rtol=0, atol=1e-9)
        assert (np.diff(mine.score) <= 0).all()
        found += len(set(want) & set(mine.vec_id))
    assert found / 1500 >= 0.9


def test_blocks_of_queries_agree(spark):
    m = np.random.default_rng(3).normal(size=(300, 7))
    df = table(spark, m)
    queries = df.filter("vec_id % 10 = 0")
    one = sorted(map(tuple, ann.search(df, queries, k=5).collect()))
    # Blocks of four queries and segments of thirty vectors, in another order and other partitions; repeated queries count once.
    again = df.orderBy(F.desc("vec_id")).repartition(7)
    assert sorted(map(tuple, ann.search(again, queries.unionAll(queries), k=5, query_bytes=4 * 56, segment_bytes=30 * 56).collect())) == one
    assert len(one) == 150


def test_every_length_is_searched(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=[3, 5, 8][i % 3])]) for i in range(90)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.search(df, df.filter("vec_id < 6"), k=4, rerank=20).collect()
    for q in range(6):
        v = np.array(rows[q][1])
        want = sorted((-float(np.array(w) @ v), i) for i, w in rows if len(w) == len(v) and i != q)[:4]
        mine = sorted((r["rank"], r["vec_id"]) for r in got if r["query_id"] == q)
        assert [i for _, i in mine] == [i for _, i in want]


def test_memory_with_long_vectors():
    """768 dimensions: a task's own memory stays below 300 MB, measured in a process that does one task's work."""
    code = """
import resource
import numpy as np
from lodestrata.llm import ann
rng = np.random.default_rng(1)
x = rng.normal(size=(ann.SEGMENT_BYTES // 6144, 768))
q = ann.Quantiser.fit(x[:200], rounds=1)
codes = q.pack(q.codes(x)).T.copy()
queries = rng.normal(size=(ann.QUERY_BYTES // 6144, 768))
for _ in ann._nearest(q, np.arange(len(queries)) + 10**6, queries, np.arange(len(x)), x, codes, 20, 200):
    pass
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, env={**os.environ, "OMP_NUM_THREADS": "1"})
    assert int(out.stdout) < 300


def test_ties_go_to_smaller_ids(spark):
    m = np.tile([1.0, 2.0, 0.5, 0.0], (400, 1))
    m[0] = [3.0, 1.0, 0.0, 0.0]
    got = ann.search(table(spark, m), table(spark, m[:1]), k=20, rerank=40).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == list(range(1, 21))


def test_odd_vectors_take_no_part(spark):
    good = [(i, [float(i), 1.0]) for i in range(1, 6)]
    odd = [(10, None), (11, [0.0, 0.0]), (12, [None, 1.0]), (13, [float("nan"), 1.0]), (14, [float("inf"), 1.0]), (15, [1.0]), (16, []), (None, [1.0, 1.0])]
    df = spark.createDataFrame(good + odd, "vec_id long, embedding array<float>").withColumns({"codes": F.lit(1), "score": F.lit(2)})
    got = ann.search(df, df, k=20).collect()
    assert {r["query_id"] for r in got} == {1, 2, 3, 4, 5}
    # Fewer candidates than k: all of them.
    assert all(sorted(r["vec_id"] for r in got if r["query_id"] == q) == [x for x in range(1, 6) if x != q] for q in range(1, 6))
    assert ann.search(df.limit(0), df, k=3).count() == 0
    assert ann.search(df, df.limit(0), k=3).count() == 0


def test_the_parallel_residual_weighs_more():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(2000, 16))
    plain, aware = ann.Quantiser.fit(x, threshold=0.0), ann.Quantiser.fit(x, threshold=0.5)
    assert (plain.eta, aware.eta) == (1.0, pytest.approx(15 * 0.25 / 0.75))

    def parallel(q):
        parts = q._split(x)
        r = q._parallel(parts, q.codes(x)).sum(1)
        return float((r**2 / (x**2).sum(1)).mean())

    assert parallel(aware) < 0.7 * parallel(plain)


def test_tables_sum_the_codewords():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(50, 6))
    q = ann.Quantiser.fit(x)
    codes = q.codes(x)
    packed = q.pack(codes)
    t = q.tables(x[0])
    want = sum(q.books[j][codes[:, j]] @ q._split(x[:1])[0, j] for j in range(codes.shape[1]))
    assert np.allclose(sum(t[p][packed[:, p]] for p in range(packed.shape[1])), want, atol=1e-5)
