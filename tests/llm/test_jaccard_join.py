import random
import re

import pytest
from pyspark.sql import functions as F

from lodestrata.llm import jaccard_join as jj
from lodestrata.llm import shingles
from lodestrata.llm.components import connected_components

FOLD = {c: c + 32 for c in range(65, 91)}


def word_set(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute(rows, k, percent):
    """{doc_id: (n, component)} by holding every pair of rows against each other."""
    sets = [(i, word_set(t, k)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            n = len(x & y)
            if n and 100 * n >= percent * (len(x) + len(y) - n):
                p, q = find(i), find(j)
                parent[max(p, q)] = min(p, q)
    return {i: (len(x), find(i)) for i, x in sets}


def check(spark, rows, k, percent):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jj.jaccard_components(df, k, percent).collect() if r["doc_id"] is not None}
    assert got == brute(rows, k, percent)
    return got


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (5, 80), (1, 50), (2, 100)])
def test_equals_brute_force(spark, k, percent):
    rng = random.Random(k * percent)
    rows = []
    for group in range(12):
        base = rng.choices([f"v{x}" for x in range(400)], k=rng.choice([3, 6, 20, 80, 250]))
        for _ in range(rng.randint(1, 12)):
            words = list(base)
            for _ in range(rng.randint(0, max(1, len(words) // 8))):
                words[rng.randrange(len(words))] = f"v{rng.randrange(400)}"
            if rng.random() < 0.3:
                words = words[: rng.randint(len(words) * 3 // 4, len(words))]
            rows.append((len(rows) * 3 % 997, " ".join(words)))
    links = {}
    for c in check(spark, rows, k, percent).values():
        links[c[1]] = links.get(c[1], 0) + 1
    assert max(links.values()) > 2


def test_common_passage_and_chain(spark):
    rng = random.Random(5)
    common = " ".join(f"c{i}" for i in range(60))
    rows = [(i, common + " " + " ".join(f"own{i}x{j}" for j in range(rng.randint(5, 200)))) for i in range(60)]
    # Neighbours link, ends don't: the component must still be one.
    chain = [f"t{i}" for i in range(400)]
    rows += [(100 + i, " ".join(chain[6 * i : 6 * i + 100])) for i in range(40)]
    got = check(spark, rows, 4, 85)
    assert {got[100 + i][1] for i in range(40)} == {100}


def test_hot_buckets_are_split_without_loss(spark, monkeypatch):
    """A third of the texts share most of one passage but link only in small groups: buckets with many documents beside the head's."""
    rng = random.Random(12)
    shared = [f"c{i}" for i in range(60)]
    rows = []
    for i in range(40):
        own = [f"own{i}x{j}" for j in range(rng.randint(12, 30))]
        for j in range(rng.randint(1, 3)):
            words = [*shared, *own]
            words[j] = f"edit{i}{j}"
            rows.append((len(rows), " ".join(words)))
    rows += [(1000 + i, " ".join(f"z{rng.randrange(10**6)}" for _ in range(50))) for i in range(80)]
    plain = check(spark, rows, 4, 70)
    monkeypatch.setattr(jj, "SPLIT", 2)
    assert check(spark, rows, 4, 70) == plain
    assert len({c for _, c in plain.values()}) < len(rows)


def test_ids_of_text(spark, corpus):
    rows = [(i, t) for i, t, *_ in corpus if i is not None]
    df = spark.createDataFrame([(f"id{i:05d}", t) for i, t in rows] + [(None, "no id here")], "name string, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jj.jaccard_components(df, 4, 85, doc_id="name").collect()}
    want = {f"id{i:05d}": (n, f"id{c:05d}") for i, (n, c) in brute(rows, 4, 85).items()}
    assert got == want | {None: (1, None)}


def test_the_sketch_grows_with_the_corpus():
    assert jj.sketch_bits(0) == jj.MIN_SKETCH_BITS
    assert jj.sketch_bits(jj.BYTES_A_COUNTER << 22) == 23
    assert jj.sketch_bits(1 << 50) == jj.MAX_SKETCH_BITS


def test_odd_rows(spark, docs, corpus, empty):
    got = jj.jaccard_components(docs.withColumns({"n": F.lit(1), "token": F.lit("x"), "digest": F.lit("y")}), 4, 85)
    rows = {r["doc_id"]: r for r in got.collect()}
    assert got.count() == len(corpus)
    want = brute([(i, t) for i, t, *_ in corpus], 4, 85)
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in rows.items() if i is not None} == want
    assert all((rows[i]["n_shingles"], rows[i]["component_id"]) == (0, i) for i in (300, 301, 302))
    assert rows[None]["component_id"] is None
    assert {rows[i]["component_id"] for i in (*range(200, 205), *range(210, 216))} == {200}
    assert jj.jaccard_components(empty).count() == 0
    with pytest.raises(ValueError, match="percent"):
        jj.jaccard_components(docs, percent=0)


def test_words_of_bytes():
    import pyarrow as pa

    texts = ["Ab  cD\té\x0bÉ\u00a0x", None, "", " ", "one", "A a B b", "\u2003em"]
    raw, bounds = shingles.text_bytes(pa.array(texts))
    hashes, at = shingles.word_hashes(raw, bounds, shingles.BY_SPACE)
    found = re.findall
    want = [found(r"[^\x20\x09-\x0D]+", (t or "").translate(FOLD)) for t in texts]
    assert [int(b - a) for a, b in zip(at, at[1:], strict=False)] == [len(w) for w in want]
    flat = [w for ws in want for w in ws]
    assert len(set(hashes.tolist())) == len(set(flat))


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1200)] + [(5000, 2000 + i) for i in range(100)] + [(7, 7), (None, 1)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            p, q = find(a), find(b)
            parent[max(p, q)] = min(p, q)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
