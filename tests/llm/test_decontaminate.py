import random
import re

import pytest

from lodestrata.llm import decontaminate as dec

ITEMS = "item_id long, text string"


def brute(docs, items, k=5, percent=80):
    def sets(text):
        w = [x for x in re.split(r"[\x00-/:-`{-\x7f]+", (text or "").lower()) if x]
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({("short", *w)} if w else set())

    asked = [(i, sets(t)) for i, t in items]
    out = []
    for d, t in docs:
        have = sets(t)
        for i, want in asked:
            n = len(want & have)
            if want and 100 * n >= percent * len(want):
                out.append((d is not None, d, i, n, len(want)))
    return sorted(out)


def result(df):
    return sorted((r["doc_id"] is not None, r["doc_id"], r["item_id"], r["shared"], r["n_item"]) for r in df.collect())


@pytest.fixture(scope="module")
def case():
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(3000)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 3, 5, 6, 8, 12, 20, 45, 120, 400])))) for i in range(60)]
    docs = []
    for d in range(250):
        words = rng.choices(vocabulary, k=rng.choice([2, 30, 300, 3000]))
        if d % 2:
            item = items[d % 60][1].split()
            # Now and then changed words, which leaves some above the threshold and some below.
            item = [w if rng.random() > (d % 10) / 60 else "other" for w in item]
            at = rng.randrange(len(words))
            words[at:at] = item
        docs.append((d, ". ".join([" ".join(words[:7]).title(), " ".join(words[7:])])))
    docs += [(900 + i, items[i][1].upper()) for i in range(10)] + [(950, None), (951, ""), (None, items[40][1]), (952, items[41][1]), (952, items[41][1])]
    return docs, [*items, (100, None), (101, "?!"), (None, "nameless item text of six words"), (102, items[41][1])]


def test_equals_brute_force(spark, case):
    docs, items = case
    d, i = spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(items, ITEMS)
    want = brute(docs, [x for x in items if x[0] is not None])
    assert len(want) > 60
    assert result(dec.contained_items(d, i)) == want


def test_blocks_of_items_change_nothing(spark, case, monkeypatch):
    docs, items = case
    monkeypatch.setattr(dec, "ITEMS_AT_ONCE", 25)
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, ITEMS)
    assert result(dec.contained_items(d, i)) == brute(docs, [x for x in items if x[0] is not None])


def test_filter_keeps_the_rest(spark, docs, corpus, empty):
    hidden = next(t for i, t, *_ in corpus if i == 40)
    items = spark.createDataFrame([(1, hidden)], ITEMS)
    kept = dec.decontaminate(docs, items)
    assert kept.columns == docs.columns
    gone = {i for i, *_ in corpus} - {r["doc_id"] for r in kept.collect()}
    assert gone == {40}
    assert kept.filter("doc_id is null").count() == 1
    nameless = spark.createDataFrame([(1, "no id here at all")], ITEMS)
    assert dec.decontaminate(docs, nameless).filter("doc_id is null").count() == 0
    assert dec.decontaminate(empty, items).count() == 0
    assert dec.decontaminate(docs, items.limit(0)).count() == len(corpus)


def test_window_minima():
    import numpy as np

    x = np.random.default_rng(1).integers(0, 1000, 37).astype(np.uint32)
    for width in (1, 2, 3, 5, 8, 13, 40, 64):
        got = dec._window_minima({1: x}, width)
        assert [int(v) for v in got] == [int(x[i : i + width].min()) for i in range(len(x))]


def test_an_item_without_an_id_counts(spark):
    docs = spark.createDataFrame([(1, "before it a nameless item text of seven words after it"), (2, "quite another text of some words")], "doc_id long, text string")
    items = spark.createDataFrame([(None, "a nameless item text of seven words")], ITEMS)
    assert [r["doc_id"] for r in dec.decontaminate(docs, items).collect()] == [2]
    assert dec.contained_items(docs, items).count() == 0


def test_ids_of_text_and_clashing_columns(spark, case):
    docs, items = case
    d = spark.createDataFrame([(None if i is None else f"d{i}", t) for i, t in docs], "name string, text string").withColumnsRenamed({"text": "doc_id"})
    i = spark.createDataFrame([(None if i is None else f"i{i}", t) for i, t in items], "item_id string, text string")
    got = sorted((r["doc_id"] or "", r["item_id"], r["shared"]) for r in dec.contained_items(d, i, doc_id="name", text="doc_id").collect())
    assert got == sorted((f"d{d}" if d is not None else "", f"i{i}", n) for _, d, i, n, _ in brute(docs, [x for x in items if x[0] is not None]))


def test_all_items_are_searched_in_one_pass(spark, case):
    docs, items = case
    df = spark.createDataFrame(docs, "doc_id long, text string")
    plan = dec.contained_items(df, spark.createDataFrame(items * 40, ITEMS))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
