import os
import random

import duckdb
from pyspark.sql import functions as F

from lodestrata.llm import line_templates as lt
from lodestrata.llm import queries


def cleaned(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_recurring_templates_go_but_for_the_first(spark, docs, corpus):
    got = cleaned(lt.drop_recurring_lines(docs))
    texts = {i: t for i, t, *_ in corpus}
    boiler = [i for i in got if i is not None and 230 <= i < 240]
    assert got[230]["text"] == texts[230]
    for i in boiler[1:]:
        assert got[i]["n_dropped"] == 2
        assert got[i]["text"] == texts[i].split("\n")[0]
    # Copies of a whole document are none of this operator's business.
    assert all(got[i]["text"] == texts[i] for i in range(200, 205))
    clean = [i for i in range(120)]
    assert all(got[i]["text"] == texts[i] and got[i]["n_dropped"] == 0 for i in clean)


def test_variable_words_generalise(spark):
    names = ["anna", "berta", "carl", "dora", "emil", "fritz"]
    rows = [(i, f"{n} wrote this alone\nWelcome to the page of {n} and enjoy your stay") for i, n in enumerate(names)]
    rows += [(10 + i, f"Welcome to the {a} {b} {c} {d} {e} {f} {g}") for i, (a, b, c, d, e, f, g) in enumerate([("a", "b", "c", "d", "e", "f", "g"), ("h", "i", "j", "k", "l", "m", "n")])]
    got = cleaned(lt.drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string")))
    assert [got[i]["text"] for i in range(1, 6)] == [f"{n} wrote this alone" for n in names[1:]]
    assert got[0]["n_dropped"] == 0
    assert got[10]["n_dropped"] == got[11]["n_dropped"] == 0


def test_odd_rows(spark, docs, corpus, empty):
    got = lt.drop_recurring_lines(docs.withColumns({"line": F.lit(1), "leaf": F.lit(2), "n_lines": F.lit("old"), "copy": F.lit(0)}))
    assert got.count() == len(corpus)
    assert got.columns.count("n_lines") == 1
    rows = cleaned(got)
    assert (rows[300]["text"], rows[300]["n_lines"], rows[300]["n_dropped"]) == (None, 0, 0)
    assert rows[301]["text"] == ""
    assert lt.drop_recurring_lines(empty).count() == 0
    assert got.filter("doc_id = 306").count() == 2


def test_a_document_of_boilerplate_becomes_empty(spark):
    rows = [(i, "the same five words here" + ("" if i else "\nmore") + (f"\nown{'x' * i} words" if i % 2 else "")) for i in range(8)]
    got = cleaned(lt.drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string"), min_docs=3))
    assert got[2]["text"] == ""
    assert got[3]["text"] == "ownxxx words"


def test_equals_sql(spark, docs, tmp_path):
    path = f"{tmp_path}/documents.parquet"
    docs.filter("doc_id is not null").dropDuplicates(["doc_id"]).coalesce(1).write.parquet(path)
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    want = c.sql(f"SELECT doc_id, text, n_lines, n_dropped FROM ({queries.OP5_SQL}) ORDER BY 1").fetchall()
    got = queries.op5_line_templates(spark, os.path.dirname(path)).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == want


def test_long_lines_go_from_a_second_class(spark):
    shared = " ".join(f"word{'abcdefghij'[i % 10]}{'abcdefghij'[i // 10]}" for i in range(50))
    rows = [(i, f"text {'abcd'[i]} has a line of its own\n{shared}") for i in range(3)]
    rows += [(4, f"here one word fewer\n{shared[:-7]}"), (5, f"here too\n{shared[:-7]}"), (6, f"the number is another\n{shared} 1"), (7, f"than in this text\n{shared} 2"), (None, f"nameless\n{shared}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    # Texts 0 and 1 are said to be near copies.
    near = docs.filter("doc_id < 2").select(lt.common.text_key("text").alias("copy"), F.lit(0).cast("long").alias("class"))
    got = {r["doc_id"]: r["n_dropped"] for r in lt.drop_recurring_lines(docs, classes=near, long_words=50).collect()}
    assert got == {0: 0, 1: 0, 2: 1, 4: 0, 5: 0, 6: 0, 7: 0, None: 1}


def test_runs_between_dropped_lines(spark):
    rng = random.Random(9)
    rows = []
    for i in range(12):
        lines = [rng.choice(["", f"own {'abcdefghijkl'[i]} {'xyz'[j % 3]}{'uvw'[j % 2]} line", "the very same five words", "", "7"]) for j in range(rng.randint(1, 12))]
        rows.append((i, "\n".join(lines)))
    got = cleaned(lt.drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string")))
    first = min(i for i, t in rows if "the very same five words" in t.split("\n"))
    for i, t in rows:
        kept = [x for x in t.split("\n") if i == first or x != "the very same five words"]
        assert (got[i]["text"], got[i]["n_dropped"], got[i]["n_lines"]) == ("\n".join(kept), len(t.split("\n")) - len(kept), len(t.split("\n")))


def test_work_grows_with_the_lines_of_a_document(spark):
    import time

    def seconds(n):
        rows = [(i, "\n".join(f"line {'abcdefghij'[j % 10]}{'abcdefghij'[j // 10 % 10]}{'abcdefghij'[j // 100 % 10]} of the page" for j in range(n))) for i in range(2)]
        rows += [(10 + i, "\n".join(f"line {'abcdefghij'[j % 10]}{'abcdefghij'[j // 10 % 10]}{'abcdefghij'[j // 100 % 10]} of the page" for j in range(1000)) + f"\n{'x' * i}") for i in range(6)]
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2).cache()
        df.count()
        start = time.perf_counter()
        assert lt.drop_recurring_lines(df).agg(F.sum("n_dropped")).first()[0] == n + 6000
        return time.perf_counter() - start

    seconds(1000)
    assert seconds(64000) < 2 * seconds(32000) + 2


def test_near_copies(spark):
    rng = random.Random(2)
    rows, group = [], {}
    for g in range(30):
        base = rng.choices([f"w{i}" for i in range(500)], k=rng.choice([6, 40, 300, 3000]))
        for _ in range(rng.choice([1, 2, 8])):
            words = list(base)
            for _ in range(len(words) // 100):
                words[rng.randrange(len(words))] = f"x{len(rows)}"
            if words not in [t.split() for _, t in rows]:
                group[len(rows)] = g
                rows.append((len(rows), " ".join(words)))
    # A passage that makes up a third of each of these texts makes no copies of them.
    passage = " ".join(rng.choices([f"p{i}" for i in range(500)], k=60))
    for i in range(10):
        group[len(rows)] = 1000 + i
        rows.append((len(rows), passage + " " + " ".join(f"own{i}x{j}" for j in range(120))))
    odd = [(900, None), (901, ""), (902, " \n"), (903, rows[0][1])]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string").repartition(3)
    classes = {r["copy"]: r["class"] for r in lt.near_copies(docs).collect()}
    keys = {r["doc_id"]: r["k"] for r in docs.select("doc_id", lt.common.text_key("text").alias("k")).collect()}
    found = {i: classes.get(keys[i], keys[i]) for i in group}
    for i in group:
        for j in group:
            assert (found[i] == found[j]) == (group[i] == group[j])
    assert not {keys[i] for i in (900, 901, 902)} & set(classes)
    assert lt.near_copies(docs.limit(0)).count() == 0


def test_no_python_on_the_main_path(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    before = spark._jsparkSession.sharedState().statusStore().executionsCount()
    lt.drop_recurring_lines(docs, classes=lt.near_copies(docs), long_words=50).count()
    store = spark._jsparkSession.sharedState().statusStore()
    plans = [store.execution(i).get().physicalPlanDescription() for i in range(before, store.executionsCount()) if store.execution(i).isDefined()]
    assert len(plans) > 20
    assert not any("Python" in p or "Arrow" in p for p in plans)
