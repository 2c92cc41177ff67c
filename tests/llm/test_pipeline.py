import random

import pytest
from made_up import sentence
from pyspark.sql import functions as F

import corpus_pipeline
from lodestrata.llm import common, decontaminate


@pytest.fixture(scope="module")
def folder(spark, docs, corpus, tmp_path_factory):
    """A folder of tables with planted cases."""
    path = str(tmp_path_factory.mktemp("tables"))
    rng = random.Random(6)
    item = sentence(rng, "fr", 40)
    leak = (500, sentence(rng, "fr", 30) + " " + item + " " + sentence(rng, "fr", 30), "fr", "src0", 1)
    docs.unionAll(spark.createDataFrame([leak], docs.schema)).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    labels = [(i, int(i % 5 > 0), int(i % 9 == 0)) for i in range(100)] + [(101, None, None), (None, 1, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages_one_by_one(spark, folder, corpus):
    docs = common.table(spark, folder, "documents")
    columns, ids = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = common.cut(stage(spark, docs, folder), f"test-{name}")
        if name != "mixing":
            assert docs.columns == columns
        ids[name] = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in docs.select("doc_id").collect())
    flat = {k: {i for gone, i in v if not gone} for k, v in ids.items()}
    clean = set(range(120))
    assert clean <= flat["language_id"]
    assert not {300, 301, 302, 303} & flat["language_id"]
    assert flat["line_dedup"] == flat["language_id"]
    assert flat["jaccard_join"] & {*range(200, 205), *range(210, 216)} == {200}
    assert flat["jaccard_join"] >= clean
    assert sum(i == 306 for _, i in ids["jaccard_join"]) == 1
    assert flat["jaccard_join"] - flat["decontamination"] == {500}
    assert {"rate", "n_tokens"} <= set(docs.columns)
    assert docs.filter("rate <= 0").count() == 0


def test_run_and_empty_tables(spark, folder, tmp_path):
    assert corpus_pipeline.run(spark, folder).count() > 100
    for name in ("documents", "benchmark", "labels"):
        common.table(spark, folder, name).limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_decontamination_stage_equals_its_operator(spark, folder):
    docs, items = common.table(spark, folder, "documents"), common.table(spark, folder, "benchmark")
    hits = {r["doc_id"] for r in decontaminate.contained_items(docs, items).collect()}
    kept = {r["doc_id"] for r in corpus_pipeline.drop_contaminated(spark, docs, folder).collect()}
    assert hits == {500}
    assert kept == {r["doc_id"] for r in docs.collect()} - hits


def test_extra_columns_that_clash(spark, folder):
    docs = common.table(spark, folder, "documents").withColumns({"score": F.lit(1), "n_dropped": F.lit(2), "component_id": F.lit(3), "rate": F.lit(4)})
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        assert out.columns.count("doc_id") == 1
        assert out.count() > 0, name


def near_copies(rng, first, n, lines=12, words=25, footer=()):
    """n rows whose texts of several lines differ in one word in a hundred; every third has its change in one place, the others anywhere."""
    base = [sentence(rng, "en", words).split(" ") for _ in range(lines)]
    rows = []
    for i in range(n):
        text = [list(x) for x in base]
        for j in range(lines * words // 100):
            at = (2 + j, words // 2) if i % 3 == 0 else (rng.randrange(lines), rng.randrange(words))
            text[at[0]][at[1]] = f"edit{'abcdefghij'[i % 10]}{'abcdefghij'[i // 10]}{'xyz'[j % 3]}"
        rows.append((first + i, "\n".join([*(" ".join(x) for x in text), *footer]), "en", "src0", 1))
    return rows


def test_near_copies_of_several_lines_are_found_after_line_dedup(spark, docs):
    rng = random.Random(23)
    footer = ["All rights reserved by the owner of this page", "Read more about this and other things here today"]
    groups = [near_copies(rng, 1000, 5), near_copies(rng, 1100, 30), near_copies(rng, 1200, 8, footer=footer), near_copies(rng, 1300, 6, footer=footer)]
    other = [(1400 + i, "\n".join([sentence(rng, "en", 60), *footer]), "en", "src0", 1) for i in range(6)]
    exact = [(1500 + i, groups[2][0][1], "en", "src0", 1) for i in range(4)]
    table = spark.createDataFrame([*(r for g in groups for r in g), *other, *exact], docs.schema)
    cleaned = common.cut(corpus_pipeline.drop_boilerplate(spark, table, ""), "test-near-copies")
    texts = {r["doc_id"]: r["text"] for r in cleaned.collect()}
    assert all(texts[r[0]] == r[1] for g in groups[:2] for r in g)
    # The first class keeps the lines in all its documents, the others lose them in all.
    assert all(texts[r[0]] == r[1] for r in [*groups[2], *exact])
    assert all(texts[r[0]] == "\n".join(r[1].split("\n")[:-2]) for r in groups[3])
    assert all(texts[r[0]] == r[1].split("\n")[0] for r in other)
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, cleaned, "").collect()}
    assert kept == {1000, 1100, 1200, 1300, *range(1400, 1406)}


def test_ids_that_repeat_or_are_null(spark, docs):
    rng = random.Random(31)
    a, b, c, d = (sentence(rng, "en", 40) for _ in range(4))
    rows = [(1, a), (2, a), (2, b), (2, b), (3, c), (None, c), (None, d), (None, d), (4, ""), (4, ""), (5, None)]
    table = spark.createDataFrame([(i, t, "en", "src0", 1) for i, t in rows], docs.schema)
    kept = sorted((str(r["doc_id"]), r["text"]) for r in corpus_pipeline.drop_near_duplicates(spark, table, "").collect())
    assert kept == sorted((str(i), t) for i, t in [(1, a), (2, b), (3, c), (None, d), (4, ""), (5, None)])
