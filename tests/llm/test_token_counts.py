import shutil

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodestrata.llm import common, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")


def counts(df):
    return sorted((r["doc_id"] is not None, r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in df.collect())


def test_counts_equal_the_library(spark, docs, corpus):
    tok = Tokenizer.from_file(PATH)
    got = token_counts.count_tokens(docs, PATH, common.fresh_path(spark, "cache"))
    want = sorted((i is not None, i, len((t or "").encode()), len(tok.encode(t or "", add_special_tokens=False).ids)) for i, t, *_ in corpus)
    assert counts(got) == want


def test_special_strings_are_the_librarys_default(spark):
    text = "a <|endoftext|> b"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    n = Tokenizer.from_file(PATH).encode(text, add_special_tokens=False)
    assert token_counts.count_tokens(df, PATH, common.fresh_path(spark, "cache")).first()["n_tokens"] == len(n.ids)


def test_only_distinct_misses_are_encoded_and_appended(spark, docs, monkeypatch):
    path = common.fresh_path(spark, "cache")
    texts = [r[0] for r in docs.select(F.coalesce("text", F.lit(""))).distinct().collect()]
    first = counts(token_counts.count_tokens(docs.filter("doc_id < 60"), PATH, path))
    stored = token_counts.cached(spark, path).count()
    assert stored == len({t for t in texts if t in {r[0] for r in docs.filter("doc_id < 60").select("text").collect()}})
    token_counts.count_tokens(docs, PATH, path).count()
    assert token_counts.cached(spark, path).count() == len(texts)
    # A stored count is taken, not made again.
    before = token_counts.cached(spark, path).count()
    assert counts(token_counts.count_tokens(docs.filter("doc_id < 60"), PATH, path)) == first
    assert token_counts.cached(spark, path).count() == before


def test_another_tokenizer_misses(spark, docs):
    path, model = common.fresh_path(spark, "cache"), public_tokenizers.path("piece_bpe_32k.model")
    few = docs.filter("doc_id < 10")
    token_counts.count_tokens(few, PATH, path).count()
    other = token_counts.count_tokens(few, model, path)
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    assert all(r["n_tokens"] == len(sp.encode(r["text"])) for r in other.collect())
    assert token_counts.cached(spark, path).select("tokenizer_digest").distinct().count() == 2


def test_empty_tables_and_clashing_columns(spark, docs, empty):
    path = common.fresh_path(spark, "cache")
    assert token_counts.count_tokens(empty, PATH, path).count() == 0
    odd = docs.limit(5).withColumns({"N_TOKENS": F.lit(-1), "content": F.lit("x"), "content_digest": F.lit("y"), "__digest": F.lit(1), "stored": F.lit(2), "Digest": F.lit(3)})
    got = token_counts.count_tokens(odd, PATH, path)
    assert got.columns == [*docs.columns, "content", "content_digest", "__digest", "stored", "Digest", "n_bytes", "n_tokens"]
    assert {(r["__digest"], r["stored"], r["Digest"]) for r in got.collect()} == {(1, 2, 3)}
    assert got.columns.count("n_tokens") == 1
    assert got.filter("n_tokens < 0").count() == 0
    with pytest.raises(ValueError, match="no library"):
        token_counts.load_encoder("x.bin")


def test_a_call_reads_its_own_tokenizer_and_digests(spark, docs):
    path = common.fresh_path(spark, "cache")
    token_counts.count_tokens(docs, PATH, path).count()
    before = spark._jsparkSession.sharedState().statusStore().executionsCount()
    few = docs.filter("doc_id < 3")
    assert counts(token_counts.count_tokens(few, PATH, path)) == [x for x in counts(token_counts.count_tokens(docs, PATH, path)) if x[0] and x[1] < 3]
    store = spark._jsparkSession.sharedState().statusStore()
    plans = [store.execution(i).get().physicalPlanDescription() for i in range(before, store.executionsCount()) if store.execution(i).isDefined()]
    grouped = [p for p in plans if "token-counts" in p and "InsertIntoHadoopFsRelationCommand" in p]
    assert grouped
    assert all("LeftSemi" in p and "PartitionFilters: [isnotnull(tokenizer_digest" in p for p in grouped)


def test_another_file_on_a_worker_raises(spark, docs, tmp_path):
    own = f"{tmp_path}/own.json"
    shutil.copy(PATH, own)
    contents = docs.limit(1).select(F.lit(b"x").alias("content_digest"), F.lit("text").alias("content"))
    with pytest.raises(Exception, match="is not the driver's"):
        contents.mapInArrow(token_counts._encode(own, "another digest"), "content_digest binary, n_tokens long").collect()
