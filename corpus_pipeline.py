"""A corpus pipeline over ``documents``: language ID, line dedup, near duplicates, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``documents``. A stage's result is written as Parquet and read again as the next stage's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm import common, decontaminate, jaccard_join, language_id, line_templates, mixing, queries

#: Documents whose most likely language is less likely than this are rejected with the undetermined ones.
MIN_LANGUAGE_SCORE = 0.4
#: A line of so many words goes from a second text that has it; a shorter one when its template recurs.
LONG_LINE_WORDS = 50


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; those without a letter, or that resemble none of the learnt languages, go.

    Where no document names a language nothing can be learnt, and all documents with a letter stay.
    """
    held_out = F.coalesce(common.crc32_mod(F.col("doc_id"), 3) == 1, F.lit(True))
    model = language_id.fit(docs.filter(~held_out))
    if model is None:
        return docs.filter(language_id.has_letter(F.col("text")))
    lang, score = common.helpers(docs, "lang_pred", "score")
    predicted = language_id.predict(docs, model, lang_pred=lang, score=score)
    kept = (F.col(lang) != language_id.UNDETERMINED) & (F.col(score) >= MIN_LANGUAGE_SCORE)
    return predicted.filter(kept).select(*[common.col(c) for c in docs.columns])


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, less the lines whose template recurs in texts that are not near copies, and long lines that any other has; n_chars follows the text."""
    # Columns of docs with the operator's names are not its own.
    if clash := [c for c in docs.columns if c.lower() in ("n_lines", "n_dropped")]:
        names = dict(zip(clash, common.helpers(docs, *["own"] * len(clash)), strict=True))
        back = drop_boilerplate(spark, docs.withColumnsRenamed(names), sf_dir)
        return back.withColumnsRenamed({new: old for old, new in names.items()})
    classes = common.cut_alone(lambda: line_templates.near_copies(docs), "pipeline-classes")
    cleaned = line_templates.drop_recurring_lines(docs, classes=classes, long_words=LONG_LINE_WORDS)
    columns = {c: common.col(c) for c in docs.columns}
    columns["n_chars"] = F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return cleaned.select(*[columns[c].alias(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that Jaccard links connect, that with the smallest id.

    Where ids are null or repeat, each different text is judged by itself: one row of a group stays, one with an id if any has one.
    """
    if not jaccard_join.distinct_ids(docs):
        return _one_of_each_class(docs)
    (gone_id,) = common.helpers(docs, "gone")
    grouped = lambda: jaccard_join.jaccard_components(docs, k=5, percent=80)
    gone = common.cut_alone(lambda: grouped().filter("component_id <> doc_id").select(F.col("doc_id").alias(gone_id)), "pipeline-gone")
    return docs.join(gone.hint("merge"), F.col("doc_id") == F.col(gone_id), "left_anti")


def _one_of_each_class(docs: DataFrame) -> DataFrame:
    classes = common.cut_alone(lambda: jaccard_join.text_classes(docs, k=5, percent=80), "pipeline-classes")
    copy, other_id, other_copy = common.helpers(docs, "copy", "other_id", "other_copy")
    rows = docs.withColumn(copy, common.text_key("text"))
    # Texts without words link with nothing, not even their like.
    blank = ~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    named = rows.filter(~blank).select("doc_id", F.col(copy).alias("own"))
    worded = named.join(classes, F.col("own") == F.col("copy"), "left")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "own")).alias("first")
    winners = worded.groupBy(F.coalesce("class", "own").alias("class")).agg(first).select(F.col("first.doc_id").alias(other_id), F.col("first.own").alias(other_copy))
    winners = common.cut(winners, "pipeline-winners")
    kept = rows.filter(~blank).join(winners.hint("merge"), F.col("doc_id").eqNullSafe(F.col(other_id)) & (F.col(copy) == F.col(other_copy)), "left_semi")
    known = kept.dropDuplicates(["doc_id", copy]).unionAll(rows.filter(blank & F.col("doc_id").isNotNull()).dropDuplicates(["doc_id", copy]))
    return known.unionAll(rows.filter(blank & F.col("doc_id").isNull())).select(*[common.col(c) for c in docs.columns])


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.decontaminate(docs, common.table(spark, sf_dir, "benchmark"))


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the rate at which to take each, so that expected tokens meet the targets; those of rate 0 go."""
    rates = common.cut_alone(lambda: mixing.mix(docs, queries.domain_labels(spark, sf_dir), queries.MIX_TARGETS), "pipeline-rates")
    return mixing.apply_rates(docs, rates)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_boilerplate),
    ("jaccard_join", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_domains),
]

#: Learnt classifiers and fitted rates are beyond SQL; tests/llm holds the operators against brute force, and the stages against planted cases.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that all stages leave, with their rates; what a stage wrote on the way to its result is removed."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.cut_alone(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
