"""Line dedup by a log-template tree, in DataFrame expressions only.

A line's tokens are what single spaces part; a token with a digit is a variable field, ``<*>``. The tree has a
fixed depth: a line goes to the leaf of its token count and first DEPTH tokens. In a leaf, a later position's token is
constant if lines with it have a support of ``min_docs`` at least, and else generalises to ``<*>``. What
is left is the line's template. A template that generalises at most a fifth of its positions, has a
constant token, and whose lines have a support of min_docs together recurs across documents; its lines
are dropped from every document but the first that has one.

The support of a line is the number of distinct texts that hold it: copies of a whole document count
once, so that they are left to near-duplicate removal. Given the classes of texts that are near copies of each
other (near_copies), a class counts once wherever support is counted, over the different lines of a leaf,
field or template too, and the first class that has a template keeps its lines in all its documents: near copies
all lose a line or all keep it.

Text moves once, with the lists of lines to drop. All else that is shuffled are hashes, folded
before they move: a line that a third of all documents hold is one row a task. Joins on a line that many documents share move
single rows: beyond the sizes that are broadcast, adaptive execution (Spark's default) splits them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.llm import common
from lodestrata.llm.components import connected_components

#: Leading tokens of a leaf.
DEPTH = 3
#: Leaves are broadcast up to this many (eight bytes each, some tens of MB as a hash table), and beyond it joined by a shuffle.
BROADCAST_LEAVES = 500_000
#: A text's signature: the least shingle hash of each of so many bins; runs of BAND of them are what candidates share.
BINS, BAND = 30, 3
#: Words of a shingle, and the share of bins in which near copies agree.
SHINGLE, AGREE = 5, 0.7


def masked(line: Column) -> Column:
    """The line with every token that holds a digit as ``<*>``."""
    return F.when(line.rlike("[0-9]"), F.regexp_replace(line, "[^ ]*[0-9][^ ]*", "<*>")).otherwise(line)


def _n_tokens(m: Column) -> Column:
    return F.length(m) - F.length(F.translate(m, " ", "")) + 1


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _leaf(m: Column) -> Column:
    return F.xxhash64(_n_tokens(m), F.substring_index(m, " ", DEPTH))


def _few(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if it is known to be small enough."""
    return F.broadcast(df) if df.count() <= BROADCAST_LEAVES else df


def _enough(rows: DataFrame, key: str, min_docs: int, first: Column | None = None) -> DataFrame:
    """The keys whose rows have a support of min_docs; with first, also the least first of all their rows.

    Rows with voters (the classes that hold a line; any min_docs values where there are more) count the different ones of a key.
    """
    least = [] if first is None else [F.min(first).alias("keeper")]
    if "voters" not in rows.columns:
        return rows.groupBy(key).agg(F.sum("support").alias("all"), *least).filter(F.col("all") >= min_docs).drop("all")
    votes = rows.select(key, F.explode("voters").alias("voter"), *([] if first is None else [first.alias("first")]))
    votes = votes.groupBy(key, "voter").agg(*([F.lit(1)] if first is None else [F.min("first").alias("first")]))
    return votes.groupBy(key).agg(F.count("*").alias("all"), *([] if first is None else [F.min("first").alias("keeper")])).filter(F.col("all") >= min_docs).drop("all")


def recurring_lines(docs: DataFrame, min_docs: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text", classes: DataFrame | None = None, long_words: int | None = None) -> DataFrame:
    """(doc_id, copy, at) of the lines to drop, each once; copy is the hash of the text, at the line's place in it: see drop_recurring_lines."""
    words = docs.select(common.col(doc_id).alias("doc_id"), common.text_key(text).alias("copy"), F.posexplode(_lines(common.col(text))).alias("at", "raw"))
    words = words.filter(F.col("raw") != "").withColumn("m", masked(F.col("raw")))
    keyed = words.select("doc_id", "copy", "at", F.xxhash64("m").alias("line"), _leaf(F.col("m")).alias("leaf"))
    if classes is not None:
        keyed = keyed.join(_few(classes), "copy", "left").select("doc_id", "copy", "at", "line", "leaf", F.coalesce("class", "copy").alias("class"))
    keyed = common.cut(keyed, "line-keys")

    if classes is None:
        folded = keyed.groupBy("line", "leaf", "copy").agg(F.min("doc_id").alias("first"))
        support = folded.groupBy("line", "leaf").agg(F.count("*").alias("support"), F.min("first").alias("first"))
        support = common.cut(support, "line-support")
        leaves = _enough(support, "leaf", min_docs)
    else:
        # The first class: that of the smallest id; one without ids comes last.
        folded = common.cut(keyed.groupBy("line", "leaf", "class").agg(F.min("doc_id").alias("first")), "line-classes")
        support = folded.groupBy("line", "leaf").agg(F.count("*").alias("support"), F.min(F.struct(F.col("first").isNull().alias("nameless"), "first", "class")).alias("first"))
        support = common.cut(support, "line-support")
        leaves = folded.groupBy("leaf", "class").agg(F.lit(1)).groupBy("leaf").agg(F.count("*").alias("all")).filter(F.col("all") >= min_docs).select("leaf")
    leaves = common.cut(leaves, "line-leaves")

    # One row for each different line of a leaf that may recur, with its tokens.
    hot = words.select("m", F.xxhash64("m").alias("line"), _leaf(F.col("m")).alias("leaf")).join(_few(leaves), "leaf")
    hot = hot.groupBy("line", "leaf").agg(F.first("m").alias("m")).join(support, ["line", "leaf"])
    more = ["support", "first"]
    if classes is not None:
        # A line of min_docs classes is enough by itself: which they are matters for the others only.
        hot = common.cut(hot, "line-hot")
        weak = folded.join(hot.filter(F.col("support") < min_docs).select("line", "leaf"), ["line", "leaf"])
        weak = weak.groupBy("line", "leaf").agg(F.collect_set("class").alias("voters"))
        anyone = F.array(*[F.lit(i).cast("long") for i in range(min_docs)])
        hot = hot.join(weak, ["line", "leaf"], "left").withColumn("voters", F.coalesce("voters", anyone))
        more = [*more, "voters"]
    hot = common.cut(hot, "line-candidates")
    tokens = hot.select("line", "leaf", *more, F.posexplode(F.split("m", " ")).alias("at", "token")).withColumn("field", F.xxhash64("leaf", "at", "token"))
    constant = _enough(tokens, "field", min_docs).select("field", F.lit(True).alias("constant"))
    constant = common.cut(constant, "line-fields")
    kept = tokens.join(constant, "field", "left")
    # Leading tokens are the leaf's own; masked fields are alike wherever they stand.
    fixed = F.col("constant").isNotNull() | (F.col("at") < DEPTH)
    word = F.when(fixed, F.col("token")).otherwise(F.lit("<*>"))
    shape = kept.groupBy("line", "leaf", *more).agg(
        F.count("*").alias("n"),
        F.sum(fixed.cast("long")).alias("n_fixed"),
        F.max((fixed & (F.col("token") != "<*>") & (F.col("token") != "")).cast("int")).alias("some"),
        F.array_sort(F.collect_list(F.struct("at", word.alias("word")))).alias("template"),
    )
    shape = shape.filter((F.col("n_fixed") * 100 >= F.col("n") * percent) & (F.col("some") == 1)).select("line", "leaf", *more, F.xxhash64("leaf", F.col("template.word")).alias("template"))
    shape = common.cut(shape, "line-templates")
    recurring = _enough(shape, "template", min_docs, F.col("first")).select("template", "keeper")
    # Cut, so that a join on a template that many lines share may be split.
    recurring = common.cut(recurring, "line-recurring")
    # A line is known by two hashes, its own and its leaf's.
    lines = common.cut(shape.select("line", "leaf", "template").join(recurring, "template").select("line", "leaf", "keeper"), "line-drops")
    found = keyed.join(_few(lines), ["line", "leaf"])
    if classes is None:
        return found.filter(F.col("doc_id") != F.col("keeper")).select("doc_id", "copy", "at").distinct()
    drops = found.filter(F.col("class") != F.col("keeper.class")).select("doc_id", "copy", "at")
    if long_words is not None:
        drops = drops.unionAll(_long_drops(words, classes, long_words))
    return drops.distinct()


def _long_drops(words: DataFrame, classes: DataFrame, long_words: int) -> DataFrame:
    """(doc_id, copy, at) of the lines of long_words words or more that an earlier class has word for word, digits included."""
    long = words.filter(_is_long(F.col("raw"), long_words)).select("doc_id", "copy", "at", _exact(F.col("raw")).alias("line"), F.xxhash64("raw").alias("check"))
    long = common.cut(long.join(_few(classes), "copy", "left").select("doc_id", "copy", "at", "line", "check", F.coalesce("class", "copy").alias("class")), "long-lines")
    folded = long.groupBy("line", "check", "class").agg(F.min("doc_id").alias("first"))
    shared = folded.groupBy("line", "check").agg(F.count("*").alias("support"), F.min(F.struct(F.col("first").isNull().alias("nameless"), "first", "class")).alias("keeper"))
    shared = common.cut(shared.filter("support > 1").select("line", "check", "keeper"), "long-shared")
    return long.join(_few(shared), ["line", "check"]).filter(F.col("class") != F.col("keeper.class")).select("doc_id", "copy", "at")


def near_copies(docs: DataFrame, text: str = "text") -> DataFrame:
    """(copy, class) of the texts that are near copies of others: common.text_key() and the smallest such key of the class.

    Texts are compared by one-permutation MinHash of their SHINGLE-word shingles (a shorter text is one): each text is held against the first
    that has the same BAND bins, and links with it if AGREE of the bins that either has are equal; classes are what links connect. Texts that
    share 0.8 of their shingles miss each other with a chance of a few in a hundred for each such meeting. Null texts and those without words are in no class;
    equal texts are one. What is grouped are rows of one text, or fold before they move.
    """
    words = F.filter(F.split(F.translate(F.lower(common.col(text)), "\n\t\r", "   "), " "), lambda w: w != "")
    rows = docs.select(common.text_key(text).alias("copy"), words.alias("words"), common.col(text).alias("t")).filter("t is not null").drop("t")
    # Word hashes are a column of their own, so that the lambda below does not make them anew for each shingle.
    rows = rows.select("copy", F.transform("words", lambda w: F.xxhash64(w)).alias("w")).filter(F.size("w") > 0)
    runs = F.sequence(F.lit(0), F.greatest(F.size("w") - SHINGLE, F.lit(0)))
    hashes = F.transform(runs, lambda i: F.xxhash64(*[F.get(F.col("w"), i + j) for j in range(SHINGLE)]))
    each = rows.select("copy", F.explode(hashes).alias("h")).withColumn("bin", F.pmod("h", F.lit(BINS)))
    signed = each.groupBy("copy").agg(*[F.min(F.when(F.col("bin") == i, F.col("h"))).alias(f"b{i}") for i in range(BINS)])
    signed = common.cut(signed.select("copy", F.array(*[f"b{i}" for i in range(BINS)]).alias("bins")), "copies-signed")
    common.tidy(docs.sparkSession)
    bands = [F.when(F.exists(part, lambda x: x.isNotNull()), F.xxhash64(F.lit(i), part)) for i in range(0, BINS, BAND) for part in [F.slice("bins", i + 1, BAND)]]
    keyed = signed.select("copy", F.explode(F.array(*bands)).alias("band")).filter("band is not null")
    heads = keyed.groupBy("band").agg(F.min("copy").alias("head"), F.count("*").alias("m")).filter("m > 1").select("band", "head")
    heads = common.cut(heads, "copies-heads")
    pairs = common.cut(keyed.join(heads.hint("merge"), "band").filter("copy <> head").select("copy", "head").distinct(), "copies-pairs")
    mine = lambda x: signed.select(F.col("copy").alias(x), F.col("bins").alias(f"{x}_bins"))
    both = pairs.join(mine("copy"), "copy").join(mine("head"), "head")
    together = F.arrays_zip(F.col("copy_bins").alias("x"), F.col("head_bins").alias("y"))
    some = F.size(F.filter(together, lambda z: z["x"].isNotNull() | z["y"].isNotNull()))
    same = F.size(F.filter(together, lambda z: z["x"] == z["y"]))
    links = both.filter(same * 100 >= some * math.ceil(100 * AGREE)).select(F.col("copy").alias("a"), F.col("head").alias("b"))
    return connected_components(links).select(F.col("node").alias("copy"), F.col("component").alias("class"))


def _is_long(line: Column, long_words: int) -> Column:
    return (F.length(line) >= 2 * long_words - 1) & (F.regexp_count(line, F.lit(r"\S+")) >= long_words)


def _exact(line: Column) -> Column:
    """The hash of a line as it is, apart from those of masked lines."""
    return F.xxhash64(line, F.lit("exact"))


def drop_recurring_lines(docs: DataFrame, min_docs: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text", classes: DataFrame | None = None, long_words: int | None = None) -> DataFrame:
    """docs with text less the lines whose template recurs, and n_lines and n_dropped.

    Lines end at line feeds; empty ones stay. A document of which all lines are dropped has an empty text; one with nothing to
    drop is unchanged. Null text stays null, with 0 lines. The first document of a template is the one with the smallest id;
    null ids count as documents but lose no line. Repeated rows stay and lose the same lines. An empty table gives an empty result;
    columns named n_lines and n_dropped, in any case, are replaced, all others stay as they are.

    With classes (copy, class: near_copies) the first class is that with the smallest id, and keeps the lines in all its rows;
    each row is judged by its own text, whether or not its id is null or repeats. With long_words too, a line of so many words or more goes
    if a second class has it, digits included: two texts that are not near copies are enough. A passage inside a longer line is out of reach.
    """
    if long_words is not None and classes is None:
        raise ValueError("long_words needs classes")
    other_id, other_copy, copy, places, split = common.helpers(docs, "other_id", "other_copy", "copy", "places", "split")

    def listed() -> DataFrame:
        drops = recurring_lines(docs, min_docs, percent, doc_id, text, classes, long_words)
        lists = drops.groupBy("doc_id", "copy").agg(F.sort_array(F.collect_list("at")).alias(places))
        return lists.select(F.col("doc_id").alias(other_id), F.col("copy").alias(other_copy), places)

    lists = common.cut_alone(listed, "line-lists")
    order = common.others(docs, "n_lines", "n_dropped")
    mine = docs.select(*[common.col(c) for c in order], common.text_key(text).alias(copy))
    # The lists grow with the corpus: they are merged at every size, rather than broadcast while they happen to be small.
    joined = mine.join(lists.hint("merge"), common.col(doc_id).eqNullSafe(F.col(other_id)) & (F.col(copy) == F.col(other_copy)), "left")
    # A column of its own, so that the lambda below does not split the text anew for each run.
    joined = joined.withColumn(split, _lines(common.col(text)))
    whole, gone, lines = common.col(text), F.col(places), F.col(split)
    # What stays are the runs between dropped places: a document's work grows with its lines, however many of them go.
    start = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(gone, i - 1) + 1)
    end = lambda i: F.when(i == F.size(gone), F.size(lines)).otherwise(F.get(gone, i))
    left = F.flatten(F.transform(F.sequence(F.lit(0), F.size(gone)), lambda i: F.slice(lines, start(i) + 1, end(i) - start(i))))
    n_lines = F.when(whole.isNull(), F.lit(0)).otherwise(F.size(lines)).cast("long")
    shown = {c: F.when(gone.isNotNull(), F.array_join(left, "\n")).otherwise(whole).alias(c) if c.lower() == text.lower() else common.col(c) for c in order}
    return joined.select(*shown.values(), n_lines.alias("n_lines"), F.when(gone.isNull(), F.lit(0)).otherwise(F.size(gone)).cast("long").alias("n_dropped"))
