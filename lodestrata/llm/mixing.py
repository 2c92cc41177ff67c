"""Soft-membership mixing to target weights, in DataFrame expressions only.

Documents have no known domain; a table of labels names that of some. A multinomial naive Bayes classifier over
hashed words, learnt from the labelled documents, gives each document a posterior over the domains,
its log-likelihoods divided by TEMPER so that memberships stay soft. The rates r >= 0 minimise

    |sum_i n_i r_i p_i - w * total|^2

where n_i are a document's tokens, p_i its posterior, w the target weights and total the corpus's tokens: the
expected tokens of each domain are to match the target. Projected gradient steps start from r = 1; each
is one pass that sums a vector and a small matrix over all documents. A step moves r_i by -<p_i, l>,
the gradient in the metric of tokens, scaled by the inverse of sum n p p^T over the documents whose rate is positive, and
clips at zero; it is halved until the residual falls. So r_i is a short function of p_i and the steps so far, and nothing but the
steps' vectors ever reaches the driver. The descent ends where the targets are met, or where no step brings them
nearer, as when no mixture of the documents can meet them; the residual tells which.

Sums over words and documents are of integers (fixed-point values), so that their order changes nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.llm import common

#: The bound of the labelled sample, in rows, and of the classifier's table.
MAX_LABELLED = 20_000
BUCKETS = 1 << 17
#: Words of a text depend on each other; their joint evidence counts as that of so many times fewer.
TEMPER = 4.0
#: The residual, relative to the corpus's tokens, at which targets count as met.
TOLERANCE = 1e-7
#: A step that lessens the residual by a smaller share than this ends the descent.
LEAST_GAIN = 1e-6
#: Halvings of a step before it counts as useless.
HALVINGS = 20
#: The fixed-point unit of log-likelihoods.
UNIT = 1 << 24


def words_of(text: Column) -> Column:
    """The words between white space, lower-cased."""
    return F.filter(F.split(F.translate(F.lower(text), "\n\t\r", "   "), " "), lambda w: w != "")


def _bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


@dataclass
class DomainModel:
    """log P(word bucket | domain) less that of the first domain, in units of 1 / UNIT: a table of at most BUCKETS rows, for the rest a constant each."""

    domains: list[str]
    table: DataFrame
    unseen: list[int]
    prior: list[float]


def fit_domains(docs: DataFrame, labelled: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DomainModel:
    """Learns from the texts of the documents that labelled (doc_id, domain) names, at most MAX_LABELLED of them.

    Null domains and ids count as unlabelled; of several labels of one document the first by name counts.
    """
    named = labelled.select("doc_id", "domain").na.drop().groupBy("doc_id").agg(F.min("domain").alias("domain"))
    named = common.cut(common.hashed_rows(named, ["doc_id"], MAX_LABELLED, F.lit(1), 64 * MAX_LABELLED), "mix-labels")
    texts = docs.select(common.col(doc_id).alias("doc_id"), common.col(text).alias("text")).filter("text is not null")
    known = texts.join(F.broadcast(named), "doc_id")
    words = known.select("domain", F.explode(F.split(F.translate(F.lower("text"), "\n\t\r", "   "), " ")).alias("word")).filter("word <> ''")
    counts = common.cut(words.groupBy(_bucket(F.col("word")).alias("bucket"), "domain").count(), "mix-counts")
    # A row each domain: totals for the smoothed likelihoods and the prior.
    totals = {r["domain"]: r["n"] for r in counts.groupBy("domain").agg(F.sum("count").alias("n")).collect()}
    rows = {r["domain"]: r["n"] for r in named.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    domains = sorted(rows)
    size = {d: totals.get(d, 0) + BUCKETS for d in domains}
    every = sum(rows.values())
    if not domains:
        return DomainModel(domains, counts, [], [])
    seen = [F.coalesce(F.sum(F.when(F.col("domain") == d, F.col("count"))), F.lit(0)) + 1 for d in domains]
    likelihoods = [F.log(n / float(size[d])) for n, d in zip(seen, domains, strict=True)]
    against = [F.round((x - likelihoods[0]) * UNIT).cast("long").alias(f"l{i}") for i, x in enumerate(likelihoods)]
    table = common.cut(counts.groupBy("bucket").agg(*against), "mix-model")
    unseen = [round(float(np.log(size[domains[0]] / size[d])) * UNIT) for d in domains]
    return DomainModel(domains, table, unseen, [float(np.log(rows[d] / every)) for d in domains])


def posteriors(docs: DataFrame, model: DomainModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, copy, n_tokens, p0, p1, ...): one row for each different (doc_id, text); copy is the text's hash.

    A text without words (or null) has 0 tokens and the prior as posterior.
    """
    k = range(len(model.domains))
    rows = docs.select(common.col(doc_id).alias("doc_id"), F.xxhash64(common.col(text)).alias("copy"), F.coalesce(common.col(text), F.lit("")).alias("text"))
    # Rows that are equal in id and text fold: their means are the same and their counts are divided by their number.
    words = rows.select("doc_id", "copy", F.posexplode(F.split(F.translate(F.lower("text"), "\n\t\r", "   "), " ")).alias("at", "word"))
    seen = words.withColumn("bucket", _bucket(F.col("word"))).join(F.broadcast(model.table), "bucket", "left")
    real = F.col("word") != ""
    sums = seen.groupBy("doc_id", "copy").agg(
        F.sum(real.cast("long")).alias("words"),
        F.sum((F.col("at") == 0).cast("long")).alias("rows"),
        *[F.sum(F.when(real, F.coalesce(F.col(f"l{i}"), F.lit(model.unseen[i])))).alias(f"s{i}") for i in k],
    )
    n = (F.col("words") / F.col("rows")).cast("long")
    score = [F.lit(model.prior[i]) + F.coalesce(F.col(f"s{i}") / F.col("rows") / UNIT / TEMPER, F.lit(0.0)) for i in k]
    most = F.greatest(*score) if len(score) > 1 else score[0]
    scored = sums.select("doc_id", "copy", n.alias("n_tokens"), most.alias("top"), *[x.alias(f"e{i}") for i, x in enumerate(score)])
    powers = [F.exp(F.col(f"e{i}") - F.col("top")) for i in k]
    total = sum(powers[1:], powers[0])
    return scored.select("doc_id", "copy", "n_tokens", *[(p / total).alias(f"p{i}") for i, p in enumerate(powers)])


def _rate(steps: list[np.ndarray], k: int) -> Column:
    r = F.lit(1.0)
    for s in steps:
        dot = sum((F.col(f"p{i}") * float(s[i]) for i in range(1, k)), F.col("p0") * float(s[0]))
        r = F.greatest(r - dot, F.lit(0.0))
    return r


def fit_rates(members: DataFrame, targets: list[float]) -> tuple[list[np.ndarray], float]:
    """The steps' vectors of the projected gradient descent, which _rate() applies, and the residual that is left, as a share of all tokens."""
    k = len(targets)
    n = F.col("n_tokens").cast("double")
    total = float(members.agg(F.sum("n_tokens")).first()[0] or 0)
    # Sums may exceed the corpus's tokens a thousand times before they leave 63 bits.
    unit = 2.0 ** (52 - int(total).bit_length())

    def measure(steps: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        r = members.select("*", _rate(steps, k).alias("r"))
        exact = lambda x: F.sum(F.round(x * unit).cast("long"))
        tokens = [exact(n * F.col("r") * F.col(f"p{i}")) for i in range(k)]
        gram = [exact(F.when(F.col("r") > 0, n * F.col(f"p{i}") * F.col(f"p{j}"))) for i in range(k) for j in range(i, k)]
        values = np.array([0.0 if x is None else x / unit for x in r.agg(*tokens, *gram).first()])
        m, at = np.zeros((k, k)), k
        for i in range(k):
            for j in range(i, k):
                m[i, j] = m[j, i] = values[at]
                at += 1
        return values[:k], m

    steps: list[np.ndarray] = []
    reached, gram = measure(steps)
    goal = np.array(targets) / sum(targets) * total
    error = float(np.linalg.norm(reached - goal))
    while error > TOLERANCE * max(total, 1.0):
        scale = gram + 1e-9 * np.trace(gram) / k * np.eye(k)
        step = np.linalg.solve(scale, reached - goal) if np.trace(gram) > 0 else reached - goal
        for _ in range(HALVINGS):
            then, then_gram = measure([*steps, step])
            left = float(np.linalg.norm(then - goal))
            if left < error:
                break
            step = step / 2
        else:
            break
        steps.append(step)
        reached, gram, gain, error = then, then_gram, 1 - left / error, left
        if gain < LEAST_GAIN:
            break
    return steps, error / max(total, 1.0)


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, copy, n_tokens, p_<domain>, ..., rate, residual) for each different (doc_id, text) of docs; copy is the text's hash.

    rate is the number of times to take a document, whole or not. residual is the same in every row: how far the expected tokens are from
    the targets, as a share of all tokens; well above TOLERANCE, no mixture of these documents meets the targets. Targets are relative weights of the labelled
    table's domains; a domain without one
    is wanted in no amount, a target whose domain nothing is labelled with is an error, as are negative
    weights and weights of sum 0. Without labelled documents that have text, or with an empty table of documents, every rate is 1 and residual is null.
    Other columns of docs play no part.
    """
    if any(w < 0 for w in targets.values()) or not sum(targets.values()) > 0:
        raise ValueError("targets must be non-negative weights, not all 0")
    model = fit_domains(docs, labelled, doc_id, text)
    if not model.domains:
        rows = docs.select(common.col(doc_id).alias("doc_id"), F.xxhash64(common.col(text)).alias("copy"), F.size(words_of(F.coalesce(common.col(text), F.lit("")))).cast("long").alias("n_tokens"))
        return rows.distinct().withColumns({"rate": F.lit(1.0), "residual": F.lit(None).cast("double")})
    if absent := set(targets) - set(model.domains):
        raise ValueError(f"no labelled document is of {sorted(absent)}")
    members = common.cut(posteriors(docs, model, doc_id, text), "mix-members")
    steps, residual = fit_rates(members, [targets.get(d, 0.0) for d in model.domains])
    names = [F.round(F.col(f"p{i}"), 6).alias(f"p_{d}") for i, d in enumerate(model.domains)]
    return members.select("doc_id", "copy", "n_tokens", *names, F.round(_rate(steps, len(model.domains)), 6).alias("rate"), F.lit(residual).alias("residual"))


def apply_rates(docs: DataFrame, rates: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with n_tokens and rate, without the documents whose rate is 0; columns with these names, in any case, are replaced."""
    keep = common.others(docs, "n_tokens", "rate")
    copy, other_id, other_copy = common.helpers(docs, "copy", "other_id", "other_copy")
    mine = docs.select(*[common.col(c) for c in keep], F.xxhash64(common.col(text)).alias(copy))
    right = common.cut(rates.select(F.col("doc_id").alias(other_id), F.col("copy").alias(other_copy), "n_tokens", "rate"), "mix-rates")
    joined = mine.join(right, common.col(doc_id).eqNullSafe(F.col(other_id)) & (F.col(copy) == F.col(other_copy)))
    return joined.filter("rate > 0").select(*[common.col(c) for c in keep], "n_tokens", "rate")
