"""URL rules through a Bloom filter cascade, in DataFrame expressions only.

A rule is (action, host, path). It fits a url whose host is the rule's or a subdomain of it and whose
path starts with the rule's; of the fitting rules the longest (host and path together) decides. So a url
is judged by asking, of each of its candidate keys (a suffix of the host at a label boundary, joined to
a prefix of the path as long as some rule's path), whether the key is listed.

Membership is answered by a cascade. Level 0 is a Bloom filter of the listed keys. The corpus's
complete key universe is run against it; the unlisted keys that pass are the keys of level 1, the listed
keys that pass level 1 are those of level 2, and so on until no key passes. A key of the universe is
listed exactly if the first level that rejects it is odd, or if it passes all of an odd number of levels. The levels are bit
arrays in constant expressions: judging the corpus takes neither a join nor a shuffle.

The size of level 0 follows from the number of listed keys and its false-positive rate, which is set so
that the universe yields about as many false positives as there are listed keys; the filters' bits are
thus in proportion to the rules (times the logarithm of the universe), not to the corpus.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.llm import common

#: More levels than this are never needed: each holds a fraction of the level two before it.
MAX_LEVELS = 64


@dataclass(frozen=True)
class Rule:
    action: str
    host: str
    path: str

    @property
    def key(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class Level:
    """One Bloom filter: n_hashes positions modulo 64 * len(words), by double hashing."""

    words: tuple[int, ...]
    n_hashes: int
    seed: int


@dataclass(frozen=True)
class Cascade:
    levels: tuple[Level, ...]


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def candidate_keys(host: Column, path: Column, path_lengths: list[int]) -> Column:
    """Suffixes of the host at label boundaries times prefixes of the path with the given lengths, longest first.

    An empty host has no key.
    """
    labels = F.split(host, r"\.")
    n = F.size(labels)
    suffixes = F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(labels, i, n), "."))
    lengths = sorted(set(path_lengths))
    prefixes = F.transform(F.filter(F.lit(lengths), lambda k: k <= F.length(path)), lambda k: F.substr(path, F.lit(1), k))
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_distinct(keys))


def _positions(key: Column, level_bits: int, n_hashes: int, seed: int) -> list[Column]:
    # 31 bits of each hash: no product overflows, whatever the session's ANSI setting.
    a = F.xxhash64(key, F.lit(2 * seed)).bitwiseAND(0x7FFFFFFF)
    b = F.xxhash64(key, F.lit(2 * seed + 1)).bitwiseAND(0x7FFFFFFF).bitwiseOR(F.lit(1).cast("long"))
    return [F.pmod(a + b * i, F.lit(level_bits).cast("long")) for i in range(n_hashes)]


def _passes(key: Column, level: Level) -> Column:
    # The words come as one constant string, once a level: splitting and casting it is folded to an array on the driver.
    words = F.split(F.lit(",".join(map(str, level.words))), ",").cast("array<bigint>")
    places = F.array(*_positions(key, 64 * len(level.words), level.n_hashes, level.seed))
    return F.forall(places, lambda p: F.call_function("shiftright", F.get(words, F.floor(p / 64).cast("int")), (p % 64).cast("int")).bitwiseAND(1) == 1)


def contains(cascade: Cascade, key: Column) -> Column:
    """Whether a key of the universe is listed."""
    listed = F.lit(len(cascade.levels) % 2 == 1)
    for i in reversed(range(len(cascade.levels))):
        listed = F.when(_passes(key, cascade.levels[i]), listed).otherwise(F.lit(i % 2 == 1))
    return listed


def _build_level(keys: DataFrame, n_keys: int, rate: float, seed: int) -> Level:
    """The filter of a column ``key``: bits are or-ed by word, at most as many rows as words reach the driver."""
    n_bits = max(64, math.ceil(-n_keys * math.log(rate) / math.log(2) ** 2))
    n_words = (n_bits + 63) // 64
    n_hashes = max(1, round(n_words * 64 / max(1, n_keys) * math.log(2)))
    n_hashes = min(n_hashes, 30)
    positions = keys.select(F.explode(F.array(*_positions(F.col("key"), 64 * n_words, n_hashes, seed))).alias("p"))
    bits = positions.select(F.floor(F.col("p") / 64).cast("int").alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("p") % 64).cast("int")).alias("bit"))
    words = [0] * n_words
    for word, value in bits.groupBy("word").agg(F.bit_or("bit")).collect():
        words[word] = value
    return Level(tuple(words), n_hashes, seed)


def build_cascade(listed: DataFrame, universe: DataFrame, level0_rate: float | None = None) -> Cascade:
    """The cascade of the keys ``listed.key`` over ``universe.key``; both may repeat keys and hold nulls.

    Without listed keys the cascade has no level and rejects every key. Listed keys that the universe
    lacks take part all the same.
    """
    spark = listed.sparkSession
    inside = listed.select("key").na.drop().distinct()
    n_inside = inside.count()
    if not n_inside:
        return Cascade(())
    universe = universe.select("key").na.drop()
    n_universe = universe.select(F.approx_count_distinct("key")).first()[0]
    rate = level0_rate or min(0.5, max(1e-9, n_inside * math.sqrt(0.5) / max(1, n_universe)))
    levels = [_build_level(inside, n_inside, rate, 0)]
    # Keys outside, narrowed by each even level; keys inside, narrowed by each odd one.
    outside = common.cut(universe.filter(_passes(F.col("key"), levels[0])).distinct().join(inside, "key", "left_anti"), "cascade-outside")
    narrowed = {0: outside, 1: inside}
    while True:
        side = (len(levels) + 1) % 2
        n = narrowed[side].count()
        if not n:
            return Cascade(tuple(levels))
        if len(levels) >= MAX_LEVELS:
            raise RuntimeError("the cascade does not end; is the hash function degenerate?")
        levels.append(_build_level(narrowed[side], n, 0.5, len(levels)))
        narrowed[1 - side] = narrowed[1 - side].filter(_passes(F.col("key"), levels[-1]))


def judge(pages: DataFrame, rules: list[Rule], url: str = "url", default: str = "allow", level0_rate: float | None = None) -> DataFrame:
    """pages with host, path, rule (host and path of the deciding rule, else null) and verdict.

    Two cascades over all candidate keys of pages are asked: one lists every rule's key, one those that
    block. A url that no rule fits gets ``default``, as does one that is null or lacks ``://`` (host and
    path are then empty). Columns of pages with the result's names, in any case, are replaced, all others stay; repeated rows stay. An
    empty table or rule list is fine. Of two rules with one key, the last counts. Rules' hosts must be
    lower case and their paths must start with ``/``.
    """
    for r in rules:
        if r.action not in ("allow", "block") or r.host != r.host.lower() or not r.path.startswith("/"):
            raise ValueError(f"not a rule: {r}")
    spark = pages.sparkSession
    last = {r.key: r for r in rules}
    lengths = sorted({len(r.path) for r in last.values()})
    keep = [common.col(c) for c in common.others(pages, "host", "path", "rule", "verdict")]
    names = common.helpers(pages, "host", "path", "keys", "rule")
    host, path, keys, rule = (F.col(c) for c in names)
    split = pages.select("*", host_of(common.col(url)).alias(names[0]), path_of(common.col(url)).alias(names[1]))
    if not last:
        return split.select(*keep, host.alias("host"), path.alias("path"), F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    keyed = split.withColumn(names[2], candidate_keys(host, path, lengths))
    universe = keyed.select(F.explode(keys).alias("key"))
    # The rules are one constant string, which the driver parses.
    ruled = F.from_json(F.lit(json.dumps([{"key": k, "action": r.action} for k, r in last.items()])), "array<struct<key:string,action:string>>")
    listing = spark.range(1).select(F.explode(ruled).alias("r")).select("r.key", "r.action")
    listed = build_cascade(listing, universe, level0_rate)
    # The second cascade is only asked about listed keys, so those are its universe.
    blocking = build_cascade(listing.filter("action = 'block'"), listing, level0_rate)
    fitting = F.filter(keys, lambda k: contains(listed, k))
    longest = F.array_sort(fitting, lambda a, b: F.length(b) - F.length(a))
    judged = keyed.withColumn(names[3], F.get(longest, F.lit(0)))
    verdict = F.when(rule.isNull(), F.lit(default)).when(contains(blocking, rule), F.lit("block")).otherwise(F.lit("allow"))
    return judged.select(*keep, host.alias("host"), path.alias("path"), rule.alias("rule"), verdict.alias("verdict"))
