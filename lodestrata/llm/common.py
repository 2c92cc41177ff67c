"""What the operators of this subpackage share: reading tables, cutting lineage in the shared folder."""

from __future__ import annotations

import math
import threading
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.sources.shared import fresh_path, shared_dir

__all__ = ["col", "crc32_mod", "cut", "cut_alone", "fresh_path", "hashed_rows", "hashed_sample", "helpers", "others", "purge", "release", "shared_dir", "table", "text_key", "tidy", "with_text"]

_written = threading.local()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame, label: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it again.

    The lineage ends at replicated files, so a lost executor costs no more than the tasks it ran, and
    later joins plan with the true size.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    for paths in getattr(_written, "stack", []):
        paths.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_at = path
    return out


def release(*done: DataFrame) -> None:
    """Removes the files of cut() results that nothing will read again."""
    for df in done:
        _delete(df.sparkSession, df._cut_at)


def tidy(spark: SparkSession) -> None:
    """Has the driver collect its garbage, upon which Spark removes the shuffle files of finished queries.

    A large heap may put that off until the executors' disks are full.
    """
    spark._jvm.System.gc()


def cut_alone(make: Callable[[], DataFrame], label: str) -> DataFrame:
    """cut() of what make returns; what else was cut on the way to it is removed."""
    _written.stack = [*getattr(_written, "stack", []), []]
    try:
        out = cut(make(), label)
    finally:
        *_written.stack, paths = _written.stack
    for path in paths[:-1]:
        _delete(out.sparkSession, path)
    tidy(out.sparkSession)
    return out


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def purge(spark: SparkSession) -> None:
    """Removes what these operators left in the shared folder. Results that are still to be read must be written elsewhere first."""
    _delete(spark, f"{shared_dir(spark)}/lodestrata")


def col(name: str) -> Column:
    """The column of exactly this name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def others(df: DataFrame, *names: str) -> list[str]:
    """df's columns but those with these names, which are compared without case as Spark does."""
    gone = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in gone]


def helpers(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of df has, in any case: for columns that only exist on the way."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def with_text(df: DataFrame, text: str, columns: list[str] | None, *replaced: str) -> tuple[DataFrame, DataFrame, int]:
    """df's rows as a task is to read them, the part of them that it hands on, and the place of the text in the former.

    Handed on are these columns, or all but those with the replaced names. The text comes last if it is not one of them, so that it moves once.
    """
    keep = others(df if columns is None else df.select(*[col(c) for c in columns]), *replaced)
    mine = [col(c) for c in keep]
    places = [i for i, c in enumerate(keep) if c.lower() == text.lower()]
    if places:
        return df.select(*mine), df.select(*mine), places[0]
    (whole,) = helpers(df, "whole")
    return df.select(*mine, col(text).alias(whole)), df.select(*mine), len(keep)


def text_key(text: str) -> Column:
    """The hash that stands for a whole text."""
    return F.xxhash64(col(text), F.lit(0))


def hashed_sample(rows: DataFrame, by: list[str], most: int, size: Column, most_bytes: int, per: str | None = None) -> pa.Table:
    """hashed_rows() as a table in the order of their hashes."""
    (key,) = helpers(rows, "hash")
    table = hashed_rows(rows, by, most, size, most_bytes, per, key).toArrow()
    return table.sort_by(key).drop_columns([key])


def hashed_rows(rows: DataFrame, by: list[str], most: int, size: Column, most_bytes: int, per: str | None = None, hash_name: str | None = None) -> DataFrame:
    """At most ``most`` different rows and ``most_bytes`` of them, those with the smallest hashes over ``by``; the hash may be kept as hash_name.

    Rows are taken by their smallest hashes, so the sample depends neither on the order of rows nor on their partitions. Copies
    (rows that are equal in ``by``) count once, and are folded before they move. A row of more than a sixty-fourth of most_bytes is
    not taken, which bounds what reaches the driver. With ``per``, the bounds hold for each value of that column.
    """
    key, group, weight = helpers(rows, "hash", "group", "weight")
    stratum = col(per) if per else F.lit("")
    keyed = rows.select("*", F.xxhash64(*[col(c) for c in by], F.lit("sample")).alias(key), stratum.cast("string").alias(group), size.cast("long").alias(weight))
    keyed = keyed.filter(col(weight) <= most_bytes // 64)
    counts = {r[0]: r[1] for r in keyed.groupBy(group).count().collect()}
    none = keyed.filter("false").select(*([key] if hash_name else []), *[col(c) for c in rows.columns])
    if not counts:
        return none.withColumnRenamed(key, hash_name or key)
    # Hashes are uniform: a little more than the share that is wanted, so that fewer than most is all but impossible.
    share = {g: min(1.0, (most + 6 * math.sqrt(most) + 10) / n) for g, n in counts.items()}
    ends = {g: min((1 << 63) - 1, int(x * 2.0**64) - (1 << 63)) for g, x in share.items()}
    firsts = _upto(keyed, key, group, ends).groupBy(group, key).agg(F.first(weight).alias(weight)).collect()
    last = {}
    for g in ends:
        mine = sorted((r[key], r[weight]) for r in firsts if r[group] == g)[:most]
        whole = int(np.searchsorted(np.cumsum([w for _, w in mine]), most_bytes, "right"))
        if whole:
            last[g] = mine[whole - 1][0]
    if not last:
        return none.withColumnRenamed(key, hash_name or key)
    taken = _upto(keyed, key, group, last).groupBy(group, key).agg(F.first(F.struct(*[col(c) for c in rows.columns])).alias("row"))
    return taken.select(*([col(key).alias(hash_name)] if hash_name else []), *[F.col("row")[c].alias(c) for c in rows.columns])


def _upto(keyed: DataFrame, key: str, group: str, ends: dict[str, int]) -> DataFrame:
    """The rows whose hash is at most their group's end."""
    pairs = [F.lit(x) for g, end in ends.items() for x in (g, end)]
    return keyed.filter(col(key) <= F.element_at(F.create_map(*pairs), col(group)))


def crc32_mod(column: Column, n: int) -> Column:
    """crc32 of a value as text, modulo n: the deterministic split into learnt and held-out rows."""
    return F.crc32(F.encode(column.cast("string"), "UTF-8")) % n
