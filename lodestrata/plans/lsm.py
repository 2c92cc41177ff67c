"""Beyond the base: commit visibility, replay, snapshots, merged reads, compaction and flush.

Logs are rows (seq, txn_id, type, key, value) as in operators.wal. Replay orders changes by where their
transaction commits, then by their own place, so that interleaved transactions replay as if one followed the other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.codec import ABORT, COMMIT, DELETE, PUT
from lodestrata.operators import blocks


def commits(log: DataFrame, until: int | None = None) -> DataFrame:
    """(txn_id, commit_seq) of transactions whose first COMMIT or ABORT is a COMMIT; until: those that committed by then."""
    marks = log.filter(F.col("type").isin(COMMIT, ABORT)).groupBy("txn_id")
    found = marks.agg(F.min(F.struct("seq", "type")).alias("end")).filter(F.col("end.type") == COMMIT).select("txn_id", F.col("end.seq").alias("commit_seq"))
    return found if until is None else found.filter(F.col("commit_seq") <= until)


def committed_changes(log: DataFrame, until: int | None = None) -> DataFrame:
    """PUT and DELETE rows of committed transactions, with commit_seq; what a transaction logs after its end is ignored."""
    changes = log.filter(F.col("type").isin(PUT, DELETE)).join(commits(log, until), "txn_id")
    return changes.filter(F.col("seq") < F.col("commit_seq"))


def _newest(rows: DataFrame, order: list[Column | str]) -> DataFrame:
    """The last type and value of each key, by partial aggregation: a hot key folds before the shuffle."""
    last = F.max_by(F.struct("type", "value"), F.struct(*order))
    return rows.groupBy("key").agg(last.alias("last")).select("key", "last.type", "last.value")


def replay(log: DataFrame, until: int | None = None) -> DataFrame:
    """(key, value) after the log: last committed change wins, deletions leave nothing.

    until reads a snapshot: transactions that commit later are invisible, even where their changes were logged before.
    """
    return _newest(committed_changes(log, until), ["commit_seq", "seq"]).filter(F.col("type") == PUT).select("key", "value")


def merged_read(levels: list[DataFrame]) -> DataFrame:
    """(key, value, is_deleted) of levels from the newest to the oldest: the newest level that has a key decides."""
    tagged = [level.select("key", "value", "is_deleted", F.lit(-i).alias("__age")) for i, level in enumerate(levels)]
    rows = tagged[0]
    for t in tagged[1:]:
        rows = rows.unionByName(t)
    newest = rows.groupBy("key").agg(F.max_by(F.struct("value", "is_deleted"), "__age").alias("n"))
    return newest.select("key", "n.value", "n.is_deleted")


def live(levels: list[DataFrame]) -> DataFrame:
    """(key, value) of keys that the merged levels don't delete."""
    return merged_read(levels).filter(~F.col("is_deleted")).select("key", "value")


def compact(levels: list[DataFrame], *, bottom: bool) -> DataFrame:
    """One level out of several neighbouring ones; tombstones go only if the bottom level is among them."""
    merged = merged_read(levels)
    return merged.filter(~F.col("is_deleted")) if bottom else merged


def flush(rows: DataFrame, entries_per_block: int = 64, restart_interval: int = blocks.RESTART_INTERVAL) -> DataFrame:
    """(block_no, divider, offset, size, block): an ordered map's encoded blocks, laid end to end."""
    encoded = blocks.encode_blocks(blocks.number_blocks(rows.select("key", "value"), entries_per_block), restart_interval)
    sizes = encoded.select("block_no", F.octet_length("block").cast("long").alias("size"))
    index = blocks.build_index(sizes, encoded.select("block_no", F.col("first_key").alias("divider")))
    return index.join(encoded.select("block_no", "block"), "block_no")
