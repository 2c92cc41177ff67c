"""Beyond the base: replaying a stream of log records.

State is kept by transaction: its changes wait until COMMIT lets them out or ABORT drops them. What comes out are
committed changes in upsert form; ``fold`` keeps the newest of each key. A transaction's first end decides, as in plans.lsm.

State is what open transactions have logged: it goes with their end. With ``ttl_ms``, an open transaction that
stays silent so long is given up too, and an end is remembered so long, for records that come in later batches than their transaction's end;
Spark then runs a batch at every trigger, even without data.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodestrata.functions.codec import ABORT, COMMIT, DELETE, PUT

CHANGES = "txn_id long, commit_seq long, seq long, type int, key binary, value binary"
_WAITING = "seqs array<long>, types array<int>, keys array<binary>, vals array<binary>, ended boolean"


def _step(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState, ttl_ms: int | None) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    seqs, types, keys, vals, ended = state.get if state.exists else ([], [], [], [], False)
    seqs, types, keys, vals = list(seqs), list(types), list(keys), list(vals)
    rows = pd.concat(list(batches)).sort_values("seq")
    for r in rows.itertuples(index=False):
        if ended:
            continue
        if r.type in (PUT, DELETE):
            seqs.append(int(r.seq))
            types.append(int(r.type))
            keys.append(bytes(r.key))
            vals.append(bytes(r.value) if r.value is not None else b"")
        elif r.type == COMMIT:
            if seqs:
                yield pd.DataFrame({"txn_id": [key[0]] * len(seqs), "commit_seq": [int(r.seq)] * len(seqs), "seq": seqs, "type": types, "key": keys, "value": vals})
            seqs, types, keys, vals, ended = [], [], [], [], True
        elif r.type == ABORT:
            seqs, types, keys, vals, ended = [], [], [], [], True
    if ended and ttl_ms is None:
        if state.exists:
            state.remove()
        return
    state.update((seqs, types, keys, vals, ended))
    if ttl_ms is not None:
        state.setTimeoutDuration(ttl_ms)


def committed_stream(log: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """Changes (txn_id, commit_seq, seq, type, key, value) of a streaming log, as their transactions commit.

    log: (seq, txn_id, type, key, value), in the order it was written, as a log's files are. Records of a transaction after its end are ignored in the same
    batch, and within ttl_ms in later ones; without ttl_ms, nothing may follow an end in a later batch.
    """

    def step(key, batches, state):  # noqa: ANN001, ANN202
        return _step(key, batches, state, ttl_ms)

    rows = log.select("seq", "txn_id", "type", "key", "value")
    timeout = GroupStateTimeout.NoTimeout if ttl_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return rows.groupBy("txn_id").applyInPandasWithState(step, CHANGES, _WAITING, "append", timeout)


def fold(changes: DataFrame) -> DataFrame:
    """(key, value) of collected committed changes: the last of each key, deletions apart."""
    last = changes.groupBy("key").agg(F.max_by(F.struct("type", "value"), F.struct("commit_seq", "seq")).alias("last"))
    return last.filter(F.col("last.type") == PUT).select("key", "last.value")
