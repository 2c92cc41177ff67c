import json
import os

import pandas as pd

from lodestrata.functions.codec import ABORT, BEGIN, COMMIT, DELETE, PUT
from lodestrata.operators import wal
from lodestrata.plans import lsm
from lodestrata.streaming import replay as streaming

ROWS = [
    (1, 10, BEGIN, b"", b""),
    (2, 20, BEGIN, b"", b""),
    (3, 10, PUT, b"k", b"ten"),
    (4, 20, PUT, b"k", b"twenty"),
    (5, 20, PUT, b"only", b"20"),
    (6, 20, COMMIT, b"", b""),
    (7, 10, COMMIT, b"", b""),
    (8, 30, DELETE, b"only", b""),
    (9, 30, ABORT, b"", b""),
    (10, 40, PUT, b"open", b"never"),
    (11, 50, DELETE, b"only", b""),
    (12, 50, COMMIT, b"", b""),
]


def log(spark):
    return spark.createDataFrame(ROWS, wal.ROW)


def pairs(df):
    return {bytes(r["key"]): bytes(r["value"]) for r in df.collect()}


def test_replay_follows_commits(spark):
    # Transaction 10 wrote first but committed last, so its value stands.
    assert pairs(lsm.replay(log(spark))) == {b"k": b"ten"}
    assert pairs(lsm.replay(log(spark), until=6)) == {b"k": b"twenty", b"only": b"20"}
    assert pairs(lsm.replay(log(spark), until=5)) == {}


def test_frames_round_trip(spark):
    again = wal.decode_frames(wal.encode_frames(log(spark))).orderBy("seq").collect()
    assert [(r["seq"], r["txn_id"], r["type"], bytes(r["key"]), bytes(r["value"])) for r in again] == ROWS


def test_levels_and_compaction(spark):
    def level(rows):
        return spark.createDataFrame(rows, "key binary, value binary, is_deleted boolean")

    new, old, base = level([(b"a", b"2", False), (b"b", b"", True)]), level([(b"b", b"1", False), (b"c", b"", True)]), level([(b"a", b"0", False), (b"c", b"0", False), (b"d", b"0", False)])
    assert pairs(lsm.live([new, old, base])) == {b"a": b"2", b"d": b"0"}
    upper = {bytes(r["key"]): r["is_deleted"] for r in lsm.compact([new, old], bottom=False).collect()}
    assert upper == {b"a": False, b"b": True, b"c": True}
    assert {bytes(r["key"]) for r in lsm.compact([new, old, base], bottom=True).collect()} == {b"a", b"d"}


def test_flush_lays_blocks_end_to_end(spark):
    rows = spark.createDataFrame([(f"k{i:04d}".encode(), b"v" * (i % 7)) for i in range(1000)], "key binary, value binary")
    got = lsm.flush(rows, 64).orderBy("block_no").collect()
    at = 0
    for r in got:
        assert r["offset"] == at
        assert r["size"] == len(r["block"])
        at += r["size"]
    assert len(got) == 16


def test_streaming_replay(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for part, rows in enumerate((ROWS[:5], ROWS[5:])):
        (folder / f"{part}.json").write_text("".join(json.dumps({"seq": s, "txn_id": t, "type": k, "key": key.decode(), "value": v.decode()}) + "\n" for s, t, k, key, v in rows))
        os.utime(folder / f"{part}.json", (1000 + part, 1000 + part))
    lines = spark.readStream.schema("seq long, txn_id long, type int, key string, value string").option("maxFilesPerTrigger", 1).json(str(folder))
    typed = lines.selectExpr("seq", "txn_id", "type", "cast(key as binary) as key", "cast(value as binary) as value")
    q = streaming.committed_stream(typed).writeStream.format("memory").queryName("changes").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert pairs(streaming.fold(spark.table("changes"))) == {b"k": b"ten"}


def test_the_first_end_decides_in_batch_and_stream(spark, tmp_path):
    """Changes after an end, a second end of the other kind: both replays agree."""
    rows = [(1, 1, PUT, b"a", b"1"), (2, 1, COMMIT, b"", b""), (3, 1, PUT, b"a", b"late"), (4, 1, ABORT, b"", b""), (5, 2, PUT, b"b", b"2"), (6, 2, ABORT, b"", b""), (7, 2, COMMIT, b"", b""), (8, 3, DELETE, b"c", b""), (9, 3, COMMIT, b"", b""), (10, 3, COMMIT, b"", b"")]
    batch = spark.createDataFrame(rows, wal.ROW)
    assert pairs(lsm.replay(batch)) == {b"a": b"1"}
    batch.write.parquet(str(tmp_path / "in"))
    stream = streaming.committed_stream(spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in")))
    stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination(120)
    changes = spark.read.parquet(str(tmp_path / "out"))
    assert pairs(streaming.fold(changes)) == {b"a": b"1"}
    key = lambda df: sorted((r["txn_id"], r["commit_seq"], r["seq"]) for r in df.collect())
    assert key(changes) == key(lsm.committed_changes(batch)) == [(1, 2, 1), (3, 9, 8)]


class State:
    """As much of a group's state as a step uses."""

    hasTimedOut = False

    def __init__(self):
        self.get, self.exists = None, False

    def update(self, value):
        self.get, self.exists = value, True

    def remove(self):
        self.get, self.exists = None, False


def test_an_ended_transaction_leaves_no_state():
    def step(state, *rows):
        return list(streaming._step((1,), iter([pd.DataFrame(list(rows), columns=["seq", "txn_id", "type", "key", "value"])]), state, None))

    state = State()
    assert step(state, (1, 1, PUT, b"a", b"1")) == []
    assert state.exists
    assert len(step(state, (2, 1, COMMIT, b"", b""))) == 1
    assert not state.exists
