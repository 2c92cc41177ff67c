import random

import pytest

from lodestrata.functions.keys import shared_prefix_bytes, signed64
from lodestrata.operators import blocks, ranks
from lodestrata.operators.kv import OrderedMap
from pyspark.sql import functions as F


def made(spark, pairs):
    return OrderedMap(spark.createDataFrame([(k, v) for k, v in pairs], "key binary, value binary"))


def batch(spark, rows):
    return spark.createDataFrame(rows, "key binary, value binary, seq long")


def pairs(df):
    return [(bytes(r["key"]), bytes(r["value"])) for r in df.collect()]


def test_scan_is_in_byte_order(spark):
    m = made(spark, [(b"delta", b"4"), (b"alpha", b"1"), (b"charlie", b"3"), (b"bravo", b"2"), (b"echo", b"5"), (b"foxtrot", b"6")])
    assert [k for k, _ in pairs(m.scan())] == [b"alpha", b"bravo", b"charlie", b"delta", b"echo", b"foxtrot"]
    assert m.get(b"zzz") is None
    assert not m.contains(b"zzz")
    assert m.get(b"charlie") == b"3"


def test_unsigned_order_and_empty_keys(spark):
    keys = [b"\xff", b"\x80", b"\x7f", b"\x00", b"", b"a", b"ab", b"k2", b"k10"]
    m = made(spark, [(k, b"") for k in keys])
    assert [k for k, _ in pairs(m.scan())] == sorted(keys)
    assert m.get(b"") == b""
    assert m.contains(b"")


def test_insert_keeps_the_first(spark):
    m = OrderedMap.empty(spark).insert_if_absent(batch(spark, [(b"k", b"1", 1), (b"k", b"2", 2)]))
    m = m.insert_if_absent(batch(spark, [(b"k", b"3", 3), (b"n", b"4", 4)]))
    assert pairs(m.scan()) == [(b"k", b"1"), (b"n", b"4")]


def test_upsert_keeps_the_last(spark):
    m = OrderedMap.empty(spark).upsert(batch(spark, [(b"x", b"101", 2), (b"x", b"100", 1)]))
    assert m.get(b"x") == b"101"
    assert m.size().first()["size"] == 1


def test_erase_and_results(spark):
    m = made(spark, [(b"a", b"1"), (b"b", b"2"), (b"c", b"3")])
    gone = spark.createDataFrame([(b"b",), (b"q",)], "key binary")
    assert pairs(m.erase(gone).scan()) == [(b"a", b"1"), (b"c", b"3")]
    ops = spark.createDataFrame([(b"b", 1, "erase"), (b"b", 2, "erase"), (b"b", 3, "put"), (b"b", 4, "insert"), (b"z", 5, "insert")], "key binary, seq long, op string")
    assert [r["result"] for r in m.apply(ops).orderBy("seq").collect()] == [True, False, True, False, True]


def test_seek_and_range(spark):
    m = made(spark, [(b"a", b"A"), (b"c", b"C"), (b"e", b"E"), (b"g", b"G")])
    assert [pairs(m.seek(k)) for k in (b"c", b"d", b"z")] == [[(b"c", b"C")], [(b"e", b"E")], []]
    assert [k for k, _ in pairs(m.range(b"b", b"g"))] == [b"c", b"e"]


def test_clear_and_missing_values(spark):
    m = made(spark, [(b"a", b"")])
    assert m.clear().is_empty()
    got = {bytes(r["key"]): (r["found"], r["value"]) for r in m.multi_get(spark.createDataFrame([(b"a",), (b"b",)], "key binary")).collect()}
    assert got[b"a"] == (True, b"")
    assert got[b"b"] == (False, None)


def test_against_a_dict(spark):
    rng = random.Random(123)
    order = list(range(100))
    rng.shuffle(order)
    m = OrderedMap.empty(spark).insert_if_absent(batch(spark, [(f"k{i}".encode(), f"vk{i}".encode(), n) for n, i in enumerate(order)]))
    assert pairs(m.scan()) == sorted((f"k{i}".encode(), f"vk{i}".encode()) for i in range(100))


def test_shared_prefix(spark):
    rows = [(b"apple", b"apples", 5), (b"", b"x", 0), (b"x", b"", 0), ("é".encode(), "è".encode(), 1), (b"same", b"same", 4), (b"a\x00", b"a\x00b", 2), (None, b"a", None)]
    df = spark.createDataFrame(rows, "a binary, b binary, want int")
    assert all(r["got"] == r["want"] for r in df.withColumn("got", shared_prefix_bytes(F.col("a"), F.col("b"))).collect())


def test_signed_keys_sort_as_numbers(spark):
    numbers = [-(1 << 63), -5, -1, 0, 1, 300, (1 << 63) - 1]
    df = spark.createDataFrame([(n,) for n in reversed(numbers)], "n long")
    assert [r["n"] for r in df.orderBy(signed64(F.col("n"))).collect()] == numbers


def test_ranks_over_several_ranges(spark, monkeypatch):
    monkeypatch.setattr(ranks, "ROWS_A_BUCKET", 50)
    df = spark.range(1000).select(F.lpad(F.hex(F.xxhash64("id")), 16, "0").alias("key"))
    got = ranks.with_rank(df, "key").orderBy("key").collect()
    assert [r["rn"] for r in got] == list(range(1, 1001))


@pytest.mark.parametrize("bins", [1, 3, 50])
def test_routes_agree(spark, bins):
    rng = random.Random(bins)
    dividers = sorted({rng.randbytes(2) for _ in range(60)})
    index = spark.createDataFrame([(d, i) for i, d in enumerate(dividers)], "divider binary, block_no long")
    probes = spark.createDataFrame([(rng.randbytes(2),) for _ in range(300)] + [(b"",), (None,), (dividers[0],)], "key binary")
    want = {(None if r["key"] is None else bytes(r["key"])): r["block_no"] for r in blocks.route(probes, index).collect()}
    got = {(None if r["key"] is None else bytes(r["key"])): r["block_no"] for r in blocks.route_by_range(probes, index, bins=bins).collect()}
    assert want == got
    assert all(v == (max((i for i, d in enumerate(dividers) if d <= k), default=None) if k is not None else None) for k, v in want.items())
    empty = index.limit(0)
    assert {r["block_no"] for r in blocks.route(probes, empty).collect()} == {None}
    assert {r["block_no"] for r in blocks.route_by_range(probes, empty).collect()} == {None}


def test_order_violations_over_several_ranges(spark, monkeypatch):
    monkeypatch.setattr(ranks, "ROWS_A_BUCKET", 30)
    rng = random.Random(8)
    rows = [(i, b"%03d" % rng.randrange(1000)) for i in range(500)]
    df = spark.createDataFrame(rows, "seq long, key binary").repartition(4)
    want = [(b[0], b[1], a[1]) for a, b in zip(rows, rows[1:], strict=False) if b[1] <= a[1]]
    got = blocks.order_violations(df).orderBy("seq").collect()
    assert [(r["seq"], bytes(r["key"]), bytes(r["previous"])) for r in got] == want
    assert blocks.order_violations(df.limit(0)).count() == 0


def test_results_over_several_ranges(spark, monkeypatch):
    monkeypatch.setattr(ranks, "ROWS_A_BUCKET", 20)
    rng = random.Random(10)
    ops = [(rng.choice([b"hot", b"hot", b"a", b"b"]), i, rng.choice(["insert", "put", "erase"])) for i in range(300)]
    have, want = {b"a"}, []
    for key, _, op in ops:
        present = key in have
        want.append(present if op == "erase" else not present)
        have = have - {key} if op == "erase" else have | {key}
    got = made(spark, [(b"a", b"1")]).apply(spark.createDataFrame(ops, "key binary, seq long, op string").repartition(3))
    assert [r["result"] for r in got.orderBy("seq").collect()] == want


def test_saved_map_prunes(spark, tmp_path):
    path = str(tmp_path / "map")
    made(spark, [(b"%04d" % i, b"v") for i in range(1000)]).save(path)
    m = OrderedMap.load(spark, path)
    assert m.get(b"0500") == b"v"
    assert len(pairs(m.range(b"0990"))) == 10
    plan = m.range(b"0990", b"0995")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(key" in plan and "LessThan(key" in plan
    with pytest.raises(Exception, match="exists"):
        m.save(path)


def test_order_violations_of_a_group_over_several_ranges(spark, monkeypatch):
    monkeypatch.setattr(ranks, "ROWS_A_BUCKET", 30)
    rng = random.Random(9)
    rows = [(i, rng.choice(["hot", "hot", "cold", None]), b"%03d" % rng.randrange(1000)) for i in range(500)]
    want = []
    for g in ("hot", "cold", None):
        mine = [r for r in rows if r[1] == g]
        want += [(*b, a[2]) for a, b in zip(mine, mine[1:], strict=False) if b[2] <= a[2]]
    got = blocks.order_violations(spark.createDataFrame(rows, "seq long, grp string, key binary").repartition(4), group="grp")
    assert got.columns == ["seq", "grp", "key", "previous"]
    assert sorted((r["seq"], r["grp"], bytes(r["key"]), bytes(r["previous"])) for r in got.collect()) == sorted(want)


def test_ranges_split_equal_probes(spark, monkeypatch):
    monkeypatch.setattr(ranks, "ROWS_A_BUCKET", 100)
    index = spark.createDataFrame([(b"a", 0), (b"h", 1), (b"h", 2), (b"z", 3)], "divider binary, block_no long")
    probes = spark.createDataFrame([(b"hot", i) for i in range(2000)], "key binary, id long")
    sizes = []
    kept = ranks.in_ranges

    def seen(*args, **options):
        placed = kept(*args, **options)
        sizes.extend(r["count"] for r in placed.groupBy("__range").count().collect())
        return placed

    monkeypatch.setattr(blocks, "in_ranges", seen)
    got = blocks.route_by_range(probes, index).collect()
    assert sorted(r["id"] for r in got) == list(range(2000))
    assert {r["block_no"] for r in got} == {2}
    assert len(sizes) > 10 and max(sizes) < 400
