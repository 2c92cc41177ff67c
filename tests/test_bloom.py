import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.functions.codec import CorruptData
from lodestrata.operators import bloom
from lodestrata.operators.bloom import BloomFilter


@pytest.mark.parametrize(("n", "rate", "bits", "k", "size"), [(20000, 0.01, 191702, 7, 23987), (1000, 0.001, 14378, 10, 1822), (100, 0.0, 4314, 30, 564), (100, 1.0, 1, 1, 25), (1, 0.5, 2, 1, 25), (0, 0.01, 1, 1, 25)])
def test_sizing(n, rate, bits, k, size):
    f = BloomFilter(n, rate)
    assert (f.bits, f.k, len(f.serialize())) == (bits, k, size)


@pytest.mark.parametrize(
    ("key", "start", "step"),
    [
        (b"", "9da44f6e0275d406", "e7644d7bd913a20a"),
        (b"a", "4eec79764ec5f717", "f3b64adf09fd786e"),
        (b"apple", "6f0c0e0d7c26dbd3", "13063996fa4f108e"),
        (b"12345678", "4a480b2a6513d666", "54d758f9cde59e90"),
        (b"123456789", "930e6c48ec38b471", "f16cda971bba9bd4"),
    ],
)
def test_hashes(key, start, step):
    assert f"{bloom.hash64([key], bloom.SEED_START)[0]:016x}" == start
    assert f"{bloom.hash64([key], bloom.SEED_STEP)[0]:016x}" == step


def test_positions():
    assert bloom.positions([b"apple"], 191702, 7)[0].tolist() == [20639, 31958, 43277, 54596, 65915, 77234, 88553]
    assert bloom.positions([b"apple"], 96, 7)[0].tolist() == [19, 48, 77, 10, 39, 68, 1]


def test_no_false_negatives_and_rate():
    rng = random.Random(9)
    keys = [rng.randbytes(8) for _ in range(20000)]
    f = BloomFilter(len(keys), 0.01)
    f.add_all(keys)
    again = BloomFilter.deserialize(f.serialize())
    assert f.may_contain_all(keys).all()
    assert again.may_contain_all(keys).all()
    absent = [rng.randbytes(9) for _ in range(20000)]
    assert f.may_contain_all(absent).mean() <= 0.018


def test_bad_bytes():
    data = BloomFilter(100).serialize()
    for bad in (data[:10], b"xxxx" + data[4:], data[:4] + b"\x02" + data[5:], data[:-1], data + b"x", data[:8] + bytes(8) + data[16:], data[:8] + b"\xff" * 8 + data[16:24]):
        with pytest.raises(CorruptData):
            BloomFilter.deserialize(bad)
    with pytest.raises(ValueError, match="number"):
        BloomFilter(10, float("nan"))


def test_distributed_build_equals_local(spark):
    keys = [b"", b"\x00", b"\xff\x80", *[f"k{i}".encode() for i in range(500)]]
    df = spark.createDataFrame([(k,) for k in keys] + [(None,)], "key binary").repartition(3)
    local = BloomFilter(len(keys), 0.01)
    local.add_all(keys)
    built = bloom.build(df, "key")
    assert np.array_equal(built.data, local.data)
    flags = bloom.probe(df, "key", built).groupBy("maybe").count().collect()
    assert {r["maybe"]: r["count"] for r in flags} == {True: len(keys), False: 1}


def test_semi_join_is_exact(spark):
    left = spark.range(1000).select(F.col("id").cast("string").cast("binary").alias("key"), "id")
    right = left.filter("id % 7 = 0").select("key")
    assert {r["id"] for r in bloom.semi_join(left, right, "key").collect()} == set(range(0, 1000, 7))
    assert bloom.semi_join(left, right.limit(0), "key").count() == 0
