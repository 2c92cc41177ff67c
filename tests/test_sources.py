import pytest
from pyspark.sql import functions as F

from lodestrata.functions.codec import PUT, Record
from lodestrata.sources.files import FileManager
from lodestrata.sources.log_files import LogSource
from lodestrata.sources.sorted_table import SortedTableSource, load, lookup


def test_file_lifecycle(spark, tmp_path):
    files, path = FileManager(spark), f"{tmp_path}/a.txt"
    assert not files.exists(path)
    assert files.open(path) is None
    with files.create(path) as f:
        assert f.write(b"Hello, ")
        assert f.write(b"World!")
        assert f.flush()
        assert f.sync()
    assert not f.write(b"late")
    assert not f.sync()
    assert f.close()
    assert files.exists(path)
    assert files.exists(str(tmp_path))
    with files.open(path) as r:
        assert r.read(100) == b"Hello, World!"
        assert r.read(1) == b""
    with pytest.raises(ValueError, match="closed"):
        r.read(1)
    assert r.close()


def test_chunks_rename_delete(spark, tmp_path):
    files, a, b = FileManager(spark), f"{tmp_path}/n", f"{tmp_path}/m"
    with files.create(a) as f:
        f.write(b"1234567890")
    with files.open(a) as r:
        assert [r.read(4) for _ in range(4)] == [b"1234", b"5678", b"90", b""]
        assert r.read_at(2, 3) == b"345"
    assert files.rename(a, b)
    assert not files.rename(a, b)
    assert files.delete(b)
    assert files.delete(b)
    assert not files.exists(b)


def test_sorted_table_round_trip_and_pruning(spark, tmp_path):
    spark.dataSource.register(SortedTableSource)
    path = str(tmp_path / "t")
    df = spark.range(5000).select(F.lpad(F.col("id").cast("string"), 6, "0").cast("binary").alias("key"), F.concat(F.lit("v"), F.col("id").cast("string")).cast("binary").alias("value"))
    df.repartitionByRange(3, "key").sortWithinPartitions("key").write.format("sorted_table").mode("append").option("block_bytes", 1000).option("file_bytes", 20000).save(path)
    assert len(list((tmp_path / "t").glob("part-*.sst"))) > 3
    assert not list((tmp_path / "t").glob("*.pending"))
    plain = spark.read.format("sorted_table").load(path)
    assert plain.count() == 5000
    read = load(spark, path)
    assert {tuple(map(bytes, r)) for r in read.collect()} == {tuple(map(bytes, r)) for r in df.collect()}
    assert [bytes(r["value"]) for r in read.filter(F.col("key") == F.lit(b"001234")).collect()] == [b"v1234"]
    assert read.filter(F.col("key") == F.lit(b"none")).count() == 0
    assert read.filter((F.col("key") > F.lit(b"000010")) & (F.col("key") <= F.lit(b"000020"))).count() == 10
    df.limit(3).orderBy("key").coalesce(1).sortWithinPartitions("key").write.format("sorted_table").mode("overwrite").save(path)
    assert load(spark, path).count() == 3


def test_unsorted_rows_are_refused(spark, tmp_path):
    spark.dataSource.register(SortedTableSource)
    df = spark.createDataFrame([(b"b", b""), (b"a", b"")], "key binary, value binary").coalesce(1)
    with pytest.raises(Exception, match="increase"):
        df.write.format("sorted_table").mode("append").save(str(tmp_path / "x"))


def test_log_files_batch_and_stream(spark, tmp_path):
    spark.dataSource.register(LogSource)
    path = tmp_path / "log"
    rows = spark.createDataFrame([(1, PUT, b"a", b"1"), (2, PUT, b"b", b"2")], "txn_id long, type int, key binary, value binary").coalesce(1)
    rows.write.format("wal_frames").mode("append").save(str(path))
    # A torn tail ends its file.
    (path / "zz.wal").write_bytes(Record(3, PUT, b"c", b"3").frame() + b"\x10\x00")
    got = spark.read.format("wal_frames").load(str(path)).orderBy("txn_id").collect()
    assert [(r["txn_id"], bytes(r["key"])) for r in got] == [(1, b"a"), (2, b"b"), (3, b"c")]
    (path / "zz.wal").write_bytes(b"\x0b\x00\x00\x00" + bytes(15))
    with pytest.raises(Exception, match="checksum"):
        spark.read.format("wal_frames").load(str(path)).collect()
    (path / "zz.wal").write_bytes(Record(3, PUT, b"c", b"3").frame())
    q = spark.readStream.format("wal_frames").load(str(path)).writeStream.format("memory").queryName("log_rows").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("log_rows").count() == 3


def test_a_stream_takes_every_file_once_whatever_its_name(spark, tmp_path):
    spark.dataSource.register(LogSource)
    path, out = tmp_path / "log", str(tmp_path / "out")

    def trigger():
        rows = spark.readStream.format("wal_frames").load(str(path)).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp"))
        rows.trigger(availableNow=True).start(out).awaitTermination(120)
        return sorted(r["txn_id"] for r in spark.read.parquet(out).collect())

    path.mkdir()
    (path / "log-8000.wal").write_bytes(Record(8000, PUT, b"a", b"").frame())
    assert trigger() == [8000]
    (path / "log-1000.wal").write_bytes(Record(1000, PUT, b"a", b"").frame())
    for i in range(10):
        spark.createDataFrame([(i, PUT, b"a", b"1")], "txn_id long, type int, key binary, value binary").coalesce(1).write.format("wal_frames").mode("append").save(str(path))
    assert trigger() == [*range(10), 1000, 8000]
    assert trigger() == [*range(10), 1000, 8000]


def test_log_files_end_at_their_size(spark, tmp_path):
    spark.dataSource.register(LogSource)
    rows = spark.range(100).selectExpr("id as txn_id", "1 as type", "cast(cast(id as string) as binary) as key", "cast('v' as binary) as value").coalesce(1)
    rows.write.format("wal_frames").mode("append").option("file_bytes", 500).save(str(tmp_path))
    assert len(list(tmp_path.glob("log-*.wal"))) > 3
    # Names sort in the order of the rows.
    got = spark.read.format("wal_frames").load(str(tmp_path)).orderBy("file", "offset").collect()
    assert [r["txn_id"] for r in got] == list(range(100))


def test_lookup_through_files(spark, tmp_path):
    spark.dataSource.register(SortedTableSource)
    df = spark.range(2000).select(F.lpad(F.col("id").cast("string"), 6, "0").cast("binary").alias("key"), F.col("id").cast("string").cast("binary").alias("value"))
    df.repartitionByRange(3, "key").sortWithinPartitions("key").write.format("sorted_table").mode("append").option("block_bytes", 500).save(str(tmp_path / "t"))
    probes = spark.createDataFrame([(b"000007",), (b"000007",), (b"nothing",), (None,), (b"",), (b"001999",)], "key binary")
    assert sorted(bytes(r["value"]) for r in lookup(probes, str(tmp_path / "t")).collect()) == [b"1999", b"7", b"7"]
