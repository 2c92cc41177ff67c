"""An ordered map of unique byte keys as a DataFrame (key BINARY, value BINARY), and its operations as sets.

The order is unsigned bytewise, which is Spark's order of BINARY. A missing key is null or an absent
row; an empty value is an empty value. Mutations come as batches whose rows are ordered by a unique
``seq``, since rows of a DataFrame have no order of their own. A hot key's mutations fold before they move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.operators.ranks import in_ranges

SCHEMA = "key binary, value binary"


class OrderedMap:
    """An immutable ordered map; every mutation returns a new one."""

    def __init__(self, rows: DataFrame):
        self.rows = rows.select(F.col("key"), F.col("value"))

    @classmethod
    def empty(cls, spark: SparkSession) -> OrderedMap:
        return cls(spark.createDataFrame([], SCHEMA))

    @classmethod
    def of(cls, df: DataFrame, key: Column, value: Column) -> OrderedMap:
        """The map of a table whose key expression is unique."""
        return cls(df.select(key.cast("binary").alias("key"), value.cast("binary").alias("value")))

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> OrderedMap:
        return cls(spark.read.schema(SCHEMA).parquet(path))

    def save(self, path: str) -> None:
        """Writes Parquet in key ranges, sorted: lookups, seeks and ranges then skip files and row groups by their statistics.

        The path must be new: a map is never written over the files it is read from.
        """
        self.rows.repartitionByRange("key").sortWithinPartitions("key").write.mode("errorifexists").parquet(path)

    # Reading

    def size(self) -> DataFrame:
        return self.rows.agg(F.count("*").alias("size"))

    def is_empty(self) -> bool:
        return self.rows.isEmpty()

    def clear(self) -> OrderedMap:
        return OrderedMap(self.rows.limit(0))

    def scan(self) -> DataFrame:
        """All pairs in key order: a range shuffle and a sort within partitions."""
        return self.rows.orderBy("key")

    def contains(self, key: bytes) -> bool:
        return not self.rows.filter(F.col("key") == F.lit(key)).isEmpty()

    def get(self, key: bytes) -> bytes | None:
        row = self.rows.filter(F.col("key") == F.lit(key)).first()
        return None if row is None else bytes(row["value"])

    def contained(self, probes: DataFrame) -> DataFrame:
        """The probes whose key is present."""
        return probes.join(self.rows.select("key"), "key", "left_semi")

    def multi_get(self, probes: DataFrame) -> DataFrame:
        """The probes with found and value; value is null where the key is missing."""
        mine = self.rows.withColumn("found", F.lit(True))
        return probes.join(mine, "key", "left").withColumn("found", F.coalesce("found", F.lit(False)))

    def seek(self, target: bytes) -> DataFrame:
        """The pair with the first key at or after the target, if any."""
        return self.rows.filter(F.col("key") >= F.lit(target)).orderBy("key").limit(1)

    def range(self, start: bytes, stop: bytes | None = None) -> DataFrame:
        """Pairs from start on, up to but without stop, in key order."""
        rows = self.rows.filter(F.col("key") >= F.lit(start))
        return (rows if stop is None else rows.filter(F.col("key") < F.lit(stop))).orderBy("key")

    # Changing

    def insert_if_absent(self, batch: DataFrame) -> OrderedMap:
        """Adds the batch (key, value, seq) where the key is new; of equal keys the lowest seq gets in."""
        fresh = batch.groupBy("key").agg(F.min_by("value", "seq").alias("value")).join(self.rows.select("key"), "key", "left_anti")
        return OrderedMap(self.rows.unionByName(fresh))

    def upsert(self, batch: DataFrame) -> OrderedMap:
        """Adds or overwrites with the batch (key, value, seq); of equal keys the highest seq wins."""
        newest = batch.groupBy("key").agg(F.max_by("value", "seq").alias("value"))
        kept = self.rows.join(newest.select("key"), "key", "left_anti")
        return OrderedMap(kept.unionByName(newest))

    def erase(self, keys: DataFrame) -> OrderedMap:
        """Removes the keys; missing ones are no error."""
        return OrderedMap(self.rows.join(keys.select("key"), "key", "left_anti"))

    def apply(self, batch: DataFrame) -> DataFrame:
        """What each mutation of the batch (key, seq, op) in turn returns: insert, put and erase, each true or false.

        insert and put are true where the key was absent, erase where it was present. Only the operation
        before counts, so a key's operations are dealt by ranges of seq, and each range learns how the one before
        it ended: a hot key is spread over as many tasks as the batch has ranges.
        """
        rows = in_ranges(batch.select("key", "seq", "op"), "seq")
        stays = F.col("op") != "erase"
        ends = rows.groupBy("key", "__range").agg(F.max_by(stays, F.col("seq")).alias("__end"))
        carried = F.lag("__end").over(Window.partitionBy("key").orderBy("__range"))
        had = self.rows.select("key", F.lit(True).alias("__had"))
        starts = ends.withColumn("__start", carried).join(had, "key", "left").select("key", "__range", F.coalesce("__start", "__had", F.lit(False)).alias("__start"))
        before = F.lag(stays).over(Window.partitionBy("key", "__range").orderBy("seq"))
        joined = rows.withColumn("__before", before).join(starts, ["key", "__range"])
        present = F.coalesce("__before", "__start")
        return joined.select("key", "seq", "op", F.when(F.col("op") == "erase", present).otherwise(~present).alias("result"))
