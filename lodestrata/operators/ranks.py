"""Places in key order without a single task that sees all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.sources.shared import written

#: Rows of a range, about; a table has as many ranges as that makes, without an upper bound.
ROWS_A_BUCKET = 250_000
#: monotonically_increasing_id() counts a task's rows in so many low bits, above which it has the task's number.
_ROW_BITS = 33


def in_ranges(df: DataFrame, *keys: str, parts: int | None = None) -> DataFrame:
    """df with __range and __place (both from 0): rows in the order of keys, dealt to ranges and numbered within each.

    One shuffle by ranges of the keys, a sort in each task, no window. The rows are written to the shared folder, so that
    all uses of them see the same ranges. ``parts`` sets the number of ranges, which else follows from that of rows.
    """
    ranges = parts or 1 + df.count() // ROWS_A_BUCKET
    ordered = df.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys).withColumn("__id", F.monotonically_increasing_id())
    place = F.col("__id").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return written(ordered, "ranges").withColumns({"__range": F.shiftright("__id", _ROW_BITS), "__place": place}).drop("__id")


def with_rank(df: DataFrame, key: str, rank: str = "rn") -> DataFrame:
    """df with each row's place (from 1) in the order of a unique key.

    A row's place in its range is shifted by the rows of the ranges before: sums over one row a range.
    """
    placed = in_ranges(df, key)
    sizes = placed.groupBy("__range").agg(F.count("*").alias("__n"))
    starts = sizes.select("__range", (F.sum("__n").over(Window.orderBy("__range")) - F.col("__n")).alias("__start"))
    ranked = placed.join(starts, "__range").withColumn(rank, (F.col("__start") + F.col("__place") + 1).cast("long"))
    return ranked.select(*df.columns, rank)
