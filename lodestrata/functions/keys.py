"""Keys as bytes: rendering typed columns in key order, and what neighbouring keys share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def padded(column: Column, width: int = 12) -> Column:
    """A non-negative integer as zero-padded digits, whose byte order is its number's."""
    return F.lpad(column.cast("string"), width, "0")


def signed64(column: Column) -> Column:
    """A long as eight big-endian bytes with the sign bit flipped, whose byte order is its number's."""
    flipped = column.cast("long").bitwiseXOR(F.lit(-(1 << 63)).cast("long"))
    return F.unhex(F.lpad(F.hex(flipped), 16, "0"))


def shared_prefix_bytes(a: Column, b: Column) -> Column:
    """How many leading bytes two binary columns share; null if either is null.

    The hexadecimal digits are compared, two a byte, so that a character of several bytes may be split, as bytes are.
    """
    x, y = F.hex(a), F.hex(b)
    most = F.least(F.octet_length(a), F.octet_length(b))
    # The first byte that differs; sequence(1, 0) would count down, so an empty key is guarded.
    differs = F.filter(F.sequence(F.lit(1), most), lambda i: F.substr(x, 2 * i - 1, F.lit(2)) != F.substr(y, 2 * i - 1, F.lit(2)))
    both = a.isNotNull() & b.isNotNull()
    return F.when(both & (most == 0), F.lit(0)).when(both, F.when(a == b, most).otherwise(F.coalesce(F.get(differs, F.lit(0)) - 1, most)))
