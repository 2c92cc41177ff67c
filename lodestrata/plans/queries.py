"""A query for each operator over the driver's tables, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.functions.codec import ABORT, COMMIT, DELETE, PUT, fixed32, frame_size, varint_length
from lodestrata.functions.keys import padded, shared_prefix_bytes
from lodestrata.operators import blocks, bloom, wal
from lodestrata.operators.kv import OrderedMap
from lodestrata.plans import lsm
from lodestrata.sources.files import FileManager
from lodestrata.sources.log_files import LogSource
from lodestrata.sources.shared import fresh_path
from lodestrata.sources.sorted_table import SortedTableSource, load, lookup
from lodestrata.streaming import replay as streaming

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

ENTRIES_PER_BLOCK = 64
SEEK_KEY = "00000000123x"
RANGE_KEYS = ("000000000100", "000000000900")
GET_KEY = "000000000007"
SNAPSHOT_SHARE = 2


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _text(df: DataFrame) -> DataFrame:
    """Binary columns as the text they hold."""
    return df.select(*[F.col(c).cast("string").alias(c) if t == "binary" else F.col(c) for c, t in df.dtypes])


def orders_map(spark: SparkSession, sf_dir: str) -> OrderedMap:
    o = _table(spark, sf_dir, "orders")
    return OrderedMap.of(o, padded(F.col("o_orderkey")), F.concat_ws(":", "o_orderstatus", F.col("o_custkey").cast("string")))


def customers_map(spark: SparkSession, sf_dir: str) -> OrderedMap:
    c = _table(spark, sf_dir, "customer")
    return OrderedMap.of(c, padded(F.col("c_custkey")), F.col("c_name"))


def events_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events")
    return e.select(padded(F.col("user_id")).cast("binary").alias("key"), F.concat_ws(":", "event_type", F.col("event_id").cast("string")).cast("binary").alias("value"), F.col("event_id").alias("seq"))


ORDERS_SQL = "SELECT lpad(o_orderkey::VARCHAR, 12, '0') AS key, o_orderstatus || ':' || o_custkey::VARCHAR AS value FROM orders"
CUSTOMERS_SQL = "SELECT lpad(c_custkey::VARCHAR, 12, '0') AS key, c_name AS value FROM customer"
EVENTS_SQL = "SELECT lpad(user_id::VARCHAR, 12, '0') AS key, event_type || ':' || event_id::VARCHAR AS value, event_id AS seq FROM events"


# The ordered map


@query(f"SELECT key, value FROM ({ORDERS_SQL}) ORDER BY key")
def kv_scan_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text(orders_map(spark, sf_dir).scan())


@query("SELECT count(*)::BIGINT AS size FROM orders")
def kv_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders_map(spark, sf_dir).size()


@query(f"SELECT count(*) FILTER (WHERE key < '')::BIGINT AS size, count(*)::BIGINT AS before FROM ({ORDERS_SQL})")
def kv_clear(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = orders_map(spark, sf_dir)
    sizes = [m.size().withColumn("which", F.lit(name)) for name, m in (("size", orders.clear()), ("before", orders))]
    return sizes[0].unionAll(sizes[1]).groupBy().agg(*[F.max(F.when(F.col("which") == name, F.col("size"))).alias(name) for name in ("size", "before")])


@query(f"SELECT 'orders' AS map, count(*) = 0 AS is_empty FROM ({ORDERS_SQL}) UNION ALL SELECT 'none', count(*) = 0 FROM orders WHERE o_orderkey IS NULL")
def kv_is_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    maps = {"orders": orders_map(spark, sf_dir), "none": OrderedMap.empty(spark)}
    return spark.createDataFrame([(name, m.is_empty()) for name, m in maps.items()], "map string, is_empty boolean")


@query(f"SELECT k.key, m.key IS NOT NULL AS found, m.value FROM (VALUES ('{GET_KEY}'), ('{SEEK_KEY}'), ('')) k(key) LEFT JOIN ({ORDERS_SQL}) m ON m.key = k.key")
def kv_scalar_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One key at a time, as contains() and get() answer."""
    orders, rows = orders_map(spark, sf_dir), []
    for key in (GET_KEY, SEEK_KEY, ""):
        value = orders.get(key.encode())
        rows.append((key, orders.contains(key.encode()), None if value is None else value.decode()))
    return spark.createDataFrame(rows, "key string, found boolean, value string")


@query(f"SELECT key FROM (SELECT DISTINCT lpad((user_id * 7)::VARCHAR, 12, '0') AS key FROM events) p WHERE EXISTS (SELECT 1 FROM ({ORDERS_SQL}) m WHERE m.key = p.key)")
def kv_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    probes = _table(spark, sf_dir, "events").select(padded(F.col("user_id") * 7).cast("binary").alias("key")).distinct()
    return _text(orders_map(spark, sf_dir).contained(probes))


@query(f"SELECT key, value FROM ({ORDERS_SQL}) WHERE key = '{GET_KEY}'")
def kv_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text(orders_map(spark, sf_dir).rows.filter(F.col("key") == F.lit(GET_KEY.encode())))


@query(f"SELECT p.key, m.value, m.key IS NOT NULL AS found FROM (SELECT DISTINCT lpad((user_id * 3)::VARCHAR, 12, '0') AS key FROM events) p LEFT JOIN ({ORDERS_SQL}) m ON m.key = p.key")
def kv_multi_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    probes = _table(spark, sf_dir, "events").select(padded(F.col("user_id") * 3).cast("binary").alias("key")).distinct()
    return _text(orders_map(spark, sf_dir).multi_get(probes))


@query(f"SELECT key, value FROM ({CUSTOMERS_SQL}) UNION ALL SELECT key, arg_min(value, seq) FROM ({EVENTS_SQL}) e WHERE NOT EXISTS (SELECT 1 FROM ({CUSTOMERS_SQL}) c WHERE c.key = e.key) GROUP BY key")
def kv_insert_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text(customers_map(spark, sf_dir).insert_if_absent(events_batch(spark, sf_dir)).rows)


@query(f"SELECT key, arg_max(value, seq) AS value FROM (SELECT key, value, -1 AS seq FROM ({CUSTOMERS_SQL}) UNION ALL SELECT key, value, seq FROM ({EVENTS_SQL})) GROUP BY key")
def kv_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text(customers_map(spark, sf_dir).upsert(events_batch(spark, sf_dir)).rows)


@query(f"SELECT key, value FROM ({CUSTOMERS_SQL}) c WHERE NOT EXISTS (SELECT 1 FROM ({EVENTS_SQL}) e WHERE e.key = c.key)")
def kv_erase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text(customers_map(spark, sf_dir).erase(events_batch(spark, sf_dir)).rows)


OP_SQL = "CASE WHEN seq % 5 = 0 THEN 'erase' WHEN seq % 5 < 3 THEN 'put' ELSE 'insert' END"


@query(f"""
WITH b AS (SELECT key, seq, {OP_SQL} AS op FROM ({EVENTS_SQL})),
s AS (SELECT b.*, coalesce(lag(op <> 'erase') OVER (PARTITION BY b.key ORDER BY seq), c.key IS NOT NULL) AS present FROM b LEFT JOIN ({CUSTOMERS_SQL}) c ON c.key = b.key)
SELECT key, seq, op, CASE WHEN op = 'erase' THEN present ELSE NOT present END AS result FROM s""")
def kv_mutation_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text(customers_map(spark, sf_dir).apply(events_batch(spark, sf_dir).withColumn("op", F.expr(OP_SQL))))


@query(f"SELECT key, value FROM ({ORDERS_SQL}) WHERE key >= '{SEEK_KEY}' ORDER BY key LIMIT 1")
def kv_seek(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text(orders_map(spark, sf_dir).seek(SEEK_KEY.encode()))


@query(f"SELECT key, value FROM ({ORDERS_SQL}) WHERE key >= '{RANGE_KEYS[0]}' AND key < '{RANGE_KEYS[1]}' ORDER BY key")
def kv_range_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text(orders_map(spark, sf_dir).range(*[k.encode() for k in RANGE_KEYS]))


@query(f"SELECT key, value FROM ({ORDERS_SQL}) WHERE key >= '{RANGE_KEYS[0]}' AND key < '{RANGE_KEYS[1]}' ORDER BY key")
def kv_saved_range_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The range of a map that was saved by key ranges: bounds reach the Parquet scan."""
    path = fresh_path(spark, "ordered-map")
    orders_map(spark, sf_dir).save(path)
    return _text(OrderedMap.load(spark, path).range(*[k.encode() for k in RANGE_KEYS]))


# Sorted-table blocks


def pages_numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _table(spark, sf_dir, "pages")
    return blocks.number_blocks(OrderedMap.of(p, F.concat_ws("#", "url", padded(F.col("page_id"))), F.col("html")).rows, ENTRIES_PER_BLOCK)


def orders_numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.number_blocks(orders_map(spark, sf_dir).rows, ENTRIES_PER_BLOCK)


PAGES_SQL = "SELECT url || '#' || lpad(page_id::VARCHAR, 12, '0') AS key, html AS value FROM pages"


def _layout_sql(rows: str) -> str:
    return f"""
    ranked AS (SELECT key, value, row_number() OVER (ORDER BY key) - 1 AS place FROM ({rows})),
    numbered AS (SELECT key, value, place // {ENTRIES_PER_BLOCK} AS block_no, place % {ENTRIES_PER_BLOCK} AS entry_no FROM ranked),
    lagged AS (SELECT *, lag(key) OVER (PARTITION BY block_no ORDER BY entry_no) AS before FROM numbered),
    shared AS (SELECT *, CASE WHEN entry_no % 16 = 0 THEN 0 ELSE
        coalesce(list_min(list_filter(range(1, least(length(before), length(key)) + 1), lambda i: before[i] <> key[i])) - 1, least(length(before), length(key))) END AS shared FROM lagged),
    sized AS (SELECT *, length(key) - shared AS non_shared, strlen(value) AS value_len FROM shared),
    laid AS (SELECT *, coalesce(sum(12 + non_shared + value_len) OVER (PARTITION BY block_no ORDER BY entry_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM sized),
    sizes AS (SELECT block_no, count(*) AS n_entries, sum(12 + non_shared + value_len) + 4 * ((count(*) + 15) // 16 + 1) AS size FROM laid GROUP BY block_no)"""


@query("""
WITH u AS (SELECT page_id, url, lag(url) OVER (PARTITION BY page_id // 50 ORDER BY url) AS before FROM pages)
SELECT page_id, CASE WHEN before IS NULL THEN NULL ELSE coalesce(list_min(list_filter(range(1, least(length(before), length(url)) + 1), lambda i: before[i] <> url[i])) - 1, least(length(before), length(url))) END::BIGINT AS shared FROM u""")
def shared_prefix_len(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _table(spark, sf_dir, "pages").select("page_id", F.col("url").cast("binary").alias("url"))
    before = F.lag("url").over(Window.partitionBy(F.floor(F.col("page_id") / 50)).orderBy("url"))
    return p.withColumn("before", before).select("page_id", shared_prefix_bytes(F.col("before"), F.col("url")).cast("long").alias("shared"))


@query(f"WITH {_layout_sql(PAGES_SQL)} SELECT block_no::BIGINT AS block_no, entry_no::BIGINT AS entry_no, key, shared::BIGINT AS shared, non_shared::BIGINT AS non_shared, value_len::BIGINT AS value_len, start::BIGINT AS start FROM laid")
def block_prefix_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    laid = blocks.prefix_layout(pages_numbered(spark, sf_dir)).withColumnRenamed("offset", "start")
    return _text(laid.select("block_no", "entry_no", "key", "shared", "non_shared", "value_len", "start"))


@query("""
WITH s AS (SELECT o_orderkey AS seq, o_orderstatus AS grp, lpad(o_custkey::VARCHAR, 12, '0') AS key FROM orders),
l AS (SELECT *, lag(key) OVER (PARTITION BY grp ORDER BY seq) AS previous FROM s)
SELECT seq, grp, key, previous FROM l WHERE key <= previous""")
def block_order_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), F.col("o_orderstatus").alias("grp"), padded(F.col("o_custkey")).cast("binary").alias("key"))
    return _text(blocks.order_violations(rows, group="grp"))


@query("""
WITH s AS (SELECT o_orderkey AS seq, lpad((o_orderkey + o_custkey)::VARCHAR, 12, '0') AS key FROM orders),
l AS (SELECT *, lag(key) OVER (ORDER BY seq) AS previous FROM s)
SELECT seq, key, previous FROM l WHERE key <= previous""")
def table_order_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), padded(F.col("o_orderkey") + F.col("o_custkey")).cast("binary").alias("key"))
    return _text(blocks.order_violations(rows))


@query(f"WITH {_layout_sql(PAGES_SQL)} SELECT block_no::BIGINT AS block_no, n_entries::BIGINT AS n_entries, size::BIGINT AS size FROM sizes")
def block_size_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.size_estimates(blocks.prefix_layout(pages_numbered(spark, sf_dir)))


INDEX_SQL = f"{_layout_sql(ORDERS_SQL)}, firsts AS (SELECT block_no, min(key) AS divider FROM laid GROUP BY block_no), idx AS (SELECT f.block_no, f.divider, coalesce(sum(size) OVER (ORDER BY f.block_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start, size FROM firsts f JOIN sizes USING (block_no))"


def orders_index(numbered: DataFrame) -> DataFrame:
    sizes = blocks.size_estimates(blocks.prefix_layout(numbered))
    return blocks.build_index(sizes, numbered.groupBy("block_no").agg(F.min("key").alias("divider")))


@query(f"WITH {INDEX_SQL} SELECT block_no::BIGINT AS block_no, divider, start::BIGINT AS start, size::BIGINT AS size FROM idx")
def index_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text(orders_index(orders_numbered(spark, sf_dir)).withColumnRenamed("offset", "start"))


# Probes from before the first divider on; some keys are present, some fall between.
PROBES_SQL = "SELECT DISTINCT CASE WHEN event_id % 50 = 0 THEN '' ELSE lpad((event_id * 3)::VARCHAR, 12, '0') || CASE WHEN event_id % 2 = 0 THEN 'x' ELSE '' END END AS key FROM events"
ROUTED_SQL = f"probes AS ({PROBES_SQL}), routed AS (SELECT p.key, i.block_no FROM probes p ASOF LEFT JOIN idx i ON p.key >= i.divider)"


def route_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events")
    key = F.when(F.col("event_id") % 50 == 0, F.lit("")).otherwise(F.concat(padded(F.col("event_id") * 3), F.when(F.col("event_id") % 2 == 0, F.lit("x")).otherwise(F.lit(""))))
    return e.select(key.cast("binary").alias("key")).distinct()


@query(f"WITH {INDEX_SQL}, {ROUTED_SQL} SELECT key, block_no::BIGINT AS block_no FROM routed")
def index_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text(blocks.route(route_probes(spark, sf_dir), orders_index(orders_numbered(spark, sf_dir))))


@query(f"WITH {INDEX_SQL}, {ROUTED_SQL} SELECT key, block_no::BIGINT AS block_no FROM routed")
def index_route_by_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text(blocks.route_by_range(route_probes(spark, sf_dir), orders_index(orders_numbered(spark, sf_dir))))


@query(f"WITH {INDEX_SQL}, {ROUTED_SQL} SELECT r.key, r.block_no::BIGINT AS block_no, l.value FROM routed r LEFT JOIN laid l ON l.block_no = r.block_no AND l.key = r.key")
def sst_point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbered = orders_numbered(spark, sf_dir)
    return _text(blocks.point_lookup(route_probes(spark, sf_dir), numbered, orders_index(numbered)))


@query(f"WITH {_layout_sql(PAGES_SQL)} SELECT block_no::BIGINT AS block_no, key, value FROM laid")
def sst_block_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text(blocks.decode_blocks(blocks.encode_blocks(pages_numbered(spark, sf_dir))))


@query(f"SELECT key, value FROM ({ORDERS_SQL}) WHERE key >= '{RANGE_KEYS[0]}' AND key < '{RANGE_KEYS[1]}'")
def sst_file_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes sorted-table files, then reads a key range of them, with block pruning where pushdown is on."""
    spark.dataSource.register(SortedTableSource)
    path = fresh_path(spark, "sst")
    rows = orders_map(spark, sf_dir).rows
    rows.repartitionByRange(4, "key").sortWithinPartitions("key").write.format("sorted_table").mode("append").option("block_bytes", 4096).save(path)
    low, high = (F.lit(k.encode()) for k in RANGE_KEYS)
    return _text(load(spark, path).filter((F.col("key") >= low) & (F.col("key") < high)))


@query(f"WITH {_layout_sql(PAGES_SQL)}, firsts AS (SELECT block_no, min(key) AS divider FROM laid GROUP BY block_no) SELECT f.block_no::BIGINT AS block_no, divider, coalesce(sum(size) OVER (ORDER BY f.block_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start, size::BIGINT AS size, size::BIGINT AS n_bytes FROM firsts f JOIN sizes USING (block_no)")
def memtable_flush(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _table(spark, sf_dir, "pages")
    rows = OrderedMap.of(p, F.concat_ws("#", "url", padded(F.col("page_id"))), F.col("html")).rows
    flushed = lsm.flush(rows, ENTRIES_PER_BLOCK)
    return _text(flushed.select("block_no", "divider", F.col("offset").alias("start"), "size", F.octet_length("block").cast("long").alias("n_bytes")))


# Log


def events_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four events make a transaction: signup deletes, error aborts, anything else puts; one without an error commits."""
    e = _table(spark, sf_dir, "events")
    txn = F.floor(F.col("event_id") / 4).cast("long")
    kind = F.when(F.col("event_type") == "error", ABORT).when(F.col("event_type") == "signup", DELETE).otherwise(PUT)
    value = F.when(kind == PUT, F.concat_ws(":", "event_type", F.col("event_id").cast("string"))).otherwise(F.lit(""))
    key = F.when(kind == ABORT, F.lit("")).otherwise(padded(F.col("user_id")))
    rows = e.select((F.col("event_id") * 2).alias("seq"), txn.alias("txn_id"), kind.cast("int").alias("type"), key.cast("binary").alias("key"), value.cast("binary").alias("value"))
    ends = rows.groupBy("txn_id").agg((F.max("seq") + 1).alias("seq"), F.max((F.col("type") == ABORT).cast("int")).alias("bad")).filter("bad = 0")
    empty = F.lit("").cast("binary")
    return rows.unionByName(ends.select("seq", "txn_id", F.lit(COMMIT).alias("type"), empty.alias("key"), empty.alias("value")))


LOG_SQL = """
    ev AS (SELECT event_id * 2 AS seq, event_id // 4 AS txn_id, CASE event_type WHEN 'error' THEN 4 WHEN 'signup' THEN 2 ELSE 1 END AS type,
        CASE WHEN event_type = 'error' THEN '' ELSE lpad(user_id::VARCHAR, 12, '0') END AS key,
        CASE WHEN event_type IN ('error', 'signup') THEN '' ELSE event_type || ':' || event_id::VARCHAR END AS value FROM events),
    ends AS (SELECT max(seq) + 1 AS seq, txn_id, 3 AS type, '' AS key, '' AS value FROM ev GROUP BY txn_id HAVING bool_and(type <> 4)),
    log AS (SELECT * FROM ev UNION ALL SELECT * FROM ends),
    done AS (SELECT txn_id, seq AS commit_seq FROM ends)"""


@query(f"WITH {LOG_SQL} SELECT type::INTEGER AS type, CASE type WHEN 1 THEN 'PUT' WHEN 2 THEN 'DELETE' WHEN 3 THEN 'COMMIT' ELSE 'ABORT' END AS label, count(*)::BIGINT AS n FROM log GROUP BY type")
def wal_type_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_log(spark, sf_dir).groupBy("type").agg(F.count("*").alias("n")).select("type", wal.type_label(F.col("type")).alias("label"), "n")


@query(f"WITH {LOG_SQL} SELECT seq, (8 + 9 + 1 + 1 + strlen(key) + strlen(value))::BIGINT AS n_bytes FROM log")
def wal_frame_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_log(spark, sf_dir).select("seq", frame_size(F.octet_length("key").cast("long"), F.octet_length("value").cast("long")).cast("long").alias("n_bytes"))


_BYTES = "list_transform(list_filter(string_split({0}, ''), lambda c: c <> ''), lambda c: unicode(c)::BIGINT)"
# The published reflected polynomial, a bit at a time; keys and values are of ASCII and shorter than 128 bytes.
_CRC_SQL = f"""
    payload AS (SELECT seq, list_transform(range(0, 8), lambda i: (txn_id::BIGINT >> (8 * i)::BIGINT) & 255) || [type::BIGINT, strlen(key)::BIGINT, strlen(value)::BIGINT] || {_BYTES.format("key")} || {_BYTES.format("value")} AS b FROM log),
    crcs AS (SELECT seq, xor(4294967295, list_reduce(b, lambda c, x: list_reduce(range(0, 8), lambda r, i: xor(r >> 1, 3988292384 * (r & 1)), xor(c, x)), 4294967295)) AS crc FROM payload)"""


@query(f"WITH {LOG_SQL}, {_CRC_SQL} SELECT seq, crc::BIGINT AS crc FROM crcs")
def wal_crc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wal.payload_checksums(events_log(spark, sf_dir))


@query(f"WITH {LOG_SQL} SELECT seq, txn_id::BIGINT AS txn_id, type::INTEGER AS type, key, value FROM log")
def wal_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text(wal.decode_frames(wal.encode_frames(events_log(spark, sf_dir))))


@query(f"WITH {LOG_SQL} SELECT type::INTEGER AS type, count(*)::BIGINT AS n, count(DISTINCT txn_id)::BIGINT AS n_txn, sum(strlen(key) + strlen(value))::BIGINT AS n_bytes FROM log GROUP BY type")
def wal_file_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Appends the log to frame files, then scans them."""
    spark.dataSource.register(LogSource)
    path = fresh_path(spark, "wal")
    events_log(spark, sf_dir).select("txn_id", "type", "key", "value").write.format("wal_frames").mode("append").save(path)
    read = spark.read.format("wal_frames").load(path)
    n_bytes = F.sum(F.octet_length("key").cast("long") + F.octet_length("value").cast("long"))
    return read.groupBy("type").agg(F.count("*").alias("n"), F.countDistinct("txn_id").alias("n_txn"), n_bytes.alias("n_bytes"))


@query("SELECT n, CASE WHEN n < 128 THEN 1 WHEN n < 16384 THEN 2 WHEN n < 2097152 THEN 3 WHEN n < 268435456 THEN 4 ELSE 5 END::INTEGER AS n_bytes FROM (SELECT DISTINCT o_orderkey * o_custkey % 4294967296 AS n FROM orders)")
def varint_len(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = (F.col("o_orderkey") * F.col("o_custkey")) % (1 << 32)
    return _table(spark, sf_dir, "orders").select(n.alias("n")).distinct().select("n", varint_length(F.col("n")).alias("n_bytes"))


LOG_PARTS = 8


# Membership


@query("""
WITH s AS (SELECT DISTINCT p_size AS n, r.rate FROM part, (VALUES (0.0), (0.001), (0.01), (0.1), (1.0)) r(rate)),
b AS (SELECT n::BIGINT AS n, rate::DOUBLE AS rate, greatest(1, ceil(-n::DOUBLE * ln(CASE WHEN rate <= 0 THEN 1e-9 WHEN rate >= 1 THEN 0.999999 ELSE rate END::DOUBLE) / (ln(2.0::DOUBLE) * ln(2.0::DOUBLE))))::BIGINT AS bits FROM s)
SELECT n, rate, bits, greatest(1, floor(bits::DOUBLE / n::DOUBLE * ln(2.0::DOUBLE) + 0.5))::BIGINT AS hashes FROM b""")
def bloom_sizing(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _table(spark, sf_dir, "part").select(F.col("p_size").cast("long").alias("n")).distinct()
    sized = n.withColumn("rate", F.explode(F.array(*[F.lit(x) for x in (0.0, 0.001, 0.01, 0.1, 1.0)]))).withColumn("bits", bloom.size_bits_column(F.col("n"), F.col("rate")))
    return sized.withColumn("hashes", bloom.hash_count_column(F.col("n"), F.col("bits")))


@query("SELECT l_orderkey, l_linenumber, count(*)::BIGINT AS n FROM lineitem WHERE EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderpriority = '1-URGENT') GROUP BY ALL")
def bloom_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    urgent = _table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").select(padded(F.col("o_orderkey")).cast("binary").alias("key"))
    lines = _table(spark, sf_dir, "lineitem").select(padded(F.col("l_orderkey")).cast("binary").alias("key"), "l_orderkey", "l_linenumber")
    return bloom.semi_join(lines, urgent, "key").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"))


@query("SELECT true AS none_missed, true AS rate_holds")
def bloom_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All keys are found, and of as many absent ones at most 1.8 times the asked-for rate of 0.01."""
    o = _table(spark, sf_dir, "orders")
    present = o.select(padded(F.col("o_orderkey")).cast("binary").alias("key"))
    absent = o.select(F.concat(padded(F.col("o_orderkey")), F.lit("!")).cast("binary").alias("key"))
    built = bloom.build(present, "key", rate=0.01)
    hits = bloom.probe(present, "key", built).agg(F.min(F.col("maybe").cast("int")).alias("least"))
    false = bloom.probe(absent, "key", built).agg(F.avg(F.col("maybe").cast("int")).alias("rate"))
    return hits.crossJoin(false).select((F.col("least") == 1).alias("none_missed"), (F.col("rate") <= 0.018).alias("rate_holds"))


U64 = "18446744073709551616::UHUGEINT"


def _hash_sql(keys: str) -> str:
    """h: the two hashes of each key of twelve ASCII bytes, in arithmetic modulo 2^64."""

    def word(start: int, n: int) -> str:
        return " + ".join(f"unicode(substr(key, {start + i + 1}, 1))::UHUGEINT * {1 << 8 * i}::UHUGEINT" for i in range(n))

    stirred = lambda x, shift, factor: f"(xor({x}, {x} >> {shift}) * {factor}::UHUGEINT) % {U64}"
    return f"""
    h0 AS (SELECT key, name, xor(seed::UHUGEINT, ({bloom.GOLDEN} + 12)::UHUGEINT) AS x FROM ({keys}), (VALUES ('start', {bloom.SEED_START}::UHUGEINT), ('step', {bloom.SEED_STEP}::UHUGEINT)) s(name, seed)),
    h1 AS (SELECT key, name, (x + {word(0, 8)} + {bloom.GOLDEN}::UHUGEINT) % {U64} AS x FROM h0),
    h2 AS (SELECT key, name, {stirred("x", 30, bloom.MIX_A)} AS x FROM h1),
    h3 AS (SELECT key, name, {stirred("x", 27, bloom.MIX_B)} AS x FROM h2),
    h4 AS (SELECT key, name, (x + {word(8, 4)}) % {U64} AS x FROM h3),
    h5 AS (SELECT key, name, {stirred("x", 30, bloom.MIX_A)} AS x FROM h4),
    h6 AS (SELECT key, name, {stirred("x", 27, bloom.MIX_B)} AS x FROM h5),
    h AS (SELECT key, max(xor(x, x >> 31)) FILTER (name = 'start') AS a, max((xor(x, x >> 31) * 2::UHUGEINT) % {U64} + 1::UHUGEINT) FILTER (name = 'step') AS step FROM h6 GROUP BY key)"""


FILTER_KEYS = 1000
_BITS, _K = bloom.size_bits(FILTER_KEYS, 0.01), bloom.hash_count(FILTER_KEYS, bloom.size_bits(FILTER_KEYS, 0.01))
_PLACES_SQL = f"""
    places(key, i, spot, step) AS (SELECT key, 0, a % {_BITS}::UHUGEINT, step FROM h UNION ALL SELECT key, i + 1, ((spot + step) % {U64}) % {_BITS}::UHUGEINT, step FROM places WHERE i + 1 < {_K})"""


@query(f"WITH RECURSIVE {_hash_sql('SELECT key FROM (' + ORDERS_SQL + ')')}, {_PLACES_SQL} SELECT key, i::INTEGER AS i, spot::BIGINT AS place FROM places")
def bloom_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The places of every key's bits in a filter for a thousand keys."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = bloom.positions(b.column(0).to_pylist(), _BITS, _K)
            which = np.repeat(np.arange(len(at)), _K)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(which)), pa.array(np.tile(np.arange(_K, dtype=np.int32), len(at))), pa.array(at.ravel())], ["key", "i", "place"])

    return _text(orders_map(spark, sf_dir).rows.select("key").mapInArrow(places, "key binary, i int, place long"))


_HEAD = fixed32(bloom.HEADER_MAGIC) + fixed32(bloom.HEADER_VERSION) + _BITS.to_bytes(8, "little") + fixed32(_K) + fixed32(0)


@query(f"""
WITH RECURSIVE {_hash_sql('SELECT key FROM (' + CUSTOMERS_SQL + ')')}, {_PLACES_SQL},
bits AS (SELECT DISTINCT spot::BIGINT AS spot FROM places),
data AS (SELECT spot // 8 AS byte, sum(1 << (spot % 8)) AS value FROM bits GROUP BY byte),
head AS (SELECT unnest({list(_HEAD)}) AS value, unnest(range(0, {len(_HEAD)})) AS place)
SELECT place::BIGINT AS place, value::INTEGER AS value FROM head
UNION ALL SELECT b.byte + {len(_HEAD)}, coalesce(d.value, 0)::INTEGER FROM (SELECT unnest(range(0, {(_BITS + 7) // 8})) AS byte) b LEFT JOIN data d ON d.byte = b.byte""")
def bloom_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bytes of the customers' filter, serialised, read and serialised again."""
    built = bloom.build(customers_map(spark, sf_dir).rows, "key", expected=FILTER_KEYS)
    data = bloom.BloomFilter.deserialize(built.serialize()).serialize()
    return spark.createDataFrame(list(enumerate(data)), "place long, value int")


# Files

LIFECYCLE_SQL = "SELECT string_agg(r_name, ',' ORDER BY r_regionkey) AS names FROM region"


@query(f"""
WITH t AS ({LIFECYCLE_SQL})
SELECT unnest(['exists before', 'open before', 'written', 'first four bytes', 'the rest', 'at two', 'renamed', 'old name', 'new content', 'deleted', 'deleted again', 'exists after']) AS step,
    unnest(['False', 'None', 'True', names[1:4], names[5:], names[3:7], 'True', 'False', names, 'True', 'True', 'False']) AS outcome FROM t""")
def file_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file of the regions' names is made, read, moved over another and removed."""
    files, path = FileManager(spark), fresh_path(spark, "file")
    names = ",".join(r["r_name"] for r in _table(spark, sf_dir, "region").orderBy("r_regionkey").collect()).encode()
    steps = [("exists before", files.exists(path)), ("open before", files.open(path))]
    with files.create(path) as f:
        steps.append(("written", f.write(names[:7]) and f.write(names[7:]) and f.flush() and f.sync()))
    with files.open(path) as r:
        steps += [("first four bytes", r.read(4)), ("the rest", r.read(1 << 20)), ("at two", r.read_at(2, 5))]
    with files.create(f"{path}.other") as f:
        f.write(b"to be replaced")
    steps += [("renamed", files.rename(path, f"{path}.other")), ("old name", files.exists(path))]
    with files.open(f"{path}.other") as r:
        steps.append(("new content", r.read(1 << 20)))
    steps += [("deleted", files.delete(f"{path}.other")), ("deleted again", files.delete(f"{path}.other")), ("exists after", files.exists(f"{path}.other"))]
    return spark.createDataFrame([(step, x.decode() if isinstance(x, bytes) else str(x)) for step, x in steps], "step string, outcome string")


@query(f"WITH p AS (SELECT DISTINCT lpad((user_id * 3)::VARCHAR, 12, '0') AS key FROM events) SELECT p.key, m.value FROM p JOIN ({ORDERS_SQL}) m ON m.key = p.key")
def sst_point_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys looked up in sorted-table files: filter, index, then the restart points of one block."""
    spark.dataSource.register(SortedTableSource)
    path = fresh_path(spark, "sst")
    orders_map(spark, sf_dir).rows.repartitionByRange(4, "key").sortWithinPartitions("key").write.format("sorted_table").mode("append").option("block_bytes", 4096).save(path)
    probes = _table(spark, sf_dir, "events").select(padded(F.col("user_id") * 3).cast("binary").alias("key")).distinct()
    return _text(lookup(probes, path))


@query(f"SELECT key, value FROM ({ORDERS_SQL}) WHERE key IN ('{GET_KEY}', '{SEEK_KEY}')")
def sst_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equality reaches the files' filters and indexes; one of the keys is in none."""
    spark.dataSource.register(SortedTableSource)
    path = fresh_path(spark, "sst")
    orders_map(spark, sf_dir).rows.repartitionByRange(4, "key").sortWithinPartitions("key").write.format("sorted_table").mode("append").option("block_bytes", 4096).save(path)
    one, other = (load(spark, path).filter(F.col("key") == F.lit(k.encode())) for k in (GET_KEY, SEEK_KEY))
    return _text(one.unionAll(other))


# Beyond the base: replay and merges


@query(f"WITH {LOG_SQL} SELECT l.seq, l.txn_id::BIGINT AS txn_id, l.type::INTEGER AS type, l.key, l.value, d.commit_seq FROM log l JOIN done d USING (txn_id) WHERE l.type IN (1, 2)")
def wal_replay_committed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text(lsm.committed_changes(events_log(spark, sf_dir)).select("seq", "txn_id", "type", "key", "value", "commit_seq"))


def _replay_sql(condition: str) -> str:
    return f"WITH {LOG_SQL}, w AS (SELECT l.*, row_number() OVER (PARTITION BY l.key ORDER BY d.commit_seq DESC, l.seq DESC) AS place FROM log l JOIN done d USING (txn_id) WHERE l.type IN (1, 2) AND {condition}) SELECT key, value FROM w WHERE place = 1 AND type = 1"


@query(_replay_sql("true"))
def wal_replay_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text(lsm.replay(events_log(spark, sf_dir)))


@query(_replay_sql("true"))
def wal_stream_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log is appended in parts, read as a stream of frame files, and its committed changes are folded."""
    spark.dataSource.register(LogSource)
    path, out = fresh_path(spark, "wal"), fresh_path(spark, "replayed")
    log = events_log(spark, sf_dir)
    last = log.agg(F.max("seq")).first()[0] or 0
    for i in range(LOG_PARTS):
        part = log.filter((F.col("seq") > last * i // LOG_PARTS - (i == 0)) & (F.col("seq") <= last * (i + 1) // LOG_PARTS))
        part.coalesce(1).sortWithinPartitions("seq").select("txn_id", "type", "key", "value").write.format("wal_frames").mode("append").option("prefix", f"part{i}").save(path)
    frames = spark.readStream.format("wal_frames").load(path)
    # A record's place in the log: its file's, then its own in the file.
    rows = frames.select((F.substring("file", 5, 1).cast("long") * (1 << 40) + F.col("offset")).alias("seq"), "txn_id", "type", "key", "value")
    changes = streaming.committed_stream(rows)
    changes.writeStream.format("parquet").option("checkpointLocation", fresh_path(spark, "replay-state")).trigger(availableNow=True).start(out).awaitTermination()
    return _text(streaming.fold(spark.read.schema(changes.schema).parquet(out)))


@query(_replay_sql(f"d.commit_seq <= (SELECT max(event_id) FROM events) * 2 // {SNAPSHOT_SHARE}"))
def mvcc_snapshot_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = _table(spark, sf_dir, "events").agg(F.max("event_id")).first()[0] or 0
    return _text(lsm.replay(events_log(spark, sf_dir), until=last * 2 // SNAPSHOT_SHARE))


def three_levels(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Newest first: late events (signup deletes), early events, customers."""
    e = events_batch(spark, sf_dir).withColumn("is_deleted", F.col("value").cast("string").startswith("signup"))

    def level(part: int) -> DataFrame:
        return e.filter(F.col("seq") % 2 == part).groupBy("key").agg(F.max_by(F.struct("value", "is_deleted"), "seq").alias("n")).select("key", "n.value", "n.is_deleted")

    return [level(1), level(0), customers_map(spark, sf_dir).rows.withColumn("is_deleted", F.lit(False))]


LEVELS_SQL = f"""
    e AS (SELECT key, value, seq, value LIKE 'signup%' AS is_deleted, seq % 2 AS part FROM ({EVENTS_SQL})),
    n AS (SELECT key, value, is_deleted, part, row_number() OVER (PARTITION BY part, key ORDER BY seq DESC) AS p FROM e),
    levels AS (SELECT key, value, is_deleted, CASE WHEN part = 1 THEN 0 ELSE 1 END AS age FROM n WHERE p = 1 UNION ALL SELECT key, value, false, 2 FROM ({CUSTOMERS_SQL}))"""


@query(f"WITH {LEVELS_SQL}, m AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY age) AS place FROM levels) SELECT key, value FROM m WHERE place = 1 AND NOT is_deleted")
def lsm_merge_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text(lsm.live(three_levels(spark, sf_dir)))


@query(f"WITH {LEVELS_SQL}, m AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY age) AS place FROM levels WHERE age < 2) SELECT key, value, is_deleted, false AS bottom FROM m WHERE place = 1 UNION ALL SELECT key, value, is_deleted, true FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY age) AS place FROM levels) WHERE place = 1 AND NOT is_deleted")
def compact_drop_tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The upper two levels keep their tombstones; all three together drop them."""
    levels = three_levels(spark, sf_dir)
    upper = lsm.compact(levels[:2], bottom=False).withColumn("bottom", F.lit(False))
    return _text(upper.unionByName(lsm.compact(levels, bottom=True).withColumn("bottom", F.lit(True))))
