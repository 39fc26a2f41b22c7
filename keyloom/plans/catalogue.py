"""Registered queries over the given tables, each with SQL that another engine runs on the same tables.

The log of most queries comes from events: the key is a digest of user_id, seq is event_id, the value joins key, type and properties.
Inside, keys are BINARY; results show them as upper-case hex.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keyloom.errors import Code, StoreError
from keyloom.functions import codec
from keyloom.functions.routing import hash_partition, shard_of
from keyloom.operators import checks, recovery, shared, views
from keyloom.operators.store import Store
from keyloom.plans import workload
from keyloom.sources import raw, records
from keyloom.streaming import latest as streaming

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

#: Bytes of a value slot where the given tables' short values are stored.
SLOT = 256
LOW, HIGH = bytes.fromhex("4000000000000000"), bytes.fromhex("8000000000000000")

#: The log in SQL, and its latest view.
SQL_LOG = "WITH log AS (SELECT upper(substr(md5(CAST(user_id AS VARCHAR)), 1, 16)) AS k, event_id AS seq, concat(upper(substr(md5(CAST(user_id AS VARCHAR)), 1, 16)), '|', event_type, '|', props) AS v FROM events), "
SQL_LATEST = SQL_LOG + "latest AS (SELECT k, max(seq) AS seq, arg_max(v, seq) AS v FROM log GROUP BY k) "
SQL_SHARD = "(CAST(concat('0x', substr(k, 1, 4)) AS INTEGER) >> 6)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = codec.digest_key("user_id")
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "props").withColumn("key", key)
    return rows.select("key", F.col("event_id").alias("seq"), F.concat(F.hex("key"), F.lit("|"), "event_type", F.lit("|"), "props").alias("value"))


def asked_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys to look up: all customers, some of whom have events."""
    return table(spark, sf_dir, "customer").select(codec.digest_key("c_custkey").alias("key"))


def rows_of(view: DataFrame) -> DataFrame:
    """k, seq, v (and pos, if there)."""
    return view.select(F.hex("key").alias("k"), "seq", F.col("value").alias("v"), *(["pos"] if "pos" in view.columns else []))


def scratch(spark: SparkSession, name: str) -> str:
    """A folder of its own for a store, below the shared folder that the session names. Without one, a local session has a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise StoreError(Code.INVALID_ARGUMENT, "spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='keyloom-')}"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


@query(SQL_LATEST + "SELECT k, seq, v FROM latest")
def kv_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows_of(views.latest(events_log(spark, sf_dir)))


@query(SQL_LATEST + "SELECT k, seq FROM latest")
def kv_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.index(events_log(spark, sf_dir)).select(F.hex("key").alias("k"), "seq")


@query(SQL_LATEST + "SELECT k, seq, v FROM latest")
def kv_latest_by_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows_of(views.latest_by_join(events_log(spark, sf_dir)))


@query(SQL_LOG.rstrip(", ") + " SELECT k, seq, v FROM log")
def kv_index_trusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows_of(views.trusted(events_log(spark, sf_dir)))


@query(SQL_LATEST + "SELECT k, seq, v FROM latest WHERE k = upper(substr(md5('8'), 1, 16))")
def kv_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    import hashlib

    return rows_of(views.get(views.latest(events_log(spark, sf_dir)), hashlib.md5(b"8").digest()[:8]))


@query(SQL_LATEST + "SELECT count(*) AS n FROM latest WHERE k = '0000000000000000'")
def kv_get_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.get(views.latest(events_log(spark, sf_dir)), bytes(8)).agg(F.count("*").alias("n"))


SQL_ASKED = "asked AS (SELECT DISTINCT upper(substr(md5(CAST(c_custkey AS VARCHAR)), 1, 16)) AS k FROM customer) "


@query(SQL_LATEST + ", " + SQL_ASKED + "SELECT a.k, l.seq, l.v, CAST(l.seq IS NOT NULL AS BIGINT) AS found FROM asked a LEFT JOIN latest l ON a.k = l.k")
def kv_multi_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = views.multi_get(views.latest(events_log(spark, sf_dir)), asked_keys(spark, sf_dir))
    return found.select(F.hex("key").alias("k"), "seq", F.col("value").alias("v"), "found")


@query(SQL_LATEST + ", " + SQL_ASKED + "SELECT count(*) AS asked, CAST(count(l.k) AS BIGINT) AS hits, CAST(count(*) - count(l.k) AS BIGINT) AS misses FROM asked a LEFT JOIN latest l ON a.k = l.k")
def kv_hit_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.hit_count(views.multi_get(views.latest(events_log(spark, sf_dir)), asked_keys(spark, sf_dir)))


@query(SQL_LATEST + ", " + SQL_ASKED + "SELECT a.k FROM asked a SEMI JOIN latest l ON a.k = l.k")
def kv_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.found(views.index(events_log(spark, sf_dir)), asked_keys(spark, sf_dir).distinct()).select(F.hex("key").alias("k"))


@query(SQL_LATEST + ", " + SQL_ASKED + "SELECT a.k FROM asked a ANTI JOIN latest l ON a.k = l.k")
def kv_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.missing(views.index(events_log(spark, sf_dir)), asked_keys(spark, sf_dir).distinct()).select(F.hex("key").alias("k"))


def _ranged(spark: SparkSession, sf_dir: str, lower: bytes | None, upper: bytes | None) -> DataFrame:
    view = views.latest(events_log(spark, sf_dir))
    return rows_of(views.positioned(views.range_scan(view, lower, upper)))


def _range_sql(where: str) -> str:
    return SQL_LATEST + f"SELECT k, seq, v, CAST(row_number() OVER (ORDER BY k) - 1 AS BIGINT) AS pos FROM latest WHERE {where}"


@query(_range_sql("k >= '4000000000000000' AND k < '8000000000000000'"))
def kv_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranged(spark, sf_dir, LOW, HIGH)


@query(_range_sql("k >= '8000000000000000'"))
def kv_range_from(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranged(spark, sf_dir, HIGH, None)


@query(_range_sql("k < '8000000000000000'"))
def kv_range_to(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranged(spark, sf_dir, None, HIGH)


@query(_range_sql("true"))
def kv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranged(spark, sf_dir, None, None)


@query(SQL_LATEST + "SELECT count(*) AS n FROM latest WHERE k >= '8000000000000000' AND k < '4000000000000000'")
def kv_range_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.latest(events_log(spark, sf_dir)).filter((F.col("key") >= F.lit(HIGH)) & (F.col("key") < F.lit(LOW))).agg(F.count("*").alias("n"))


@query(SQL_LOG.rstrip(", ") + f" SELECT CAST({SQL_SHARD} AS BIGINT) AS shard, count(*) AS records, count(*) * 12 AS log_bytes, count(*) * 4096 AS value_bytes FROM log GROUP BY 1")
def kv_shard_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.shard_stats(events_log(spark, sf_dir))


@query(SQL_LATEST + "SELECT CAST(CASE WHEN b > 127 THEN 256 - b ELSE b END % 16 AS BIGINT) AS part, count(*) AS n FROM (SELECT CAST(concat('0x', substr(k, 1, 2)) AS INTEGER) AS b FROM latest) GROUP BY 1")
def kv_hash_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.partition_counts(views.latest(events_log(spark, sf_dir)), 16)


@query(SQL_LOG.rstrip(", ") + f" SELECT k, CAST({SQL_SHARD} AS BIGINT) AS shard, seq AS event_id, CAST(row_number() OVER (PARTITION BY {SQL_SHARD} ORDER BY seq) - 1 AS BIGINT) AS seq, CAST((row_number() OVER (PARTITION BY {SQL_SHARD} ORDER BY seq) - 1) * 4096 AS BIGINT) AS byte_offset FROM log")
def kv_seq_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events_log(spark, sf_dir).select("key", F.col("seq").alias("event_id"))
    return views.sequenced(rows, "event_id").select(F.hex("key").alias("k"), "shard", "event_id", "seq", F.col("offset").alias("byte_offset"))


@query(SQL_LOG.rstrip(", ") + " SELECT count(*) AS \"rows\", count(DISTINCT k) AS live, count(*) - count(DISTINCT k) AS shadowed FROM log")
def kv_dedup_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.dedup_stats(events_log(spark, sf_dir))


VISITORS = [
    shared.Visitor("all", None, None, {"n": F.count_if, "max_seq": lambda inside: F.max(F.when(inside, F.col("seq")))}),
    shared.Visitor("low", None, HIGH, {"n": F.count_if, "bytes": lambda inside: F.coalesce(F.sum(F.when(inside, F.octet_length("value"))), F.lit(0)).cast("bigint")}),
    shared.Visitor("mid", LOW, bytes.fromhex("C000000000000000"), {"n": F.count_if, "first": lambda inside: F.min(F.when(inside, F.hex("key")))}),
]


@query(
    SQL_LATEST + "SELECT count(*) AS all_n, max(seq) AS all_max_seq, count(*) FILTER (k < '8000000000000000') AS low_n, CAST(coalesce(sum(strlen(v)) FILTER (k < '8000000000000000'), 0) AS BIGINT) AS low_bytes, "
    "count(*) FILTER (k >= '4000000000000000' AND k < 'C000000000000000') AS mid_n, min(k) FILTER (k >= '4000000000000000' AND k < 'C000000000000000') AS mid_first FROM latest"
)
def kv_shared_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared.visit(views.latest(events_log(spark, sf_dir)), VISITORS)


@query(
    SQL_LATEST + ", r AS (SELECT 'arrival' AS what, k, lag(k) OVER (ORDER BY seq) AS p FROM log UNION ALL SELECT 'snapshot', k, lag(k) OVER (ORDER BY k) FROM latest) "
    "SELECT what, CAST(count(*) FILTER (p >= k) AS BIGINT) AS violations, count(*) AS n FROM r GROUP BY 1"
)
def kv_order_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a snapshot's rows as they lie in its files, and of the log in the order of its arrival, which is not that of the keys."""
    store = _store(spark, sf_dir)
    name = store.compact()
    found = spark.read.parquet(store.files.uri(f"snapshot/{name}/rows")).select("key", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("at"))
    sizes = found.groupBy("file").agg(F.count("*").alias("n"))  # a row a file
    starts = sizes.select("file", (F.sum("n").over(Window.orderBy("file")) - F.col("n")).alias("start"))
    stored = found.join(starts, "file").select("key", (F.col("start") + F.col("at")).alias("pos"))
    arrived = views.ranked(events_log(spark, sf_dir).select("key", "seq"), F.col("seq"), ["seq"]).select("key", "pos")
    both = {"snapshot": stored, "arrival": arrived}
    return reduce(DataFrame.unionByName, [checks.order_violations(rows).select(F.lit(what).alias("what"), "violations", "n") for what, rows in both.items()])


@query(
    "SELECT CAST(count(*) FILTER (substr(md5(CAST(user_id AS VARCHAR)), 1, 16) <> substr(md5(CAST(user_id + CASE WHEN event_id % 10 = 0 THEN 1 ELSE 0 END AS VARCHAR)), 1, 16)) AS BIGINT) AS mismatches, count(*) AS n FROM events"
)
def kv_prefix_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that begin with a key's bytes; every tenth begins with those of another key."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    written = codec.digest_key(F.col("user_id") + F.when(F.col("event_id") % 10 == 0, 1).otherwise(0))
    return checks.prefix_mismatches(e.select(codec.digest_key("user_id").alias("key"), F.concat(written, F.encode("event_type", "UTF-8")).alias("value")))


@query(SQL_LATEST + "SELECT CAST(count(*) FILTER (strlen(v) <> 64) AS BIGINT) AS mismatches, count(*) AS n FROM latest")
def kv_length_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.length_mismatches(views.latest(events_log(spark, sf_dir)), 64)


@query(SQL_LATEST + "SELECT CAST(pos // 16 AS BIGINT) AS page, k FROM (SELECT k, row_number() OVER (ORDER BY k) - 1 AS pos FROM latest) WHERE pos % 16 = 0")
def kv_page_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.page_directory(views.index(events_log(spark, sf_dir)), 16).select("page", F.hex("key").alias("k"))


@query(
    SQL_LATEST + ", q AS (SELECT DISTINCT upper(substr(md5(concat('q', CAST(s_suppkey AS VARCHAR))), 1, 16)) AS q FROM supplier) "
    "SELECT q.q, max(l.k) AS \"floor\" FROM q LEFT JOIN latest l ON l.k <= q.q GROUP BY q.q"
)
def kv_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "supplier").select(codec.digest_key(F.concat(F.lit("q"), F.col("s_suppkey").cast("string"))).alias("q")).distinct()
    return views.floor(views.index(events_log(spark, sf_dir)), asked).select(F.hex("q").alias("q"), F.hex("floor").alias("floor"))


@query(SQL_LATEST + "SELECT k, seq, v FROM latest")
def kv_recover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log that breaks off at nine tenths, and a tail that overlaps it."""
    log = events_log(spark, sf_dir)
    cut = log.agg(F.max("seq")).first()[0] * 9 // 10
    return rows_of(recovery.recovered(log.filter(F.col("seq") <= cut), log.filter(F.col("seq") > cut - 10)))


@query(SQL_LOG + "latest AS (SELECT k, max(seq) AS seq, arg_max(v, seq) AS v FROM log WHERE seq <= 5000 GROUP BY k) SELECT k, seq, v FROM latest")
def kv_as_of_seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows_of(views.as_of(events_log(spark, sf_dir), 5000))


@query("WITH log AS (SELECT upper(substr(md5(CAST(event_id AS VARCHAR)), 1, 16)) AS k FROM events), p AS (SELECT k, row_number() OVER (ORDER BY k) - 1 AS pos FROM log) SELECT CAST(pos // 256 AS BIGINT) AS batch, count(*) AS n, min(k) AS \"first\", max(k) AS \"last\" FROM p GROUP BY 1")
def kv_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = table(spark, sf_dir, "events").select(codec.digest_key("event_id").alias("key"))
    return views.batches(views.positioned(keys)).select("batch", "n", F.hex("first").alias("first"), F.hex("last").alias("last"))


@query("SELECT upper(substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 16)) AS k, CAST(2 * o_orderkey + 1 AS BIGINT) AS seq, concat(o_orderpriority, '!') AS v FROM orders")
def kv_double_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(codec.digest_key("o_orderkey").alias("key"), "o_orderkey", "o_orderpriority")
    return rows_of(views.latest(workload.double_write(rows, "o_orderkey", F.col("o_orderpriority"), F.concat("o_orderpriority", F.lit("!")))))


@query("SELECT CAST(user_id AS BIGINT) AS k, max(event_id) AS seq, arg_max(event_type, event_id) AS v FROM events GROUP BY 1")
def kv_stream_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table's files as a stream whose micro-batches are appended to a store; the store's view."""
    source, path = table(spark, sf_dir, "events"), f"{sf_dir}/events.parquet"
    reader = spark.readStream.schema(source.schema)
    stream = reader.parquet(path) if _is_folder(spark, path) else reader.option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    key = F.unhex(F.lpad(F.hex(F.col("user_id").cast("bigint")), 16, "0"))
    store = Store.open(spark, scratch(spark, "stream"))
    streaming.merge_batches(stream.select(key.alias("key"), F.col("event_id").alias("seq"), F.encode("event_type", "UTF-8").alias("value")), store, scratch(spark, "stream-at"))
    return store.view().select(codec.key_to_long("key").alias("k"), "seq", F.decode("value", "UTF-8").alias("v"))


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def _store(spark: SparkSession, sf_dir: str) -> Store:
    """A store with the events' log in two batches and a snapshot of the first."""
    store, log = Store.open(spark, scratch(spark, "store")), events_log(spark, sf_dir)
    half = log.agg(F.max("seq")).first()[0] // 2
    store.write(log.filter(F.col("seq") <= half))
    store.compact()
    store.write(log.filter(F.col("seq") > half))
    store.refresh()
    return store


@query(SQL_LATEST + "SELECT k, seq, v FROM latest WHERE k >= '4000000000000000' AND k < '8000000000000000'")
def kv_store_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written, compacted, written again, and read in a range from the sorted run and the newer batch."""
    return rows_of(_store(spark, sf_dir).range(LOW, HIGH)).withColumn("v", F.decode("v", "UTF-8"))


@query(SQL_LATEST + "SELECT k, seq, v FROM latest")
def kv_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _store(spark, sf_dir)
    store.compact()
    return rows_of(store.view()).withColumn("v", F.decode("v", "UTF-8"))


@query(SQL_LOG.rstrip(", ") + f" SELECT k, CAST({SQL_SHARD} AS BIGINT) AS shard, CAST(row_number() OVER (PARTITION BY {SQL_SHARD} ORDER BY seq) - 1 AS BIGINT) AS seq FROM log")
def kv_raw_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All shards, written as raw 12-byte records, one file each with a zero tail, read back by the data source, which trims the tails."""
    rows = events_log(spark, sf_dir).select("key", F.col("seq").alias("event_id"))
    folder = scratch(spark, "raw")
    raw.write_records(views.sequenced(rows, "event_id"), folder, grow=64)
    records.register(spark)
    return spark.read.format("wal12").load(folder).select(F.hex("key").alias("k"), shard_of("key").alias("shard"), "seq")


@query(SQL_LATEST + "SELECT k, v FROM latest")
def kv_value_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys in a raw log and values in slots of all shards; the log's last sequence of a key is where its value is read."""
    rows = views.sequenced(events_log(spark, sf_dir).withColumnRenamed("seq", "event_id"), "event_id")
    folder = scratch(spark, "values")
    raw.write_records(rows, folder, grow=64)
    raw.write_values(rows, folder, width=SLOT)
    records.register(spark)
    found = views.index(spark.read.format("wal12").load(folder)).select("key", shard_of("key").alias("shard"), "seq")
    values = raw.read_values(found, folder, width=SLOT)
    return values.select(F.hex("key").alias("k"), F.rtrim(F.decode("value", "UTF-8"), F.lit("\0")).alias("v"))


LE4 = "concat(substr(lpad(to_hex({0}), 8, '0'), 7, 2), substr(lpad(to_hex({0}), 8, '0'), 5, 2), substr(lpad(to_hex({0}), 8, '0'), 3, 2), substr(lpad(to_hex({0}), 8, '0'), 1, 2))"


@query(
    f"SELECT event_id, upper({LE4.format('event_id')}) AS le4, event_id AS back, upper(substr(md5(CAST(event_id AS VARCHAR)), 1, 16)) AS k, "
    "CAST(CASE WHEN u >= 9223372036854775808 THEN u - 18446744073709551616 ELSE u END AS BIGINT) AS as_long, CAST(event_id * 4096 AS BIGINT) AS byte_offset "
    "FROM (SELECT event_id, CAST(CAST(concat('0x', substr(md5(CAST(event_id AS VARCHAR)), 1, 16)) AS UBIGINT) AS HUGEINT) AS u FROM events)"
)
def kv_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hex, sequences of 4 bytes, keys as numbers, value offsets."""
    e = table(spark, sf_dir, "events").select("event_id", codec.digest_key("event_id").alias("key"))
    le = codec.int_to_bytes("event_id")
    hexed = codec.to_hex(codec.from_hex(F.concat_ws(" ", F.substring(F.hex("key"), 1, 8), F.substring(F.hex("key"), 9, 8))))
    return e.select("event_id", F.hex(le).alias("le4"), codec.bytes_to_int(le).cast("bigint").alias("back"), hexed.alias("k"), codec.key_to_long("key").alias("as_long"), codec.value_offset("event_id").alias("byte_offset"))


def _sql_le(at: int, n: int) -> str:
    digits = ", ".join(f"substr(k, {2 * j + 1}, 2)" for j in range(at + n - 1, at - 1, -1))
    return f"CAST(CAST(concat('0x', {digits}) AS BIGINT) - CASE WHEN CAST(concat('0x', {digits}) AS BIGINT) >= {1 << (8 * n - 1)} THEN {1 << (8 * n)} ELSE 0 END AS BIGINT)"


@query(
    f"WITH s AS (SELECT c_custkey, upper(substr(md5(CAST(c_custkey AS VARCHAR)), 1, 16)) AS k FROM customer) SELECT c_custkey, {_sql_le(0, 1)} AS b, {_sql_le(1, 2)} AS s, {_sql_le(2, 4)} AS i, "
    "CAST(list_reduce(list_concat([CAST(8 AS BIGINT)], list_transform([1, 3, 5, 7, 9, 11, 13, 15], lambda p: (CAST(concat('0x', substr(k, p, 2)) AS BIGINT) + 128) % 256 - 128)), lambda h, x: (((h * 31 + x) % 4294967296) + 4294967296) % 4294967296) AS BIGINT) AS h32 FROM s"
)
def kv_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers inside a key, least significant byte first, and the hash of its bytes (here as an unsigned number)."""
    s = table(spark, sf_dir, "customer").select("c_custkey", codec.digest_key("c_custkey").alias("key"))
    h = codec.content_hash("key")
    return s.select("c_custkey", codec.read_little_endian("key", 0, "byte").cast("bigint").alias("b"), codec.read_little_endian("key", 1, "short").cast("bigint").alias("s"), codec.read_little_endian("key", 2, "int").cast("bigint").alias("i"), F.when(h < 0, h + (1 << 32)).otherwise(h).alias("h32"))


@query("SELECT p_size, CAST(16 + p_size AS BIGINT) AS bytes, CAST(16 + 2 * p_size AS BIGINT) AS shorts, CAST(16 + 4 * p_size AS BIGINT) AS ints, CAST(16 + 8 * p_size AS BIGINT) AS longs FROM (SELECT DISTINCT p_size FROM part)")
def kv_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = table(spark, sf_dir, "part").select("p_size").distinct()
    return sizes.select("p_size", *(codec.array_bytes("p_size", kind).alias(f"{kind}s") for kind in ("byte", "short", "int", "long")))


@query(SQL_LATEST + "SELECT k, CAST(u - 9223372036854775808 AS BIGINT) AS rank_value FROM (SELECT k, CAST(CAST(concat('0x', k) AS UBIGINT) AS HUGEINT) AS u FROM latest)")
def kv_unsigned_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys as numbers whose signed order is the keys' unsigned order."""
    return views.index(events_log(spark, sf_dir)).select(F.hex("key").alias("k"), codec.unsigned_order("key").alias("rank_value"))


@query(
    "SELECT c_custkey, concat(list_extract(['3F00', '3F40', '3F80', '3FC0', '4000', '4040'], CAST(c_custkey % 6 + 1 AS INTEGER)), upper(lpad(to_hex(c_custkey * 10000 + c_nationkey), 8, '0')), '0000') AS k, "
    "CAST(list_extract([252, 253, 254, 255, 256, 257], CAST(c_custkey % 6 + 1 AS INTEGER)) AS BIGINT) AS shard, CAST(list_extract([15, 15, 15, 15, 0, 0], CAST(c_custkey % 6 + 1 AS INTEGER)) AS BIGINT) AS part FROM customer"
)
def kv_structured_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_custkey", workload.structured_key(F.col("c_custkey"), F.col("c_nationkey")).alias("key"))
    return rows.select("c_custkey", F.hex("key").alias("k"), shard_of("key").alias("shard"), hash_partition("key", 16).cast("bigint").alias("part"))


@query(
    "WITH w AS (SELECT i // 250 AS writer, i, upper(substr(md5(concat(CAST(i // 250 AS VARCHAR), '/', CAST(i % 250 AS VARCHAR))), 1, 16)) AS k FROM range(2000) t(i)) "
    "SELECT k, max(i) AS seq, CAST(256 AS BIGINT) AS value_bytes FROM w GROUP BY k"
)
def kv_seeded_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight writers, each with keys from its own seed; every key is read back with a value that begins with it."""
    view = views.latest(workload.seeded(spark, 8, 250, 256))
    return view.filter(F.substring("value", 1, 8) == F.col("key")).select(F.hex("key").alias("k"), "seq", F.octet_length("value").cast("bigint").alias("value_bytes"))


@query(SQL_LATEST + "SELECT 'all' AS visitor, k, strlen(v) AS bytes FROM latest UNION ALL SELECT 'low', k, strlen(v) FROM latest WHERE k < '8000000000000000' UNION ALL SELECT 'mid', k, strlen(v) FROM latest WHERE k >= '4000000000000000' AND k < 'C000000000000000'")
def kv_visit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three visitors get the rows of their ranges in order on the executors, in one pass; each checks the order itself."""

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        last = [b""]

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            keys = [bytes(k) for k in batch.column("key").to_pylist()]
            for k in keys:
                if k <= last[0]:
                    raise ValueError("keys are out of order")
                last[0] = k
            sizes = [len(v.encode()) for v in batch.column("value").to_pylist()]
            return pa.RecordBatch.from_arrays([pa.array([k.hex().upper() for k in keys], pa.string()), pa.array(sizes, pa.int64())], names=["k", "bytes"])

        return step

    visitors = [shared.RowVisitor(v.name, v.lower, v.upper, make) for v in VISITORS]
    return shared.visit_rows(views.latest(events_log(spark, sf_dir)), visitors, "k string, bytes bigint")


@query(SQL_LATEST + "SELECT 'all' AS visitor, count(*) AS n FROM latest UNION ALL SELECT 'low', count(*) FILTER (k < '8000000000000000') FROM latest UNION ALL SELECT 'mid', count(*) FILTER (k >= '4000000000000000' AND k < 'C000000000000000') FROM latest")
def kv_timeout_ride(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three callers of a shared pass for 64: none is full, so the pass starts when the first has waited long enough."""
    ride = shared.Ride(views.latest(events_log(spark, sf_dir)), calls=64, seconds=0.05)
    with ThreadPoolExecutor(len(VISITORS)) as pool:
        got = list(pool.map(lambda v: (v.name, ride.submit(shared.Visitor(v.name, v.lower, v.upper))["n"]), VISITORS))
    ride.close()
    return spark.createDataFrame(got, "visitor string, n bigint")


@query("WITH log AS (SELECT upper(substr(md5(CAST(user_id AS VARCHAR)), 1, 16)) AS k, event_id // 100 AS seq, concat(event_type, '/', CAST(event_id AS VARCHAR)) AS v FROM events) SELECT k, seq, v FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC, v) AS r FROM log) WHERE r = 1")
def kv_tie_break(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of one key and sequence: the one with the least value stays."""
    e = table(spark, sf_dir, "events").select(codec.digest_key("user_id").alias("key"), F.floor(F.col("event_id") / 100).cast("bigint").alias("seq"), F.concat_ws("/", "event_type", F.col("event_id").cast("string")).alias("value"))
    return rows_of(views.latest(e))


@query("SELECT upper(substr(md5(CAST(c_custkey AS VARCHAR)), 1, 16)) AS k, CAST(0 AS BIGINT) AS found FROM customer")
def kv_empty_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store without a log: every key is looked up and none is there."""
    store = Store.open(spark, scratch(spark, "empty"))
    return store.multi_get(asked_keys(spark, sf_dir)).select(F.hex("key").alias("k"), "found")


@query(SQL_LOG + "half AS (SELECT max(seq) // 2 AS h FROM log), latest AS (SELECT k, max(seq) AS seq, arg_max(v, seq) AS v FROM log, half WHERE seq <= h GROUP BY k) SELECT k, seq, v, true AS unclean, CAST(1 AS BIGINT) AS removed FROM latest")
def kv_unclean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last batch loses its marker, as if its writer had died: it is noticed at open, not seen, and removed."""
    store, log = Store.open(spark, scratch(spark, "unclean")), events_log(spark, sf_dir)
    half = log.agg(F.max("seq")).first()[0] // 2
    store.write(log.filter(F.col("seq") <= half))
    store.files.delete(f"log/{store.write(log.filter(F.col('seq') > half))}/_SUCCESS")
    again = Store.open(spark, str(store.files.root))
    unclean, removed = again.unclean, len(again.recover())
    out = rows_of(again.view()).withColumn("v", F.decode("v", "UTF-8"))
    return out.withColumns({"unclean": F.lit(unclean), "removed": F.lit(removed).cast("bigint")})


@query(SQL_LATEST + "SELECT CAST(1 AS BIGINT) AS refused, count(*) AS reopened, true AS has_bytes, max(seq) AS last_seq FROM latest")
def kv_close_reopen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A closed store refuses to be read; opened again it has its rows, its size and its last sequence."""
    store, refused = _store(spark, sf_dir), 0
    store.close()
    try:
        store.view()
    except StoreError:
        refused = 1
    again = Store.open(spark, str(store.files.root))
    return again.view().agg(F.count("*").alias("reopened")).select(F.lit(refused).cast("bigint").alias("refused"), "reopened", F.lit(again.size() > 0).alias("has_bytes"), F.lit(again.log.last_seq()).cast("bigint").alias("last_seq"))


@query(SQL_LATEST + ", " + SQL_ASKED + "SELECT a.k, l.v FROM asked a JOIN latest l ON a.k = l.k")
def kv_bucket_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lookups by an internal bucket first and the key inside it."""
    view, asked = views.latest(events_log(spark, sf_dir)), asked_keys(spark, sf_dir).distinct()
    there, wanted = (x.withColumn("bucket", views.bucketed(x, 256)) for x in (view, asked))
    return wanted.join(there, ["bucket", "key"]).select(F.hex("key").alias("k"), F.col("value").alias("v"))


@query(SQL_LATEST + "SELECT count(*) AS n, true AS ordered, min(k) AS \"first\", max(k) AS \"last\" FROM latest WHERE k >= '4000000000000000' AND k < '8000000000000000'")
def kv_ordered_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range passed to a visitor on the driver in order, while the next partition is fetched; the driver keeps three keys of it."""
    seen: dict[str, bytes | bool | None] = {"first": None, "last": None, "ordered": True}

    def visit(key: bytes, value: bytes) -> None:
        seen["ordered"] &= seen["last"] is None or seen["last"] < key
        seen["first"], seen["last"] = seen["first"] or key, key

    n = _store(spark, sf_dir).range(LOW, HIGH, visit)
    shown = [x.hex().upper() if x else None for x in (seen["first"], seen["last"])]
    return spark.createDataFrame([(n, bool(seen["ordered"]), *shown)], "n bigint, ordered boolean, first string, last string")


@query(SQL_LATEST + "SELECT k, v, count(*) OVER () AS n FROM latest WHERE k >= '4000000000000000' AND k < '8000000000000000'")
def kv_cached_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of a range, held in the executors' memory and read twice: once to count them, once to show them."""
    rows = _store(spark, sf_dir).cached(LOW, HIGH)
    n = rows.count()
    return rows.select(F.hex("key").alias("k"), F.decode("value", "UTF-8").alias("v"), F.lit(n).alias("n"))


def _sql_set(at: int, n: int, value: str) -> str:
    """Hex of the key with n bytes of a number in it, least significant first."""
    number = f"lpad(to_hex(CAST({value} AS BIGINT)), 16, '0')"
    digits = ", ".join(f"substr({number}, {17 - 2 * j}, 2)" for j in range(1, n + 1))
    return f"concat(substr(k, 1, {2 * at}), upper(concat({digits})), substr(k, {2 * (at + n) + 1}))"


@query(
    "WITH s AS (SELECT c_custkey, upper(substr(md5(CAST(c_custkey AS VARCHAR)), 1, 16)) AS k FROM customer) "
    f"SELECT c_custkey, {_sql_set(3, 1, 'c_custkey % 128')} AS b, {_sql_set(1, 2, 'c_custkey')} AS s, {_sql_set(2, 4, '-c_custkey')} AS i, {_sql_set(0, 8, 'c_custkey * 1000003')} AS l, CAST(c_custkey * 1000003 AS BIGINT) AS back, concat(substr(k, 1, 10), 'ABCDEF') AS raw, CAST(NULL AS VARCHAR) AS beyond FROM s"
)
def kv_slice_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers and bytes put into a key, least significant byte first; a long is read back. What does not fit gives null."""
    s, n = table(spark, sf_dir, "customer").select("c_custkey", codec.digest_key("c_custkey").alias("key")), F.col("c_custkey")
    long = codec.write_little_endian("key", 0, n * 1000003, "long")
    new = {
        "b": codec.write_little_endian("key", 3, n % 128, "byte"), "s": codec.write_little_endian("key", 1, n, "short"), "i": codec.write_little_endian("key", 2, -n, "int"), "l": long,
        "raw": codec.write_bytes("key", 5, F.unhex(F.lit("ABCDEF"))), "beyond": codec.write_bytes("key", 6, F.unhex(F.lit("ABCDEF"))),
    }
    return s.select("c_custkey", *(F.hex(v).alias(k) for k, v in new.items()), codec.read_little_endian(long, 0, "long").alias("back"))


# Not of the key-value contract: what a view gives besides, being a table.


@query(SQL_LATEST + "SELECT k, seq FROM latest ORDER BY k LIMIT 10")
def ext_top_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.index(events_log(spark, sf_dir)).orderBy("key").limit(10).select(F.hex("key").alias("k"), "seq")


@query(SQL_LATEST + "SELECT split_part(v, '|', 2) AS event_type, count(*) AS n, max(seq) AS last FROM latest GROUP BY 1")
def ext_group_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.latest(events_log(spark, sf_dir)).groupBy(F.split_part("value", F.lit("|"), F.lit(2)).alias("event_type")).agg(F.count("*").alias("n"), F.max("seq").alias("last"))
