"""Views of a log of (key, seq, value): last write wins, lookups, ordered ranges, positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyloom.errors import Code, StoreError
from keyloom.functions.codec import KEY_BYTES, VALUE_BYTES, to_hex, unsigned_order, value_offset
from keyloom.functions.routing import SHARD_BITS, hash_partition, shard_of, within

#: Keys of a multi-get that are broadcast at most; more are joined by shuffle.
BROADCAST_KEYS = 200_000
#: Parts of about equal size that ordered work is dealt to.
PARTS = 128


def latest(log: DataFrame) -> DataFrame:
    """One row per key, that with the greatest sequence. Filters on the key reach the files below.

    Of rows with one key and sequence the earliest stays: that of the lowest batch, if the log has a column batch, and then the one
    with the least value (a table has no other order).
    """
    rank = ["batch", "value"] if "batch" in log.columns else ["value"]
    best = F.min(F.struct(F.bitwise_not("seq").alias("last"), *rank)).alias("best")
    return log.groupBy("key").agg(best).select("key", F.bitwise_not("best.last").alias("seq"), "best.value")


def index(log: DataFrame) -> DataFrame:
    """Keys and their greatest sequences: a hash aggregation of two columns, values are not read."""
    return log.groupBy("key").agg(F.max("seq").alias("seq"))


def latest_by_join(log: DataFrame) -> DataFrame:
    """As latest(), for large values and few overwrites: the index first, then the values of its entries."""
    found = log.join(index(log), ["key", "seq"], "left_semi")
    return latest(found)  # the values of the greatest sequences only; a row a key but for ties


def trusted(log: DataFrame) -> DataFrame:
    """The view of a log that is known to hold each key once: no aggregation, no shuffle."""
    return log.select("key", "seq", "value")


def as_of(log: DataFrame, seq: int) -> DataFrame:
    """The latest view of the writes up to a sequence."""
    return latest(log.filter(F.col("seq") <= seq))


def get(view: DataFrame, key: bytes) -> DataFrame:
    """The row of one key; none if it is absent."""
    if len(key) != KEY_BYTES:
        raise StoreError(Code.INVALID_ARGUMENT, f"a key has {KEY_BYTES} bytes, not {len(key)}")
    return view.filter(F.col("key") == F.lit(key))


def multi_get(view: DataFrame, keys: DataFrame) -> DataFrame:
    """Every requested key (column key) with seq and value, and found as 0 or 1. The keys are broadcast only if few."""
    asked = keys.select("key").distinct()
    if asked.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS:  # only the requested part of the view is kept, then joined back to the keys
        hit = view.join(F.broadcast(asked), "key", "left_semi")
        out = asked.join(hit, "key", "left")
    else:
        out = asked.join(view, "key", "left")
    return out.withColumn("found", F.col("seq").isNotNull().cast("bigint"))


def found(view: DataFrame, keys: DataFrame) -> DataFrame:
    return keys.join(view.select("key"), "key", "left_semi")


def missing(view: DataFrame, keys: DataFrame) -> DataFrame:
    return keys.join(view.select("key"), "key", "left_anti")


def range_scan(view: DataFrame, lower: bytes | None = None, upper: bytes | None = None) -> DataFrame:
    """Rows with lower <= key < upper in ascending order of the keys; None is no bound."""
    return view.filter(within("key", lower, upper)).orderBy("key")


def part_of(value: Column, bounds: list[int]) -> Column:
    """How many of the ascending bounds are not above a number: a binary search as an expression."""

    def search(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(value >= F.lit(bounds[mid]), search(mid + 1, high)).otherwise(search(low, mid))

    return search(0, len(bounds))


def spread(rows: DataFrame, value: Column) -> Column:
    """Numbers of PARTS parts that follow the order of a 64-bit value and hold about as many rows each.

    The bounds are quantiles of the rows themselves, so keys that share their first bytes are spread as any others.
    """
    shares = [k / PARTS for k in range(1, PARTS)]
    bounds = rows.select(F.percentile_approx(value, shares, 10 * PARTS).alias("b")).first()["b"]
    return part_of(value, sorted(set(bounds or [])))


def ranked(rows: DataFrame, value: Column, order: list[str], within: list[str] | None = None) -> DataFrame:
    """Adds pos, the row's place from 0 in the order of a 64-bit value and then the order columns; within groups, if they are named.

    A row's place is the number of rows in the parts before and its place in its own part. Only the counts of parts meet in one
    task a group; a group on a third of all rows is dealt to PARTS tasks.
    """
    within = within or []
    parted = rows.withColumn("_part", spread(rows, value))
    counts = parted.groupBy(*within, "_part").agg(F.count("*").alias("_n"))
    running = Window.partitionBy(*within).orderBy("_part") if within else Window.orderBy("_part")
    before = counts.select(*within, "_part", (F.sum("_n").over(running) - F.col("_n")).alias("_before"))
    own = F.row_number().over(Window.partitionBy(*within, "_part").orderBy(*order)) - 1
    placed = parted.withColumn("_own", own)
    joined = placed.join(before if within else F.broadcast(before), [*within, "_part"])  # without groups it has PARTS rows at most
    return joined.withColumn("pos", (F.col("_before") + F.col("_own")).cast("bigint")).drop("_part", "_before", "_own")


def positioned(view: DataFrame) -> DataFrame:
    """Adds pos, the row's place in the order of keys, from 0."""
    out = ranked(view, unsigned_order("key"), ["key"])
    return out.select(*view.columns, "pos")


def sequenced(rows: DataFrame, order: str, bits: int = SHARD_BITS) -> DataFrame:
    """Adds shard, seq (from 0 in each shard, by the order column, a whole number) and the value's byte offset."""
    sharded = rows.withColumn("shard", shard_of("key", bits))
    placed = ranked(sharded, F.col(order).cast("bigint"), [order], ["shard"])
    return placed.select(*rows.columns, "shard", F.col("pos").alias("seq")).withColumn("offset", value_offset("seq"))


def shard_stats(log: DataFrame) -> DataFrame:
    """Records and bytes of key log and value log by shard."""
    return log.groupBy(shard_of("key").alias("shard")).agg(F.count("*").alias("records")).select("shard", "records", (F.col("records") * 12).alias("log_bytes"), (F.col("records") * VALUE_BYTES).alias("value_bytes"))


def partition_counts(view: DataFrame, n: int) -> DataFrame:
    return view.groupBy(hash_partition("key", n).cast("bigint").alias("part")).agg(F.count("*").alias("n"))


def dedup_stats(log: DataFrame) -> DataFrame:
    """Rows of the log, live keys, shadowed rows."""
    by_key = log.groupBy("key").agg(F.count("*").alias("n"))
    return by_key.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count("*").alias("live"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("shadowed"))


def page_directory(view: DataFrame, page: int = 256) -> DataFrame:
    """The first key of every page of so many keys in order."""
    return positioned(view).filter(F.col("pos") % page == 0).select((F.col("pos") / page).cast("bigint").alias("page"), "key")


def floor(view: DataFrame, asked: DataFrame) -> DataFrame:
    """For each row of asked (column q) the greatest key that is not above q; null if there is none.

    Keys and questions are merged by parts of the key space and the last key so far is carried along; a part's largest key, one row
    a part, is carried into the parts after it. No inequality join is needed.
    """
    keys = view.select("key").distinct()
    both = keys.select(F.col("key").alias("at"), "key", F.lit(None).cast("binary").alias("q")).unionByName(asked.select(F.col("q").alias("at"), F.lit(None).cast("binary").alias("key"), "q"))
    both = both.withColumn("_shard", spread(both, unsigned_order("at")))
    here = F.last("key", ignorenulls=True).over(Window.partitionBy("_shard").orderBy("at", F.col("key").isNull()).rowsBetween(Window.unboundedPreceding, 0))
    tops = both.groupBy("_shard").agg(F.max("key").alias("_top"))
    before = tops.select("_shard", F.last("_top", ignorenulls=True).over(Window.orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    return both.withColumn("_here", here).filter("q is not null").join(F.broadcast(before), "_shard").select("q", F.coalesce("_here", "_before").alias("floor"))


def batches(rows: DataFrame, size: int = 256) -> DataFrame:
    """Batches of consecutive rows in key order: number, rows, first and last key. Rows must have pos."""
    return rows.groupBy((F.col("pos") / size).cast("bigint").alias("batch")).agg(F.count("*").alias("n"), F.min("key").alias("first"), F.max("key").alias("last"))


def shown(view: DataFrame, *columns: str) -> DataFrame:
    """Keys as hex text, for results that leave the engine."""
    return view.select(*(to_hex(c).alias(c) if dict(view.dtypes)[c] == "binary" else F.col(c) for c in columns or view.columns))


def bucketed(view: DataFrame, buckets: int) -> Column:
    """An internal bucket number (not a stable value): equality lookups by hash are Spark's hash joins."""
    return F.pmod(F.xxhash64("key"), F.lit(buckets))
