"""Workloads: seeded writes, structured keys, double writes. Deterministic, made in parallel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.functions.codec import KEY_BYTES

# The prefixes of structured keys, by i mod 6.
PREFIXES = ("3F00", "3F40", "3F80", "3FC0", "4000", "4040")


def seeded(spark: SparkSession, writers: int, each: int, value_bytes: int = 4096) -> DataFrame:
    """(key, seq, value): writer i draws its keys from seed i; a value begins with its key."""
    n = F.col("id")
    key = F.unhex(F.substring(F.md5(F.concat_ws("/", (n / each).cast("bigint").cast("string"), (n % each).cast("string"))), 1, 2 * KEY_BYTES))
    rows = spark.range(writers * each).select(key.alias("key"), n.alias("seq"))
    return rows.withColumn("value", F.concat("key", F.unhex(F.repeat(F.lit("36"), value_bytes - KEY_BYTES))))


def structured_key(i: Column, index: Column) -> Column:
    """2 bytes by i mod 6, then i * 10000 + index in 4 bytes, most significant first, then 2 zero bytes."""
    prefix = F.element_at(F.array(*map(F.lit, PREFIXES)), (i % len(PREFIXES)).cast("int") + 1)
    return F.unhex(F.concat(prefix, F.lpad(F.hex((i * 10000 + index).cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0"), F.lit("0000")))


def double_write(rows: DataFrame, number: str, first: Column, second: Column) -> DataFrame:
    """Every key twice: at 2n with one value and at 2n + 1 with another."""
    version = F.explode(F.array(F.struct(F.lit(0).alias("v"), first.alias("value")), F.struct(F.lit(1).alias("v"), second.alias("value")))).alias("x")
    return rows.select("key", F.col(number).alias("n"), version).select("key", (F.col("n") * 2 + F.col("x.v")).cast("bigint").alias("seq"), "x.value")
