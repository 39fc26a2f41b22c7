"""Checks of a scan's result: order, agreement of key and value, lengths, counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def order_violations(rows: DataFrame) -> DataFrame:
    """Rows (key, pos; pos is where a row was found, not made from the keys) whose key is not above that of the position before: violations, rows. An equi-join of neighbours."""
    before = rows.select((F.col("pos") + 1).alias("pos"), F.col("key").alias("_before"))
    pairs = rows.select("pos", "key").join(before, "pos", "left")
    return pairs.agg(F.count_if(F.col("_before") >= F.col("key")).alias("violations"), F.count("*").alias("n"))


def prefix_mismatches(rows: DataFrame, width: int = 8) -> DataFrame:
    """Values whose first bytes differ from the key: mismatches, rows."""
    return rows.agg(F.count_if(F.coalesce(F.substring(F.col("value").cast("binary"), 1, width) != F.col("key"), F.lit(True))).alias("mismatches"), F.count("*").alias("n"))


def length_mismatches(rows: DataFrame, length: int) -> DataFrame:
    return rows.agg(F.count_if(F.coalesce(F.octet_length("value") != length, F.lit(True))).alias("mismatches"), F.count("*").alias("n"))


def hit_count(lookups: DataFrame) -> DataFrame:
    """Of a multi-get: requested, hits, misses."""
    return lookups.agg(F.count("*").alias("asked"), F.coalesce(F.sum("found"), F.lit(0)).alias("hits"), F.coalesce(F.sum(1 - F.col("found")), F.lit(0)).alias("misses"))
