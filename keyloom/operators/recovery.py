"""What is read after an unclean stop: the committed log and a replayed tail, which may overlap."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.operators.views import latest


def replayed(base: DataFrame, tail: DataFrame) -> DataFrame:
    """Log and tail; rows that both hold (same key and sequence) count once when the view is made."""
    return base.select("key", "seq", "value").unionByName(tail.select("key", "seq", "value"))


def recovered(base: DataFrame, tail: DataFrame) -> DataFrame:
    return latest(replayed(base, tail))


def torn(log: DataFrame) -> DataFrame:
    """Keys whose sequences are not unique: a log that was written twice over."""
    return log.groupBy("key", "seq").agg(F.count_distinct("value").alias("values")).filter("values > 1").select("key", "seq")
