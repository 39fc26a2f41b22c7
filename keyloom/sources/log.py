"""The append-only log: batches of (key, seq, value) as Parquet, each committed as a whole.

A batch is a folder; it counts once its _SUCCESS marker is there, so a job that dies while it writes leaves nothing to be seen.
Batches are range-partitioned and sorted by key if asked, which lets point reads and ranges skip row groups.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyloom.errors import Code, StoreError
from keyloom.functions.codec import KEY_BYTES
from keyloom.sources.files import Files

SCHEMA = T.StructType([T.StructField("key", T.BinaryType(), False), T.StructField("seq", T.LongType(), False), T.StructField("value", T.BinaryType(), False)])
MARKER, RECORD = "_SUCCESS", "_batch.json"


def checked(rows: DataFrame) -> DataFrame:
    """The rows, with an error at run time for keys of another length and for nulls. No pass of its own."""
    good = (F.octet_length("key") == KEY_BYTES) & F.col("seq").isNotNull() & F.col("value").isNotNull()
    key = F.when(F.coalesce(good, F.lit(False)), F.col("key")).otherwise(F.raise_error(F.lit(f"INVALID_ARGUMENT: a key has {KEY_BYTES} bytes; key, seq and value are not null")).cast("binary"))
    return rows.select(key.alias("key"), F.col("seq").cast("bigint").alias("seq"), F.col("value").cast("binary").alias("value"))


class Log:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.files = spark, Files(spark, root)
        self.files.make("log")

    def batches(self) -> list[str]:
        """Committed batches in the order of their numbers."""
        return [b for b in self.files.names("log") if self.files.exists(f"log/{b}/{MARKER}")]

    def uncommitted(self) -> list[str]:
        """Folders that a writer left without its marker: the store was not closed properly, or a writer is at work."""
        return [b for b in self.files.names("log") if not self.files.exists(f"log/{b}/{MARKER}")]

    def append(self, rows: DataFrame, ordered: bool = True, partitions: int | None = None) -> str:
        """Write one batch and commit it; returns its name. Sequences must be greater than those of earlier batches for their keys."""
        number = 1 + max((int(b.rpartition("-")[2]) for b in self.files.names("log")), default=-1)
        name = f"batch-{number:09d}"
        rows = checked(rows)
        if ordered:
            rows = (rows.repartitionByRange(partitions, "key") if partitions else rows.repartitionByRange("key")).sortWithinPartitions("key", "seq")
        seen = Observation()
        rows = rows.observe(seen, F.max("seq").alias("last"), F.count(F.lit(1)).alias("rows"))
        try:
            rows.write.mode("errorifexists").parquet(self.files.uri(f"log/{name}"))
        except Exception as e:
            if "INVALID_ARGUMENT" in str(e):
                self.files.delete(f"log/{name}")
                raise StoreError(Code.INVALID_ARGUMENT, "a row has a key of another length or a null") from e
            raise StoreError(Code.IO_ERROR, f"batch {name} was not committed") from e
        self.files.write_text(f"log/{name}/{RECORD}", json.dumps({"last_seq": seen.get["last"] if seen.get["last"] is not None else -1, "rows": seen.get["rows"]}))
        if not self.files.exists(f"log/{name}/{MARKER}"):
            self.files.write_text(f"log/{name}/{MARKER}", "")
        return name

    def read(self, names: list[str] | None = None) -> DataFrame:
        """The rows of committed batches, as of now, with the number of their batch."""
        names = self.batches() if names is None else names
        if not names:
            return self.spark.createDataFrame([], SCHEMA).withColumn("batch", F.lit(0).cast("bigint"))
        rows = self.spark.read.schema(SCHEMA).parquet(*(self.files.uri(f"log/{b}") for b in names))
        return rows.withColumn("batch", F.regexp_extract(F.col("_metadata.file_path"), r"/batch-([0-9]+)/[^/]*$", 1).cast("bigint"))

    def last_seq(self) -> int:
        """The greatest committed sequence, -1 for none, from the batches' records; a batch without one is read."""
        names = self.batches()
        noted = {b: json.loads(self.files.read_text(f"log/{b}/{RECORD}"))["last_seq"] for b in names if self.files.exists(f"log/{b}/{RECORD}")}
        rest = [b for b in names if b not in noted]
        return max([-1, *noted.values(), *([self.read(rest).agg(F.coalesce(F.max("seq"), F.lit(-1))).first()[0]] if rest else [])])

    def drop_uncommitted(self) -> list[str]:
        gone = self.uncommitted()
        for b in gone:
            self.files.delete(f"log/{b}")
        return gone
