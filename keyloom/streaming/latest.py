"""The latest view of a log that grows, by Structured Streaming.

State is one row a key and never ends, as the view itself. For a durable table use merge_batches, which keeps no state in the
stream: every micro-batch is first summed by key and then appended to a store.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from keyloom.operators import views
from keyloom.operators.store import Store


def read_stream(spark: SparkSession, path: str, schema: StructType, files_a_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_a_trigger) if files_a_trigger else reader).parquet(path)


def latest_stream(log: DataFrame) -> DataFrame:
    """The streaming form of views.latest: the same aggregation, in complete or update mode."""
    return log.groupBy("key").agg(F.max("seq").alias("seq"), F.max_by("value", "seq").alias("value"))


def run_to_memory(stream: DataFrame, name: str, checkpoint: str | None = None, mode: str = "complete") -> DataFrame:
    """Run all that is there and give the resulting in-memory table. For tests of small views: the driver holds the whole of it."""
    writer = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True)
    query = (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


def merge_batches(log: DataFrame, store: Store, checkpoint: str) -> None:
    """Append the latest rows of every micro-batch to a store; exactly the rows that are new in the log, each batch committed whole.

    A micro-batch that is run again after a failure appends rows with the same sequences, which leaves the view as it is.
    """

    def merge(rows: DataFrame, _: int) -> None:
        store.write(views.latest(rows))

    log.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    store.refresh()
