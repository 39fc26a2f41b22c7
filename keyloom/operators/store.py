"""The store: open, write, read, range, close, over a log of committed batches and sorted snapshots.

Reads see the state at open (or the last refresh). A snapshot is the latest view of some batches, range-partitioned and sorted by key;
it names the batches it holds, so reads merge it with newer batches only and never use a stale one.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.errors import Code, StoreError
from keyloom.operators import views
from keyloom.functions.routing import within
from keyloom.operators.shared import Ride, RowVisitor, Visitor, visit_rows
from keyloom.sources.log import SCHEMA, Log


class Store:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.log = spark, Log(spark, path)
        self.files, self.closed, self.ride, self.kept = self.log.files, False, None, []
        self.unclean = bool(self.log.uncommitted())
        self.refresh()

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Store:
        """Opens the store at a path and creates it if it is missing."""
        try:
            return cls(spark, path)
        except StoreError:
            raise
        except Exception as e:
            raise StoreError(Code.IO_ERROR, f"{path} cannot be opened") from e

    def _open(self) -> None:
        if self.closed:
            raise StoreError(Code.NOT_SUPPORTED, "the store is closed")

    def refresh(self) -> None:
        """Take in what was committed since."""
        self._drop_cached()
        self.batches, self.snapshot = self.log.batches(), None
        for name in reversed(self.files.names("snapshot")):
            if self.files.exists(f"snapshot/{name}/held.json"):
                held = json.loads(self.files.read_text(f"snapshot/{name}/held.json"))
                if set(held) <= set(self.batches):
                    self.snapshot = name, held
                    break

    def write(self, rows: DataFrame, order: str | None = None) -> str:
        """Commit a batch of (key, value) with seq, or with a column that gives the order of the writes."""
        self._open()
        if "seq" not in rows.columns:
            if order is None:
                raise StoreError(Code.INVALID_ARGUMENT, "rows need seq, or a column that orders them")
            rows = views.sequenced(rows, order).withColumn("seq", F.col("seq") + self.log.last_seq() + 1)
        return self.log.append(rows.select("key", "seq", "value"))

    def view(self) -> DataFrame:
        """The latest row of each key, as of the last refresh."""
        self._open()
        if self.snapshot is None:
            return views.latest(self.log.read(self.batches))
        name, held = self.snapshot
        sorted_run = self.spark.read.schema(SCHEMA).parquet(self.files.uri(f"snapshot/{name}/rows"))
        newer = [b for b in self.batches if b not in held]
        if not newer:
            return views.trusted(sorted_run)
        return views.latest(sorted_run.withColumn("batch", F.lit(-1).cast("bigint")).unionByName(self.log.read(newer)))  # the run is older than any of them

    def read(self, key: bytes) -> bytes | None:
        """The value of a key, None if it is absent. For many keys use multi_get: a call is a job."""
        rows = views.get(self.view(), key).select("value").take(1)
        return bytes(rows[0]["value"]) if rows else None

    def multi_get(self, keys: DataFrame) -> DataFrame:
        return views.multi_get(self.view(), keys)

    def range(self, lower: bytes | None = None, upper: bytes | None = None, visit: Callable[[bytes, bytes], None] | None = None) -> DataFrame | int:
        """Rows with lower <= key < upper in order. With visit, each pair is passed to it in order on the driver, partition by
        partition; see visit() for work on the executors."""
        rows = views.range_scan(self.view(), lower, upper)
        if visit is None:
            return rows
        n = 0
        for r in rows.select("key", "value").toLocalIterator(prefetchPartitions=True):
            visit(bytes(r["key"]), bytes(r["value"]))
            n += 1
        return n

    def share(self, visitor: Visitor, calls: int = 64, seconds: float = 10.0) -> dict[str, object]:
        """Aggregates over a range in a pass that is shared with other callers of this store."""
        self._open()
        if self.ride is None:
            self.ride = Ride(self.view(), calls, seconds)
        return self.ride.submit(visitor)

    def compact(self, partitions: int | None = None) -> str:
        """Write the latest view of all committed batches, sorted by key, as the snapshot that reads start from."""
        self._open()
        self.refresh()
        number = 1 + max((int(x.rpartition("-")[2]) for x in self.files.names("snapshot")), default=-1)
        name, view = f"snapshot-{number:09d}", self.view()
        rows = (view.repartitionByRange(partitions, "key") if partitions else view.repartitionByRange("key")).sortWithinPartitions("key")
        rows.write.parquet(self.files.uri(f"snapshot/{name}/rows"))
        self.files.write_text(f"snapshot/{name}/held.json", json.dumps(self.batches))
        self.refresh()
        return name

    def recover(self) -> list[str]:
        """Remove what writers left uncommitted; committed batches are whole as they are."""
        self._open()
        gone = self.log.drop_uncommitted()
        self.unclean = False
        return gone

    def visit(self, visitors: list[RowVisitor], schema: str) -> DataFrame:
        """Rows in order to visitors that work on the executors, all in one pass."""
        return visit_rows(self.view(), visitors, schema)

    def cached(self, lower: bytes | None = None, upper: bytes | None = None) -> DataFrame:
        """The view of a range, kept in the executors' memory (on their disks where that is full) until close or refresh."""
        rows = self.view().filter(within("key", lower, upper)).persist(StorageLevel.MEMORY_AND_DISK)
        self.kept.append(rows)
        return rows

    def _drop_cached(self) -> None:
        for rows in self.kept:
            rows.unpersist()
        self.kept = []

    def size(self) -> int:
        """Bytes of the store's files."""
        return self.files.size()

    def close(self) -> None:
        if self.ride is not None:
            self.ride.close()
        self._drop_cached()
        self.closed = True
