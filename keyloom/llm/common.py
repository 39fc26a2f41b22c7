"""What the operators of this subpackage share: tables, staging in the shared folder, hashing, Arrow batches."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of an Arrow batch; texts are long, so batches stay at a few MB (one text at least).
BATCH_ROWS, BATCH_BYTES = 512, 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Keep Arrow batches of long texts small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a local session gets a folder of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="keyloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


#: Files of a small table, and rows for which it gets another.
FEW_FILES, ROWS_A_FILE = 12, 20_000


class Workspace:
    """Tables that an operator writes to the shared folder to cut lineage. They outlive lost executors."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        atexit.register(self.close)

    def stage(self, df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
        """Write and read again. rows: about how many, if that is known; small tables then are few files, however many partitions made them."""
        path = f"{self.root}/{name}"
        if rows is not None:
            df = df.coalesce(FEW_FILES + rows // ROWS_A_FILE)
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            delete_path(self.spark, f"{self.root}/{name}")

    def close(self) -> None:
        try:
            delete_path(self.spark, self.root)
        except Exception:  # noqa: BLE001  the session may be gone at exit; the folder is then the cluster's to clear
            pass


#: Ids that are broadcast at most (about 25 MB in memory).
BROADCAST_IDS = 1_000_000


def broadcast_if_few(ids: DataFrame, bound: int = BROADCAST_IDS) -> DataFrame:
    """A table of ids, to be broadcast if it is counted to be small; else it is joined by shuffle."""
    return F.broadcast(ids) if ids.count() <= bound else ids


def map_batches(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """Apply f to each Arrow batch."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := f(batch)) is not None:
                yield out

    return df.mapInArrow(run, schema)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The batch's texts, null as empty."""
    return [x or "" for x in batch.column(name).to_pylist()]


ODD = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads 64-bit values (multiply and shift, twice)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHash:
    """64-bit hashes of words, kept for the words seen last in this worker (a cache with a bound, no state that matters)."""

    def __init__(self, bound: int = 250_000) -> None:
        self.bound, self.known = bound, {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        import xxhash

        known = self.known
        if len(known) > self.bound:
            known.clear()
        get, one = known.get, xxhash.xxh3_64_intdigest
        out = [get(w) for w in words]
        if None in out:
            for i, h in enumerate(out):
                if h is None:
                    out[i] = known[words[i]] = one(words[i])
        return np.array(out, dtype=np.uint64)


def runs_hash(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all n consecutive entries of h; of h as a whole if it is shorter (none if it is empty)."""
    if len(h) == 0:
        return h
    n_now = min(n, len(h))
    out = np.zeros(len(h) - n_now + 1, dtype=np.uint64)
    for k in range(n_now):
        out = (out ^ h[k : k + len(out)]) * ODD + np.uint64(k + 1)
    return mix64(out ^ np.uint64(n_now))


def lower_ascii(column: str) -> "F.Column":
    return F.translate(F.col(column), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
