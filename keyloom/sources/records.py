"""The raw 12-byte log as a Spark data source: spark.read.format("wal12").load(folder or file).

Files are cut at record ends into ranges, and small files are put together, so that a partition has RANGE_RECORDS records at most.
Records come as Arrow batches, read by position and decoded as arrays. Zero records that a writer left at a file's end are
dropped unless option("trim", "false") is set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from keyloom.functions.codec import KEY_BYTES, RECORD_BYTES

RANGE_RECORDS, LEAST_RECORDS, BATCH_RECORDS = 1 << 20, 1 << 14, 1 << 16
#: Partitions that a log is dealt to if it is neither very small nor very large.
PARTITIONS = 64
SCHEMA = pa.schema([("file", pa.string()), ("position", pa.int64()), ("key", pa.binary()), ("seq", pa.int64())])
RECORD = np.dtype([("key", f"V{KEY_BYTES}"), ("seq", "<i4")])


class Ranges(InputPartition):
    """(path, first record, records) of pieces of files."""

    def __init__(self, pieces: list[tuple[str, int, int]]) -> None:
        self.pieces = pieces


class Records(DataSource):
    @classmethod
    def name(cls) -> str:
        return "wal12"

    def schema(self) -> str:
        return "file string, position bigint, key binary, seq bigint"

    def reader(self, schema: object) -> DataSourceReader:
        return RecordsReader(self.options)


def decoded(raw: bytes, path: str, first: int, trim: bool) -> pa.RecordBatch:
    """Records from their bytes; first is the position of the first one."""
    a = np.frombuffer(raw, dtype=RECORD)
    at = np.arange(first, first + len(a))
    if trim:
        keep = (a["seq"] != 0) | (at == 0)
        a, at = a[keep], at[keep]
    keys = pa.FixedSizeBinaryArray.from_buffers(pa.binary(KEY_BYTES), len(a), [None, pa.py_buffer(a["key"].tobytes())]).cast(pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([path], pa.string()).take(pa.array(np.zeros(len(a), dtype=np.int64))), pa.array(at), keys, pa.array(a["seq"].astype(np.int64))], schema=SCHEMA)


class RecordsReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        path = options["path"]
        self.uri = path if "://" in path or path.startswith("file:") else f"file://{path}"
        self.trim = str(options.get("trim", "true")).lower() != "false"

    def partitions(self) -> list[Ranges]:
        fs, base = pafs.FileSystem.from_uri(self.uri)
        info = fs.get_file_info(base)
        files = [info] if info.type == pafs.FileType.File else sorted((f for f in fs.get_file_info(pafs.FileSelector(base)) if f.type == pafs.FileType.File and f.base_name.startswith("wal-")), key=lambda f: f.path)
        size = sum(f.size // RECORD_BYTES for f in files)
        most = min(RANGE_RECORDS, max(LEAST_RECORDS, -(-size // PARTITIONS)))
        out, held = [[]], 0
        for f in files:
            at, n = 0, f.size // RECORD_BYTES
            while at < n:
                if held == most:
                    out.append([])
                    held = 0
                take = min(n - at, most - held)
                out[-1].append((f.path, at, take))
                at, held = at + take, held + take
        return [Ranges(p) for p in out]

    def read(self, part: Ranges) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(self.uri)
        for path, first, n in part.pieces:
            with fs.open_input_file(path) as f:
                for k in range(first, first + n, BATCH_RECORDS):
                    yield decoded(f.read_at(RECORD_BYTES * min(BATCH_RECORDS, first + n - k), RECORD_BYTES * k), path, k, self.trim)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Records)
