"""The raw formats: a log of 12-byte records (8-byte key, sequence of 4 bytes, least significant first), and value slots.

A writer that grows its file in advance leaves zero records at the end. A record of zero bytes after the last real one is such a
rest; a zero key that was really written is first in its file (sequence 0) or has another sequence. The value of sequence s is the
slot at s * width of its shard's value file, filled up with zero bytes. A file is written under a name of the attempt's own and gets
its name when it is whole, so a task that is run twice, or at once with a copy of itself, leaves one whole file.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.functions.codec import RECORD_BYTES, VALUE_BYTES, int_to_bytes
from keyloom.functions.routing import SHARD_BITS, shard_of
from keyloom.sources import records

#: Values that are read in one go if their slots lie next to each other.
SLOTS_AT_ONCE = 256


def folder_of(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(position, key, seq) of every record of one file, zero records too."""
    return read_records_by_file(spark, path).select("position", "key", "seq")


def read_records_by_file(spark: SparkSession, folder: str) -> DataFrame:
    """(file, position, key, seq) of the records of all wal files of a folder, zero records too."""
    records.register(spark)
    return spark.read.format("wal12").option("trim", "false").load(folder)


def trimmed(rows: DataFrame) -> DataFrame:
    """Without zero records (sequence 0) after the first record of the file: sequences start at 0, so only the first can have it."""
    return rows.filter((F.col("position") == 0) | (F.col("seq") != 0))


def _write_by_shard(rows: DataFrame, folder: str, prefix: str, put: Callable, end: Callable) -> list[tuple[int, int]]:
    """rows: shard, seq, data. One file a shard, its rows in the order of seq; returns (shard, rows). put(out, seqs, data), end(out, rows)."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = folder_of(folder)
        fs.create_dir(base)
        out, own, shard, counts = None, None, None, []

        def close() -> None:
            end(out, counts[-1][1])
            out.close()
            fs.move(own, f"{base}/{prefix}-{shard}")

        try:
            for b in batches:
                shards = b.column("shard").to_numpy()
                edges = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), len(shards)]
                for i, j in zip(edges, edges[1:], strict=False):
                    if i < j:
                        if shards[i] != shard:
                            if out is not None:
                                close()
                            shard = int(shards[i])
                            own = f"{base}/.{prefix}-{shard}.{uuid.uuid4().hex}"
                            out = fs.open_output_stream(own)
                            counts.append([shard, 0])
                        put(out, b.column("seq").slice(i, j - i), b.column("data").slice(i, j - i))
                        counts[-1][1] += j - i
            if out is not None:
                close()
        except BaseException:
            if out is not None:
                out.close()
                if fs.get_file_info(own).type == pafs.FileType.File:
                    fs.delete_file(own)
            raise
        yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in counts], pa.int64()), pa.array([n for _, n in counts], pa.int64())], names=["shard", "n"])

    dealt = rows.repartition("shard").sortWithinPartitions("shard", "seq")
    done = sorted((r["shard"], r["n"]) for r in dealt.mapInArrow(write, "shard bigint, n bigint").collect())  # one row a shard
    fs, base = folder_of(folder)
    fs.create_dir(base)
    for f in fs.get_file_info(pafs.FileSelector(base)):
        if f.base_name.startswith(f".{prefix}-"):  # of executors that were lost
            fs.delete_file(f.path)
    return done


def write_records(log: DataFrame, folder: str, bits: int = SHARD_BITS, grow: int = 0) -> list[tuple[int, int]]:
    """One wal-N file per shard N, records in the order of seq. Returns (shard, records).

    With grow, files have zero records at the end up to a multiple of so many records, and one page of them at least: as a
    writer leaves them that grows its file in advance and is not closed.
    """

    def put(out: pa.NativeFile, _: pa.Array, data: pa.Array) -> None:
        out.write(b"".join(data.to_pylist()))

    def end(out: pa.NativeFile, n: int) -> None:
        if grow:
            out.write(bytes(RECORD_BYTES * (grow - n % grow)))

    return _write_by_shard(log.select(shard_of("key", bits).alias("shard"), "seq", F.concat("key", int_to_bytes("seq")).alias("data")), folder, "wal", put, end)


def write_values(log: DataFrame, folder: str, bits: int = SHARD_BITS, width: int = VALUE_BYTES) -> list[tuple[int, int]]:
    """One value-N file per shard N, the value of seq s at s * width. Returns (shard, values). Longer values are refused."""
    value = F.col("value").cast("binary")
    fits = F.when(F.octet_length(value) <= width, value).otherwise(F.raise_error(F.lit(f"INVALID_ARGUMENT: a value has {width} bytes at most")).cast("binary"))

    def put(out: pa.NativeFile, seqs: pa.Array, data: pa.Array) -> None:
        at = out.tell()
        for s, v in zip(seqs.to_pylist(), data.to_pylist(), strict=True):
            out.write(bytes(s * width - at) + v)
            at = s * width + len(v)

    def end(out: pa.NativeFile, _: int) -> None:
        out.write(bytes(-out.tell() % width))

    return _write_by_shard(log.select(shard_of("key", bits).alias("shard"), "seq", fits.alias("data")), folder, "value", put, end)


def read_values(asked: DataFrame, folder: str, width: int = VALUE_BYTES) -> DataFrame:
    """asked: shard, seq and other columns. Adds value, the whole slot; null where the shard's file has no such slot.

    Positional reads, in the order of the slots; slots next to each other come in one read.
    """
    columns = asked.columns
    schema = asked.schema.add("value", "binary")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = folder_of(folder)
        shard, file, size = None, None, 0
        for b in batches:
            out: list[bytes | None] = []
            shards, seqs = b.column("shard").to_numpy(), b.column("seq").to_numpy()
            at = 0
            while at < len(shards):
                if shards[at] != shard:
                    shard = shards[at]
                    info = fs.get_file_info(f"{base}/value-{shard}")
                    size = info.size if info.type == pafs.FileType.File else 0
                    file = fs.open_input_file(info.path) if size else None
                n = 1
                while seqs[at] >= 0 and at + n < len(shards) and n < SLOTS_AT_ONCE and shards[at + n] == shard and seqs[at + n] == seqs[at] + n:
                    n += 1
                first = int(seqs[at])
                raw = file.read_at(n * width, first * width) if file is not None and 0 <= first * width < size else b""
                out += [raw[k * width : (k + 1) * width] or None for k in range(n)]
                at += n
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.binary())], names=[*columns, "value"])

    return asked.repartition("shard").sortWithinPartitions("shard", "seq").mapInArrow(read, schema)
