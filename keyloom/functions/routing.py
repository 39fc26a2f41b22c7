"""Shards of keys. A shard is a column, not a physical partition: it prunes, groups and orders, and costs no small files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from keyloom.functions.codec import Named, _col, byte_at, unsigned

SHARD_BITS = 10


def shard_of(key: Named, bits: int = SHARD_BITS) -> Column:
    """The first bits of the key, up to 32; keeps the keys' order. Keys shorter than 4 bytes count as padded with zeros."""
    head = F.rpad(F.substring(F.hex(_col(key)), 1, 8), 8, "0")
    return F.shiftright(unsigned(head), 32 - bits)


def hash_partition(key: Named, n: int) -> Column:
    """The first byte, as a signed number without its sign, modulo n. n is under 127."""
    if not 0 < n < 127:
        raise ValueError("the number of partitions is from 1 to 126")
    b = byte_at(key, 0)
    return F.when(b > 127, 256 - b).otherwise(b) % n


def within(key: Named, lower: bytes | None, upper: bytes | None) -> Column:
    """lower <= key < upper; None is no bound. Pushed to the files as comparisons of the key."""
    out = F.lit(True)
    if lower is not None:
        out = out & (_col(key) >= F.lit(lower))
    if upper is not None:
        out = out & (_col(key) < F.lit(upper))
    return out
