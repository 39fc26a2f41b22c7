"""Byte functions as column expressions: they stay in the JVM and in generated code.

A key is 8 opaque bytes, compared unsigned and lexicographically, as Spark compares BINARY. Nulls give null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KEY_BYTES = 8
VALUE_BYTES = 4096
SEQUENCE_BYTES = 4
#: A raw log record: key and sequence.
RECORD_BYTES = KEY_BYTES + SEQUENCE_BYTES

#: Bytes of an element, by type.
WIDTHS = {"byte": 1, "short": 2, "int": 4, "long": 8, "float": 4, "double": 8}

Named = Column | str


def _col(c: Named) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_hex(c: Named) -> Column:
    """Upper-case hex of bytes."""
    return F.hex(_col(c))


def from_hex(c: Named) -> Column:
    """Bytes of hex text; blanks between digits are dropped."""
    return F.unhex(F.replace(_col(c), F.lit(" "), F.lit("")))


def reversed_hex(c: Column, n: int) -> Column:
    """Hex of n bytes with their order turned round."""
    return F.concat(*(F.substring(c, 2 * k - 1, 2) for k in range(n, 0, -1)))


def int_to_bytes(c: Named) -> Column:
    """A 32-bit integer as 4 bytes, least significant first."""
    wide = F.lpad(F.hex(_col(c).cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")
    return F.unhex(reversed_hex(wide, SEQUENCE_BYTES))


def unsigned(hex_digits: Column) -> Column:
    """Up to 15 hex digits as a non-negative number."""
    return F.conv(hex_digits, 16, 10).cast("bigint")


def read_little_endian(c: Named, at: int, kind: str) -> Column:
    """The signed integer of a kind (byte, short, int, long) at a byte offset, least significant byte first."""
    n = WIDTHS[kind]
    digits = reversed_hex(F.hex(F.substring(_col(c), at + 1, n)), n)
    if n == 8:
        return F.conv(digits, 16, -10).cast("bigint")
    value = unsigned(digits)
    return F.when(value >= 1 << (8 * n - 1), value - (1 << 8 * n)).otherwise(value).cast({1: "int", 2: "int", 4: "int"}[n])


def to_little_endian(value: Named, kind: str) -> Column:
    """The bytes of a whole number of a kind, least significant first; higher bits are dropped."""
    n = WIDTHS[kind]
    digits = F.lpad(F.hex(_col(value).cast("bigint")), 16, "0")
    return F.unhex(reversed_hex(F.substring(digits, 17 - 2 * n, 2 * n), n))


def write_bytes(c: Named, at: int, new: Column) -> Column:
    """The slice with other bytes from a byte offset on; null if they would not fit."""
    whole, size = _col(c), F.octet_length(new)
    rest = F.substr(whole, size + at + 1, F.octet_length(whole))
    return F.when(size + at <= F.octet_length(whole), F.concat(F.substring(whole, 1, at), new, rest))


def write_little_endian(c: Named, at: int, value: Named, kind: str) -> Column:
    """The slice with a whole number of a kind (byte, short, int, long) at a byte offset."""
    return write_bytes(c, at, to_little_endian(value, kind))


def bytes_to_int(c: Named) -> Column:
    """4 bytes, least significant first, as a signed integer."""
    return read_little_endian(c, 0, "int")


def key_to_long(c: Named) -> Column:
    """8 bytes, most significant first, as a signed 64-bit number."""
    return F.conv(F.hex(_col(c)), 16, -10).cast("bigint")


def unsigned_order(c: Named) -> Column:
    """A signed number that orders 8-byte keys as their unsigned values do: the sign bit is turned."""
    return key_to_long(c).bitwiseXOR(F.lit(-(1 << 63)))


def value_offset(seq: Named, width: int = VALUE_BYTES) -> Column:
    """Byte offset of a sequence's slot, in 64 bits."""
    return _col(seq).cast("bigint") * F.lit(width).cast("bigint")


def byte_at(c: Named, at: int) -> Column:
    """The unsigned byte at an offset."""
    return F.conv(F.hex(F.substring(_col(c), at + 1, 1)), 16, 10).cast("int")


def content_hash(c: Named) -> Column:
    """31-polynomial over the signed bytes, beginning with the length, in 32 bits; 0 becomes 1."""
    digits, size = F.hex(_col(c)), F.octet_length(_col(c))
    signed = F.transform(F.sequence(F.lit(0), size - 1), lambda k: (F.conv(F.substr(digits, k * 2 + 1, F.lit(2)), 16, 10).cast("bigint") + 128) % 256 - 128)
    wrapped = F.aggregate(F.when(size > 0, signed).otherwise(F.array().cast("array<bigint>")), size.cast("bigint"), lambda h, b: (h * 31 + b).bitwiseAND(F.lit(0xFFFFFFFF)))
    signed_hash = F.when(wrapped >= 1 << 31, wrapped - (1 << 32)).otherwise(wrapped)
    return F.when(signed_hash == 0, F.lit(1)).otherwise(signed_hash).cast("bigint")


def array_bytes(length: Named, kind: str, header: int = 16) -> Column:
    """Bytes of a primitive array: its header and its elements."""
    return F.lit(header).cast("bigint") + _col(length).cast("bigint") * WIDTHS[kind]


def digest_key(c: Named) -> Column:
    """An 8-byte key from the digest of any value, spread over all shards."""
    return F.unhex(F.substring(F.md5(_col(c).cast("string")), 1, 2 * KEY_BYTES))


def valid_key(c: Named) -> Column:
    return F.coalesce(F.octet_length(_col(c)) == KEY_BYTES, F.lit(False))
