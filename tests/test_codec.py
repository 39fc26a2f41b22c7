"""Literal cases of routing and byte functions."""

import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from keyloom.functions import codec
from keyloom.functions.routing import hash_partition, shard_of

ROUTES = [
    ("0000000000000000", 0, 0), ("3F00000000000000", 252, 15), ("3F40000000000000", 253, 15), ("3FC0000000000000", 255, 15), ("4000000000000000", 256, 0), ("4040000000000000", 257, 0),
    ("5AFF000000000000", 363, 10), ("5AEE000000000000", 363, 10), ("5ADD000000000000", 363, 10), ("8000000000000000", 512, 0), ("FFFFFFFFFFFFFFFF", 1023, 1),
]


def keys(spark, *hexed):
    return spark.createDataFrame([(bytearray.fromhex(h),) for h in hexed], "key binary")


def test_routing(spark):
    rows = keys(spark, *(h for h, _, _ in ROUTES)).select(F.hex("key").alias("k"), shard_of("key").alias("s"), hash_partition("key", 16).alias("p")).collect()
    assert {(r["k"], r["s"], r["p"]) for r in rows} == set(ROUTES)


def test_hash_partition_bounds():
    for n in (0, 127, 200):
        with pytest.raises(ValueError):
            hash_partition("key", n)


def test_counter_keys_route_by_low_byte(spark):
    rows = spark.createDataFrame([(i, bytearray(struct.pack("<q", i))) for i in range(0, 16384, 97)], "i int, key binary").select("i", shard_of("key").alias("s")).collect()
    assert all(r["s"] == 4 * (r["i"] % 256) for r in rows)


def test_literal_codecs(spark):
    one = spark.range(1)
    row = one.select(
        F.hex(codec.int_to_bytes(F.lit(1))).alias("le"), codec.bytes_to_int(F.unhex(F.lit("01020000"))).alias("i"), codec.key_to_long(F.unhex(F.lit("FFFFFFFFFFFFFFFF"))).alias("l"),
        F.octet_length(codec.from_hex(F.lit("00 12 22 33 44 CC FF EE"))).alias("n"), codec.value_offset(F.lit(524288)).alias("o"), codec.bytes_to_int(codec.int_to_bytes(F.lit(-2))).alias("neg"),
    ).first()
    assert tuple(row) == ("01000000", 513, -1, 8, 2147483648, -2)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.binary(min_size=8, max_size=8), min_size=1, max_size=30, unique=True))
def test_keys_order_unsigned_and_read_back(spark, many):
    df = spark.createDataFrame([(bytearray(k),) for k in many], "key binary")
    rows = df.orderBy("key").select("key", codec.unsigned_order("key").alias("u"), codec.read_little_endian("key", 0, "long").alias("l"), codec.read_little_endian("key", 2, "int").alias("i"), codec.read_little_endian("key", 1, "short").alias("s"), codec.read_little_endian("key", 7, "byte").alias("b"), codec.content_hash("key").alias("h")).collect()
    assert [bytes(r["key"]) for r in rows] == sorted(many)
    assert [r["u"] for r in rows] == sorted(r["u"] for r in rows)
    for r in rows:
        k = bytes(r["key"])
        assert (r["l"], r["i"], r["s"], r["b"]) == (*struct.unpack("<q", k), *struct.unpack_from("<i", k, 2), *struct.unpack_from("<h", k, 1), *struct.unpack_from("<b", k, 7))
        h = 8
        for x in k:
            h = (h * 31 + (x - 256 if x > 127 else x)) & 0xFFFFFFFF
        h = h - (1 << 32) if h >= 1 << 31 else h
        assert r["h"] == (h or 1)


def test_nulls_stay_null(spark):
    row = spark.createDataFrame([(None,)], "key binary").select(shard_of("key"), hash_partition("key", 16), codec.key_to_long("key"), codec.to_hex("key")).first()
    assert tuple(row) == (None,) * 4
