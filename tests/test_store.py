"""The store over files: batches, snapshots, recovery, errors, the raw format, streams."""

import os

import pytest
from pyspark.sql import functions as F

from keyloom.errors import Code, StoreError
from keyloom.operators import views
from keyloom.operators.shared import Visitor
from keyloom.operators.store import Store
from keyloom.plans import workload
from keyloom.sources import raw
from keyloom.sources.log import SCHEMA
from keyloom.streaming import latest as streaming


def rows_of(spark, rows):
    return spark.createDataFrame([(bytearray(k), s, bytearray(v)) for k, s, v in rows], "key binary, seq bigint, value binary")


def k8(i):
    return i.to_bytes(8, "big")


def test_write_reopen_read(spark, tmp_path):
    path = f"file://{tmp_path}/db"
    store = Store.open(spark, path)
    assert store.read(k8(1)) is None and not store.unclean
    store.write(rows_of(spark, [(k8(i), i, b"a%d" % i) for i in range(50)]))
    assert store.read(k8(1)) is None  # as of open
    store.refresh()
    assert store.read(k8(1)) == b"a1"
    store.close()
    with pytest.raises(StoreError):
        store.read(k8(1))
    again = Store.open(spark, path)
    again.write(spark.createDataFrame([(bytearray(k8(7)), bytearray(b"new"), 1), (bytearray(k8(7)), bytearray(b"newest"), 2)], "key binary, value binary, at int"), order="at")
    again.refresh()
    assert again.read(k8(7)) == b"newest" and again.read(k8(8)) == b"a8"
    assert again.log.last_seq() == 51 and again.size() > 0


def test_snapshot_is_merged_with_newer_batches_only(spark, tmp_path):
    store = Store.open(spark, f"file://{tmp_path}/db")
    store.write(rows_of(spark, [(k8(i), i, b"1") for i in range(100)]))
    store.compact(3)
    plan = store.view()._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan  # the sorted run is read as it is
    store.write(rows_of(spark, [(k8(i), 100 + i, b"2") for i in range(10)]))
    store.refresh()
    got = {bytes(r["key"]): bytes(r["value"]) for r in store.range().collect()}
    assert got == {k8(i): b"2" if i < 10 else b"1" for i in range(100)}
    seen = []
    assert store.range(k8(5), k8(15), lambda k, v: seen.append((k, v))) == 10
    assert seen == [(k8(i), b"2" if i < 10 else b"1") for i in range(5, 15)]
    assert store.share(Visitor("v", k8(50)), calls=4, seconds=0.1)["n"] == 50
    store.close()


def test_snapshot_files_are_sorted_so_that_ranges_skip(spark, tmp_path):
    store = Store.open(spark, f"file://{tmp_path}/db")
    store.write(rows_of(spark, [(k8(i * 7919 % 4000), i, b"x") for i in range(4000)]))
    name = store.compact(8)
    parts = [f for f in os.listdir(tmp_path / "db/snapshot" / name / "rows") if f.endswith(".parquet")]
    import pyarrow.parquet as pq

    bounds = []
    for f in parts:
        got = pq.read_table(tmp_path / "db/snapshot" / name / "rows" / f).column("key").to_pylist()
        assert got == sorted(got)
        bounds.append((got[0], got[-1]))
    bounds.sort()
    assert all(a[1] < b[0] for a, b in zip(bounds, bounds[1:]))


def test_uncommitted_batches_are_not_seen(spark, tmp_path):
    path = f"file://{tmp_path}/db"
    store = Store.open(spark, path)
    store.write(rows_of(spark, [(k8(1), 0, b"good")]))
    store.write(rows_of(spark, [(k8(1), 1, b"torn")]))
    os.remove(tmp_path / "db/log/batch-000000001/_SUCCESS")
    again = Store.open(spark, path)
    assert again.unclean and again.read(k8(1)) == b"good"
    assert again.recover() == ["batch-000000001"]
    assert not Store.open(spark, path).unclean


@pytest.mark.parametrize("bad", [[(b"short", 0, b"v")], [(b"much too long", 0, b"v")]])
def test_keys_of_another_length_are_refused(spark, tmp_path, bad):
    store = Store.open(spark, f"file://{tmp_path}/db")
    with pytest.raises(StoreError) as e:
        store.write(rows_of(spark, bad))
    assert e.value.code is Code.INVALID_ARGUMENT
    store.refresh()
    assert store.batches == []
    with pytest.raises(StoreError):
        store.write(spark.createDataFrame([(bytearray(8), bytearray(b"v"))], "key binary, value binary"))


def test_raw_records_round_trip_and_trim(spark, tmp_path):
    log = rows_of(spark, [(bytes([i % 3]) + k8(i)[1:], i // 3, b"") for i in range(60)])
    assert raw.write_records(log, str(tmp_path / "raw")) == [(0, 20), (4, 20), (8, 20)]
    back = raw.trimmed(raw.read_records_by_file(spark, str(tmp_path / "raw")))
    assert sorted((bytes(r["key"]), r["seq"]) for r in back.collect()) == sorted((bytes(r["key"]), r["seq"]) for r in log.collect())
    zero = tmp_path / "wal"
    zero.write_bytes(bytes(12) + k8(9) + (1).to_bytes(4, "little") + bytes(8) + (2).to_bytes(4, "little") + bytes(36))
    kept = raw.trimmed(raw.read_records(spark, str(zero))).orderBy("position").collect()
    assert [(bytes(r["key"]), r["seq"]) for r in kept] == [(bytes(8), 0), (k8(9), 1), (bytes(8), 2)]


def test_raw_records_as_a_data_source(spark, tmp_path, monkeypatch):
    from keyloom.sources import records

    log = rows_of(spark, [(bytes([i % 3]) + k8(i)[1:], i // 3, b"") for i in range(60)])
    raw.write_records(log, str(tmp_path / "raw"))
    (tmp_path / "raw" / "wal-9").write_bytes(bytes(12) + k8(9) + (1).to_bytes(4, "little") + bytes(36))
    records.register(spark)
    got = spark.read.format("wal12").load(str(tmp_path / "raw"))
    want = [(bytes(r["key"]), r["seq"]) for r in log.collect()] + [(bytes(8), 0), (k8(9), 1)]
    assert sorted((bytes(r["key"]), r["seq"]) for r in got.collect()) == sorted(want)
    assert spark.read.format("wal12").option("trim", "false").load(str(tmp_path / "raw" / "wal-9")).count() == 5


def test_streaming_latest_equals_batch(spark, tmp_path):
    path = str(tmp_path / "log")
    for b in range(3):
        rows_of(spark, [(k8(i % 20), b * 100 + i, b"%d/%d" % (b, i)) for i in range(100)]).coalesce(1).write.mode("append").parquet(path)
    stream = streaming.latest_stream(streaming.read_stream(spark, path, SCHEMA, 1))
    got = streaming.run_to_memory(stream, "latest_in_test", f"file://{tmp_path}/ck")
    want = views.latest(spark.read.schema(SCHEMA).parquet(path))
    assert got.select("key", "seq", "value").exceptAll(want).count() == 0 and got.count() == 20
    store = Store.open(spark, f"file://{tmp_path}/db")
    streaming.merge_batches(streaming.read_stream(spark, path, SCHEMA, 1), store, f"file://{tmp_path}/ck2")
    assert store.view().exceptAll(want).count() == 0 and len(store.batches) == 3


def test_workloads(spark):
    rows = workload.seeded(spark, 3, 10, 64)
    assert rows.filter((F.octet_length("value") == 64) & (F.substring("value", 1, 8) == F.col("key"))).count() == 30
    assert rows.select("key").distinct().count() == 30
    twice = workload.double_write(rows.withColumn("n", F.col("seq")), "n", F.lit("first"), F.lit("second"))
    assert twice.count() == 60 and {r["value"] for r in views.latest(twice).collect()} == {"second"}


def test_empty_log(spark, tmp_path):
    store = Store.open(spark, f"file://{tmp_path}/db")
    assert store.range().count() == 0 and store.log.last_seq() == -1
    assert views.positioned(store.view()).count() == 0
    assert store.multi_get(spark.createDataFrame([(bytearray(8),)], "key binary")).first()["found"] == 0


def test_value_slots_are_read_by_position(spark, tmp_path):
    folder = str(tmp_path / "raw")
    log = rows_of(spark, [(bytes([64 * (i % 3)]) + k8(i)[1:], i // 3, b"value %d" % i) for i in range(60)])
    raw.write_values(log, folder, width=32)
    assert sorted(os.path.getsize(tmp_path / "raw" / f) for f in os.listdir(tmp_path / "raw") if not f.startswith(".")) == [640] * 3
    asked = spark.createDataFrame([(256 * (i % 3), i // 3, i) for i in range(0, 60, 7)] + [(0, 20, -1), (0, -1, -1), (5, 0, -1)], "shard bigint, seq bigint, i int")
    got = {(r["shard"], r["seq"], r["i"]): r["value"] for r in raw.read_values(asked, folder, 32).collect()}
    assert all(v is None if i < 0 else bytes(v).rstrip(b"\0") == b"value %d" % i and len(v) == 32 for (_, _, i), v in got.items()) and len(got) == 12
    with pytest.raises(Exception, match="INVALID_ARGUMENT"):
        raw.write_values(log, str(tmp_path / "narrow"), width=4)


@pytest.mark.parametrize("grow", [1, 16, 20])
def test_zero_tails_are_trimmed(spark, tmp_path, grow):
    from keyloom.sources import records

    log = rows_of(spark, [(bytes([i % 3]) + k8(i)[1:], i // 3, b"") for i in range(60)])
    raw.write_records(log, str(tmp_path / "raw"), grow=grow)
    records.register(spark)
    sizes = [os.path.getsize(tmp_path / "raw" / f) // 12 for f in os.listdir(tmp_path / "raw") if f.startswith("wal-")]
    assert all(n > 20 and n % grow == 0 for n in sizes)
    assert spark.read.format("wal12").load(str(tmp_path / "raw")).count() == 60 == raw.trimmed(raw.read_records_by_file(spark, str(tmp_path / "raw"))).count()


def test_earlier_batch_wins_a_tie(spark, tmp_path):
    store = Store.open(spark, f"file://{tmp_path}/db")
    for v in (b"z first", b"a second"):
        store.write(rows_of(spark, [(k8(1), 5, v), (k8(2), 0, v)]))
    store.refresh()
    assert store.read(k8(1)) == b"z first"
    store.compact()
    store.write(rows_of(spark, [(k8(1), 5, b"a third")]))
    store.refresh()
    assert store.read(k8(1)) == b"z first"


def test_batch_records_and_files_replaced_in_one_step(spark, tmp_path):
    store = Store.open(spark, f"file://{tmp_path}/db")
    store.write(rows_of(spark, [(k8(1), 41, b"v"), (k8(2), 7, b"v")]))
    store.write(rows_of(spark, []))
    assert store.log.last_seq() == 41
    os.remove(tmp_path / "db/log/batch-000000000/_batch.json")
    assert store.log.last_seq() == 41
    store.files.write_text("a.txt", "one")
    store.files.write_text("a.txt", "two")
    assert store.files.read_text("a.txt") == "two" and [f for f in os.listdir(tmp_path / "db") if "new" in f] == []


def test_cached_view_goes_with_refresh_and_close(spark, tmp_path):
    store = Store.open(spark, f"file://{tmp_path}/db")
    store.write(rows_of(spark, [(k8(i), i, b"v") for i in range(9)]))
    store.refresh()
    kept = store.cached(k8(3))
    assert kept.count() == 6 and kept.storageLevel.useMemory
    store.close()
    assert not kept.storageLevel.useMemory
