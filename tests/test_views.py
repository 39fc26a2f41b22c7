"""Views of a log against a dict model and literal cases."""

import threading

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from keyloom.errors import Code, StoreError
from keyloom.operators import checks, recovery, shared, views

WRITES = [("5AFF", 0xFF), ("5AEE", 0xEE), ("5ADD", 0xDD), ("5AFF", 0xFF), ("5AEE", 0x22), ("5ADD", 0x33), ("5ADD", 0x44)]
FIVE = ["0000000000000000", "3F00000000000000", "4000000000000000", "8000000000000000", "FFFFFFFFFFFFFFFF"]


def key(h):
    return bytes.fromhex(h.ljust(16, "0"))


def log_of(spark, rows):
    return spark.createDataFrame([(bytearray(k), s, bytearray(v)) for k, s, v in rows], "key binary, seq bigint, value binary")


def test_last_write_wins(spark):
    log = log_of(spark, [(key(k), i, bytes([0, v])) for i, (k, v) in enumerate(WRITES)])
    want = [(key("5ADD"), 6, 0x44), (key("5AEE"), 4, 0x22), (key("5AFF"), 3, 0xFF)]
    for view in (views.latest(log), views.latest_by_join(log)):
        assert [(bytes(r["key"]), r["seq"], r["value"][1]) for r in view.orderBy("key").collect()] == want
    assert tuple(views.dedup_stats(log).first()) == (7, 3, 4)
    assert {bytes(r["key"]): r["seq"] for r in views.index(log).collect()} == {k: s for k, s, _ in want}


@pytest.mark.parametrize(
    ("lower", "upper", "want"),
    [(None, None, [0, 1, 2, 3, 4]), ("3F", "80", [1, 2]), ("80", None, [3, 4]), (None, "FFFFFFFFFFFFFFFF", [0, 1, 2, 3]), ("40", "40", []), ("80", "3F", []), ("0100", "3F", [])],
)
def test_range_bounds(spark, lower, upper, want):
    log = log_of(spark, [(key(k), i, b"x") for i, k in enumerate(reversed(FIVE))])
    rows = views.range_scan(views.latest(log), lower and key(lower), upper and key(upper)).collect()
    assert [bytes(r["key"]) for r in rows] == [key(FIVE[i]) for i in want]


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.binary(min_size=8, max_size=8).map(lambda b: bytes([b[0]]) + bytes(6) + bytes([b[1] % 3])), st.binary(max_size=3)), min_size=1, max_size=60))
def test_model(spark, writes):
    model = dict(writes)
    view = views.latest(log_of(spark, [(k, i, v) for i, (k, v) in enumerate(writes)]))
    rows = views.positioned(view).orderBy("pos").collect()
    assert [(bytes(r["key"]), bytes(r["value"])) for r in rows] == sorted(model.items())
    assert [r["pos"] for r in rows] == list(range(len(model)))
    asked = sorted({k for k, _ in writes[:5]} | {b"\x00" * 8, b"\xff" * 8, b"\x80" + bytes(7)})
    q = spark.createDataFrame([(bytearray(k),) for k in asked], "q binary")
    floor = {bytes(r["q"]): r["floor"] and bytes(r["floor"]) for r in views.floor(view, q).collect()}
    assert floor == {k: max((x for x in model if x <= k), default=None) for k in asked}
    found = views.multi_get(view, q.select(F.col("q").alias("key"))).collect()
    assert {bytes(r["key"]): r["found"] for r in found} == {k: int(k in model) for k in asked}


def test_get_needs_a_whole_key(spark):
    view = views.latest(log_of(spark, [(key("01"), 0, b"x")]))
    with pytest.raises(StoreError) as e:
        views.get(view, b"\x01")
    assert e.value.code is Code.INVALID_ARGUMENT
    assert views.get(view, key("02")).count() == 0


def test_order_and_value_checks(spark):
    rows = spark.createDataFrame([(bytearray(key(k)), p, bytearray(key(v))) for p, (k, v) in enumerate([("01", "01"), ("03", "03"), ("02", "09"), ("02", "02")])], "key binary, pos bigint, value binary")
    assert tuple(checks.order_violations(rows).first()) == (2, 4)
    assert tuple(checks.prefix_mismatches(rows).first()) == (1, 4)
    assert tuple(checks.length_mismatches(rows, 8).first()) == (0, 4)


def test_pages_and_batches(spark):
    view = views.positioned(log_of(spark, [(i.to_bytes(8, "big"), i, b"") for i in range(600)]))
    assert [(r["page"], int.from_bytes(r["key"], "big")) for r in views.page_directory(view.drop("pos"), 256).orderBy("page").collect()] == [(0, 0), (1, 256), (2, 512)]
    assert [(r["batch"], r["n"]) for r in views.batches(view).orderBy("batch").collect()] == [(0, 256), (1, 256), (2, 88)]


def test_recovery_of_an_overlapping_tail(spark):
    rows = [(i % 700).to_bytes(8, "big") for i in range(10000)]
    full = log_of(spark, [(k, i, str(i).encode()) for i, k in enumerate(rows)])
    got = recovery.recovered(full.filter("seq < 9000"), full.filter("seq >= 8990"))
    assert got.exceptAll(views.latest(full)).count() == 0
    assert recovery.torn(full.unionByName(full)).count() == 0
    assert recovery.torn(full.unionByName(log_of(spark, [(rows[5], 5, b"other")]))).count() == 1


def test_shared_scan_makes_one_pass_for_all(spark):
    view = views.latest(log_of(spark, [(key(k), i, b"abc") for i, k in enumerate(FIVE)]))
    visitors = [shared.Visitor("all"), shared.Visitor("mid", key("3F"), key("80")), shared.Visitor("none", key("80"), key("3F"))]
    assert shared.visit(view, visitors).first().asDict() == {"all_n": 5, "mid_n": 2, "none_n": 0}
    with pytest.raises(StoreError):
        shared.visit(view, [])


def test_rides_are_shared_by_count_and_by_time(spark):
    view = views.latest(log_of(spark, [(key(k), i, b"abc") for i, k in enumerate(FIVE)]))
    ride, out = shared.Ride(view, calls=8, seconds=30), {}
    threads = [threading.Thread(target=lambda i=i: out.__setitem__(i, ride.submit(shared.Visitor("x", key(FIVE[i % 5]))))) for i in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert ride.passes == 1
    assert all(out[i]["n"] == 5 - i % 5 for i in range(8))
    ride.close()
    late = shared.Ride(view, calls=64, seconds=0.2)
    assert late.submit(shared.Visitor("alone"))["n"] == 5
    assert late.submit(shared.Visitor("second", None, key("40")))["n"] == 2
    late.close()
    with pytest.raises(StoreError):
        late.submit(shared.Visitor("after"))


def test_filters_reach_the_files(spark, tmp_path):
    log = log_of(spark, [(i.to_bytes(8, "big"), i, b"v") for i in range(100)])
    log.write.parquet(str(tmp_path / "log"))
    view = views.latest(spark.read.parquet(str(tmp_path / "log")))
    plan = views.get(view, (5).to_bytes(8, "big"))._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(key" in plan
    plan = views.range_scan(view, (5).to_bytes(8, "big"), (9).to_bytes(8, "big"))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(key" in plan and "LessThan(key" in plan
    plan = views.index(spark.read.parquet(str(tmp_path / "log")))._jdf.queryExecution().executedPlan().toString()
    assert "value" not in plan.split("ReadSchema:")[1]


def test_positions_of_keys_that_share_their_first_bytes(spark, monkeypatch):
    monkeypatch.setattr(views, "PARTS", 8)
    rows = spark.createDataFrame([(bytearray(b"\x3f\x00" + i.to_bytes(6, "big")), i) for i in range(500)] + [(bytearray(b"\xff" * 8), 500)], "key binary, i int")
    got = views.positioned(rows).collect()
    assert {r["i"]: r["pos"] for r in got} == {i: i for i in range(501)}
    parts = rows.withColumn("p", views.spread(rows, F.col("i").cast("bigint"))).groupBy("p").count().collect()
    assert len(parts) == 8 and max(r["count"] for r in parts) < 100
    seq = views.sequenced(rows, "i", 10).collect()
    assert {r["i"]: r["seq"] for r in seq} == {**{i: i for i in range(500)}, 500: 0}
    assert views.positioned(rows.filter("false")).count() == 0


def test_order_check_finds_violations(spark):
    rows = spark.createDataFrame([(bytearray(bytes([k] * 8)), p) for p, k in enumerate([1, 2, 2, 5, 4, 9, 1])], "key binary, pos bigint")
    assert tuple(checks.order_violations(rows).first()) == (3, 7)


def test_row_visitors_get_their_rows_in_order(spark):
    import pyarrow as pa

    rows = spark.createDataFrame([(bytearray(bytes([k] * 8)), bytearray(b"v")) for k in (200, 3, 90, 128, 7, 255)], "key binary, value binary").repartition(3)

    def make():
        return lambda b: pa.RecordBatch.from_arrays([pa.array([k[0] for k in b.column("key").to_pylist()], pa.int64())], names=["first"])

    visitors = [shared.RowVisitor("low", None, bytes([128] * 8), make), shared.RowVisitor("mid", bytes([7] * 8), bytes([200] * 8), make), shared.RowVisitor("none", bytes([9] * 8), bytes([8] * 8), make)]
    out = {}
    for r in shared.visit_rows(rows, visitors, "first bigint").collect():
        out.setdefault(r["visitor"], []).append(r["first"])
    assert out == {"low": [3, 7, 90], "mid": [7, 90, 128]}
