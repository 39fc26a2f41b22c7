"""Queries that take a whole table, where the smallest tables would not show a part."""

import duckdb
import pytest

from keyloom.operators import views
from keyloom.plans import catalogue
from keyloom.sources import raw


def test_all_shards_are_written_and_returned(spark, sf_dir, monkeypatch):
    counts, write = [], raw.write_records
    monkeypatch.setattr(raw, "write_records", lambda *a, **b: counts.append(write(*a, **b)) or counts[-1])
    events = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    shown = catalogue.kv_raw_log(spark, sf_dir)
    assert sum(n for _, n in counts[0]) == events == shown.count() and max(shard for shard, _ in counts[0]) >= 256
    assert {r["shard"] for r in shown.select("shard").distinct().collect()} == {shard for shard, _ in counts[0]}


@pytest.mark.parametrize("bound", [200_000, 100])
@pytest.mark.parametrize("name", ["kv_multi_get", "kv_hit_count", "kv_found", "kv_missing"])
def test_lookups_ask_for_all_customers(spark, sf_dir, monkeypatch, name, bound):
    """With keys that are broadcast and with keys that are joined by shuffle."""
    monkeypatch.setattr(views, "BROADCAST_KEYS", bound)
    larger = sf_dir.replace("sf0.001", "sf0.01")
    duck = duckdb.connect()
    for t in ("customer", "events"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{larger}/{t}.parquet'")
    result = duck.execute(catalogue.ORACLE[name])
    columns = [d[0] for d in result.description]
    want = sorted(result.fetchall(), key=repr)
    assert sorted((tuple(r) for r in catalogue.QUERIES[name](spark, larger).select(columns).collect()), key=repr) == want
    assert catalogue.asked_keys(spark, larger).count() == 1500
