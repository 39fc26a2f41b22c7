"""Every registered query against its SQL in another engine."""

import os

import duckdb
import pytest

from keyloom.plans import catalogue


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in os.listdir(sf_dir):
        c.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{t}'")
    return c


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query_agrees_with_sql(spark, duck, sf_dir, name):
    df = catalogue.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    result = duck.execute(catalogue.ORACLE[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = sorted((tuple(r[names.index(c)] for c in columns) for r in result.fetchall()), key=repr)
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr) == want


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
