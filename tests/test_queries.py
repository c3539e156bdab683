"""Every query with SQL gives the rows that DuckDB gives on the smallest tables."""

import os

import pytest

from tessera import catalog

D = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(D):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{D}/{f}'")
    return c


def canonical(frame):
    cols = sorted(frame.columns)
    return cols, frame[cols].map(lambda v: None if v is None or v != v else v).astype(str).sort_values(cols).values.tolist()


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_against_sql(spark, duck, name):
    got = catalog.queries()[name](spark, D).toPandas()
    assert canonical(got) == canonical(duck.execute(catalog.oracle_sql()[name]).df())


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(spark, name):
    assert catalog.queries()[name](spark, D).count() >= 1
