"""Every registered query against its SQL."""

import os

import duckdb
import pytest

from keyloom.plans import catalog, mutations  # noqa: F401 (registers its queries)

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for t in os.listdir(DATA):
        c.sql(f"create view {t[:-8]} as select * from '{DATA}/{t}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sql, name):
    got, want = catalog.QUERIES[name](spark, DATA), sql.sql(catalog.ORACLE_SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    assert sorted(repr(tuple(r[c] for c in columns)) for r in got.collect()) == sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall())


def test_get_many_has_no_ceiling(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1.0), (2, 2.0), (10**7, 3.0), (10**12, 4.0), (-2, 5.0)], "o_orderkey long, o_totalprice double")
    rows.write.parquet(f"{tmp_path}/orders.parquet")
    assert sorted(r.o_orderkey for r in catalog.get_many(spark, str(tmp_path)).collect()) == [1, 10**7, 10**12]
