"""Range algebra over single and compound keys, against Python's order of the packed form."""

import itertools

import pytest
from pyspark.sql import functions as F

from keyloom.functions.keycodec import pack
from keyloom.operators.collection import Collection

KEYS = ["A", "B", "BB", "BBC", "BBD", "C", "CC", "D"]


@pytest.fixture(scope="module")
def letters(spark):
    return Collection(spark.createDataFrame([(k, k) for k in KEYS], "k string, value string"), "k")


@pytest.mark.parametrize(
    "bounds, expected",
    [
        ({}, KEYS), ({"lo": "0"}, KEYS), ({"lo": "a"}, []), ({"lo": "B"}, KEYS[1:]), ({"lo": "BA"}, KEYS[2:]),
        ({"hi": "0", "include": True}, []), ({"hi": "a", "include": True}, KEYS), ({"hi": "B", "include": True}, ["A", "B"]), ({"hi": "B"}, ["A"]), ({"hi": "BA", "include": True}, ["A", "B"]),
        ({"key": "0"}, []), ({"key": "BA"}, []), ({"key": "B"}, ["B"]), ({"prefix": "B"}, ["B", "BB", "BBC", "BBD"]),
        ({"max": 1}, ["A"]), ({"max": 0}, []), ({"key": "B", "prefix": "C"}, ["B"]), ({"prefix": "B", "lo": "C"}, ["B", "BB", "BBC", "BBD"]),
        ({"lo": b"zzz"}, KEYS), ({"hi": b"zzz"}, []), ({"lo": 5}, KEYS),
    ],
)
def test_cases(letters, bounds, expected):
    assert [r.k for r in letters.keys(**bounds).collect()] == expected
    if "key" not in bounds and "max" not in bounds:
        assert [r.k for r in letters.keys(reverse=True, **bounds).collect()] == expected[::-1]


def test_compound_bounds_follow_the_packed_order(spark):
    values = [None, -2, 0, 3]
    keys = list(itertools.product(values, values))
    c = Collection(spark.createDataFrame(keys, "a int, b int"), ["a", "b"])
    got = {}
    bounds = [t for n in (1, 2, 3) for t in itertools.product(values, repeat=n)]
    columns = [c.spec.at_least(t).alias(f"lo{i}") for i, t in enumerate(bounds)] + [c.spec.at_most(t).alias(f"hi{i}") for i, t in enumerate(bounds)] + [c.spec.at_most(t, True).alias(f"in{i}") for i, t in enumerate(bounds)]
    for r in c.df.select("a", "b", *[F.coalesce(x, F.lit(False)).alias(n) for x, n in zip(columns, [f"{k}{i}" for k in ("lo", "hi", "in") for i in range(len(bounds))])]).collect():
        got[r.a, r.b] = r
    for key, r in got.items():
        for i, t in enumerate(bounds):
            assert r[f"lo{i}"] == (pack(key) >= pack(t)), (key, t)
            assert r[f"hi{i}"] == (pack(key) < pack(t)), (key, t)
            assert r[f"in{i}"] == (pack(key) <= pack(t)), (key, t)


def test_order_has_missing_elements_first(spark):
    c = Collection(spark.createDataFrame([(1, None), (None, 2), (1, 0)], "a int, b int"), ["a", "b"])
    assert [tuple(r) for r in c.keys().collect()] == [(None, 2), (1, None), (1, 0)]
    assert [tuple(r) for r in c.keys(reverse=True).collect()] == [(1, 0), (1, None), (None, 2)]


def test_filters_reach_the_scan(spark, tmp_path):
    spark.range(1000).selectExpr("id k", "id * 2 v").write.parquet(str(tmp_path / "t"))
    c = Collection(spark.read.parquet(str(tmp_path / "t")), "k")
    plan = c.keys(lo=100, hi=200, reverse=True, max=5)._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(k,100)" in plan and "LessThan(k,200)" in plan and "TakeOrderedAndProject" in plan and "ReadSchema: struct<k:bigint>" in plan
