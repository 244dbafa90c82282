import datetime
import uuid

import pytest
from pyspark.sql import functions as F

from keyloom.functions import keycodec as kc

UTC = datetime.timezone.utc
GOLDEN = [
    ((None,), "0f"), ((0,), "1500"), ((1,), "1501"), ((240,), "15f0"), ((241,), "15f101"), ((2287,), "15f8ff"), ((2288,), "15f90000"), ((67823,), "15f9ffff"), ((67824,), "15fa0108f0"), ((16777215,), "15faffffff"),
    ((16777216,), "15fb01000000"), ((4294967296,), "15fc0100000000"), ((-1,), "14fe"), ((-240,), "140f"), ((-241,), "140efe"), ((-2288,), "1406ffff"), ((-67824,), "1405fef70f"), ((False,), "1e00"), ((True,), "1e01"),
    ((b"",), "28"), ((b"a",), "28b0c0"), ((b"dave",), "28b298aee6a8"), ((b"dave\0\0",), "28b298aee6a88080"), ((b"abcdefg",), "28b0d8ccb6a395cce7"), (("dave",), "32b298aee6a8"), (("é",), "32e1eaa0"), (("", 1), "321501"),
    ((uuid.UUID(int=2**128 - 1),), "5a" + "ff" * 16), ((datetime.datetime(1970, 1, 1),), "5c40"), ((datetime.datetime(1970, 2, 1),), "5cfc4fd2920040"), ((datetime.datetime(1969, 1, 1),), "5b02fc54276a003f"),
    ((datetime.datetime(2024, 1, 1, 0, 0, 7, 179575),), "5cfdc661290805c0"), ((datetime.datetime(2024, 1, 1, 1, tzinfo=datetime.timezone(datetime.timedelta(hours=1))),), "5cfdc66128fa0044"), ((613, 15122, 5124324, 13), "15f27515f9322215fa4e30e4150d"),
]


@pytest.mark.parametrize("key, form", GOLDEN)
def test_golden(key, form):
    assert kc.pack(key).hex() == form


@pytest.mark.parametrize("key, form", GOLDEN)
def test_round_trip(key, form):
    for x, (kind, value) in zip(key, kc.unpack(bytes.fromhex(form)), strict=True):
        if isinstance(x, bytes):
            assert (kind, value) == ("bytes", x.hex())
        elif isinstance(x, datetime.datetime):
            assert datetime.datetime.fromisoformat(value) == (x if x.tzinfo else x.replace(tzinfo=UTC)).replace(microsecond=x.microsecond // 1000 * 1000)
        elif isinstance(x, bool):
            assert value == str(x).lower()
        else:
            assert value == (None if x is None else str(x))


def test_expressions_give_the_same_form(spark):
    ints = [None, 0, 1, 240, 241, 2287, 2288, 67823, 67824, 2**24 - 1, 2**24, 2**32 - 1, 2**32, 2**40, 2**48, 2**56 - 1, 2**56, 2**63 - 1, -1, -241, -2288, -67824, -(2**40)]
    for r in spark.createDataFrame([(x,) for x in ints], "x long").select("x", kc.pack_int(F.col("x")).alias("k")).collect():
        assert bytes(r.k) == kc.pack((r.x,))
    rows = spark.createDataFrame([("a", b"\0\xff", True, "1969-12-31 23:59:59.9995"), ("é😀", b"", False, "2024-01-01 00:00:07.179575"), (None, None, None, None)], "t string, b binary, o boolean, d string").withColumn("d", F.col("d").cast("timestamp_ntz"))
    packed = rows.select("*", kc.pack_text(F.col("t")).alias("kt"), kc.pack_bytes(F.col("b")).alias("kb"), kc.pack_bool(F.col("o")).alias("ko"), kc.pack_time(F.col("d")).alias("kd"))
    for r in packed.collect():
        assert (bytes(r.kt), bytes(r.kb), bytes(r.ko)) == (kc.pack((r.t,)), kc.pack((bytes(r.b) if r.b is not None else None,)), kc.pack((r.o,)))
        assert bytes(r.kd) == kc.pack((r.d,))


def test_packed_order_is_the_tuples_order():
    ordered = [(None,), (-(2**40),), (-2,), (-1,), (0,), (1,), (1, None), (1, 0), (240,), (241,), (67824,), (False,), (True,), (b"",), (b"", 1), (b"a",), (b"ab",), ("",), ("", 1), ("a", 1), ("a", 2), ("ab",), (uuid.UUID(int=0),), (datetime.datetime(1969, 1, 1),), (datetime.datetime(1970, 1, 1),), (datetime.datetime(1970, 2, 1),)]
    assert sorted(ordered, key=kc.pack) == ordered


def test_wrong_kinds():
    with pytest.raises(TypeError):
        kc.pack((1.5,))
    with pytest.raises(ValueError):
        kc.pack((2**64,))
