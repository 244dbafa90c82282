"""Traces of changes as text lines: transaction, operation, key and value in hex."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.changes import fold


def write_trace(log: DataFrame, path: str) -> None:
    """log: seq, txn, op (put or delete), key and value (binary)."""
    line = F.concat_ws(" ", F.col("seq").cast("string"), F.col("txn").cast("string"), "op", F.hex("key"), F.coalesce(F.hex("value"), F.lit("-")))
    log.select(line.alias("value")).write.mode("overwrite").text(path)


def read_trace(spark: SparkSession, path: str) -> DataFrame:
    parts = F.split("value", " ")
    rows = spark.read.text(path).select(parts.alias("x"))
    return rows.select(F.col("x")[0].cast("long").alias("seq"), F.col("x")[1].alias("txn"), F.col("x")[2].alias("op"), F.unhex(F.col("x")[3]).alias("key"), F.unhex(F.col("x")[4]).alias("value"))


def replay(log: DataFrame) -> DataFrame:
    """key and value after all operations."""
    return fold(log, ["key"], ["seq"], F.col("op") == "delete").select("key", "value")
