"""Record codecs and batch compression by name."""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .errors import ConfigError


class JsonCodec:
    """Records as compact JSON text in one column."""

    def __init__(self, schema: str, column: str = "value"):
        self.schema, self.column = schema, column

    def decode(self, df: DataFrame) -> DataFrame:
        rest = [c for c in df.columns if c != self.column]
        return df.select(*rest, F.from_json(self.column, self.schema).alias("_v")).select(*rest, "_v.*")

    def encode(self, df: DataFrame, keep: list[str]) -> DataFrame:
        return df.select(*keep, F.to_json(F.struct(*[c for c in df.columns if c not in keep])).alias(self.column))


class KeyCodec:
    """Records that are key tuples, in packed form."""

    def __init__(self, column: str = "value"):
        self.column = column

    def decode(self, df: DataFrame) -> DataFrame:
        from ..functions.keycodec import unpack_column

        return df.withColumn(self.column, unpack_column(F.col(self.column)))


def _each(f):
    @F.pandas_udf("binary")
    def of(c: pd.Series) -> pd.Series:
        return c.map(lambda x: None if x is None else f(bytes(x)))

    return of


def compress(c: F.Column) -> F.Column:
    """zlib form of bytes."""
    return _each(zlib.compress)(c)


def decompress(c: F.Column) -> F.Column:
    return _each(zlib.decompress)(c)


class Registry:
    """Codecs by name, each with a number; a store keeps the numbers."""

    def __init__(self, numbers: dict[str, int] | None = None):
        self.numbers = {"KEY": 1, "JSON": 2, "PLAIN": 3, "ZLIB": 4} | (numbers or {})
        self.codecs = {"PLAIN": (lambda c: c, lambda c: c), "ZLIB": (compress, decompress)}

    def add(self, name: str, encode, decode) -> int:
        if len(self.numbers) >= 240:
            raise ConfigError("no number left for a codec")
        self.codecs[name] = (encode, decode)
        return self.numbers.setdefault(name, max(self.numbers.values()) + 1)

    def get(self, name: str):
        if name not in self.codecs:
            raise ConfigError(f"no codec {name}")
        return self.codecs[name]
