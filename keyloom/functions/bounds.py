"""Predicates over compound keys: exact, prefix and range bounds in one total order.

Keys compare element by element; a tuple that is a prefix of another comes first. Elements of
different kinds at one place compare by kind, and a missing element (None) comes before all. The
predicates are spelt out as comparisons of single columns, which Spark pushes into Parquet scans.
"""

from __future__ import annotations

import datetime
import operator
import uuid
from functools import reduce

from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Order of the kinds of elements. Fixed values.
KINDS = ("none", "int", "bool", "bytes", "text", "uuid", "time")


def kind_of_value(value) -> str:
    for kind, types in (("none", type(None)), ("bool", bool), ("int", int), ("bytes", (bytes, bytearray)), ("text", str), ("uuid", uuid.UUID), ("time", datetime.datetime)):
        if isinstance(value, types):
            return kind
    raise TypeError(f"{type(value).__name__} can't be part of a key")


def kind_of_type(t: T.DataType) -> str:
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)) or isinstance(t, T.DecimalType) and t.scale == 0:
        return "int"
    for kind, types in (("bool", T.BooleanType), ("bytes", T.BinaryType), ("text", T.StringType), ("time", (T.TimestampType, T.TimestampNTZType))):
        if isinstance(t, types):
            return kind
    raise TypeError(f"{t.simpleString()} can't be part of a key")


def _lit(value) -> F.Column:
    return F.lit(str(value) if isinstance(value, uuid.UUID) else value)


def as_tuple(bound) -> tuple:
    return tuple(bound) if isinstance(bound, (tuple, list)) else (bound,)


class KeySpec:
    """The ordered key columns of a table. uuids: those that hold UUIDs as their usual text, in lower case."""

    def __init__(self, schema: T.StructType, columns: list[str], uuids: tuple[str, ...] = ()):
        self.columns = list(columns)
        self.kinds = ["uuid" if c in uuids else kind_of_type(schema[c].dataType) for c in columns]

    def order(self, reverse: bool = False) -> list[F.Column]:
        return [F.col(c).desc_nulls_last() if reverse else F.col(c).asc_nulls_first() for c in self.columns]

    def _parts(self, bound: tuple) -> list[tuple[F.Column, str, object]]:
        return [(F.col(c), k, b) for c, k, b in zip(self.columns, self.kinds, bound)]

    @staticmethod
    def _equal(c: F.Column, kind: str, b) -> F.Column:
        if b is None:
            return c.isNull()
        return c == _lit(b) if kind == kind_of_value(b) else F.lit(False)

    @staticmethod
    def _above(c: F.Column, kind: str, b) -> F.Column:
        if b is None:
            return c.isNotNull()
        if kind == (other := kind_of_value(b)):
            return c > _lit(b)
        return c.isNotNull() if KINDS.index(kind) > KINDS.index(other) else F.lit(False)

    @staticmethod
    def _below(c: F.Column, kind: str, b) -> F.Column:
        if b is None:
            return F.lit(False)
        if kind == (other := kind_of_value(b)):
            return c.isNull() | (c < _lit(b))
        return F.lit(True) if KINDS.index(kind) < KINDS.index(other) else c.isNull()

    def at_least(self, bound, closed: bool = True) -> F.Column:
        """key >= bound, or key > bound. A longer key that begins with the bound is above it."""
        bound = as_tuple(bound)
        if len(bound) != len(self.columns):
            closed = len(bound) < len(self.columns)
        return self._chain(bound, self._above, closed)

    def at_most(self, bound, closed: bool = False) -> F.Column:
        """key < bound, or key <= bound."""
        bound = as_tuple(bound)
        if len(bound) != len(self.columns):
            closed = len(bound) > len(self.columns)
        return self._chain(bound, self._below, closed)

    def _chain(self, bound: tuple, side, closed: bool) -> F.Column:
        parts = self._parts(bound)
        if not parts:
            return F.lit(closed)
        c, kind, b = parts[-1]
        if closed and b is not None and kind == kind_of_value(b):  # one comparison where one will do
            out = c >= _lit(b) if side == self._above else c.isNull() | (c <= _lit(b))
        else:
            out = side(c, kind, b) | self._equal(c, kind, b) if closed else side(c, kind, b)
        for part in reversed(parts[:-1]):
            out = side(*part) | (self._equal(*part) & out)
        return out

    def exactly(self, bound) -> F.Column:
        bound = as_tuple(bound)
        return self._all(bound) if len(bound) == len(self.columns) else F.lit(False)

    def starts(self, bound) -> F.Column:
        """Leading elements equal the bound's; a text or bytes at its end may go on."""
        bound = as_tuple(bound)
        if len(bound) > len(self.columns):
            return F.lit(False)
        if bound and isinstance(bound[-1], (str, bytes)):
            c, kind, b = self._parts(bound)[-1]
            last = F.startswith(c, F.lit(b)) if kind == kind_of_value(b) else F.lit(False)
            return self._all(bound[:-1]) & last if bound[:-1] else last
        return self._all(bound)

    def _all(self, bound: tuple) -> F.Column:
        return reduce(operator.and_, [self._equal(*p) for p in self._parts(bound)], F.lit(True))

    def where(self, key=None, lo=None, hi=None, prefix=None, include: bool = False) -> F.Column | None:
        """An exact key goes before a prefix, a prefix before lo and hi; None is unset."""
        if key is not None:
            return self.exactly(key)
        if prefix is not None:
            return self.starts(prefix)
        parts = ([self.at_least(lo)] if lo is not None else []) + ([self.at_most(hi, include)] if hi is not None else [])
        return reduce(operator.and_, parts) if parts else None
