"""Secondary indexes: ordered entries of (tuple, record key) derived from records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.bounds import KeySpec
from .collection import Collection, scan


class Index:
    """entries: columns of the tuple by name; with multi, one column of arrays of such structs.
    where: rows that have entries at all (a partial index). Equal entries of a record are one."""

    def __init__(self, of: Collection, name: str, entries: dict[str, F.Column] | F.Column, where: F.Column | None = None, multi: bool = False):
        self.of, self.name = of, name
        rows = of.df if where is None else of.df.where(where)
        if multi:
            rows = rows.select(F.explode(F.array_distinct(entries)).alias("_entry"), *of.key).select("_entry.*", *of.key)
        else:
            rows = rows.select(*[c.alias(n) for n, c in entries.items()], *of.key)
        self.df = rows
        self.tuple = [c for c in rows.columns if c not in of.key]
        self.spec = KeySpec(rows.schema, self.tuple)
        self.full = KeySpec(rows.schema, self.tuple + of.key)

    def pairs(self, key=None, lo=None, hi=None, prefix=None, include=False, reverse=False, max=None) -> DataFrame:  # noqa: A002
        """Entries by tuple, then record key; bounds are on the tuple."""
        condition = self.spec.where(key, lo, hi, prefix, include)
        rows = self.df if condition is None else self.df.where(condition)
        return scan(rows, self.full, reverse=reverse, max=max)

    def tups(self, **bounds) -> DataFrame:
        """Tuples only: answered from the index."""
        return self.pairs(**bounds).select(*self.tuple)

    def keys(self, **bounds) -> DataFrame:
        return self.pairs(**bounds).select(*self.of.key)

    def items(self, reverse: bool = False, **bounds) -> DataFrame:
        """Entries with their records, in index order; entries of missing records go."""
        found = self.pairs(reverse=reverse, **bounds)
        records = self.of.df.drop(*[c for c in self.tuple if c in self.of.df.columns])
        return found.join(records, self.of.key).orderBy(*self.full.order(reverse))

    def values(self, **bounds) -> DataFrame:
        return self.items(**bounds).drop(*self.of.key)

    def count(self, **bounds) -> DataFrame:
        return self.pairs(**bounds).agg(F.count("*").alias("n"))

    def has(self, key) -> DataFrame:
        """One row: whether an entry with exactly this tuple is there."""
        return self.df.where(self.spec.exactly(key)).limit(1).agg((F.count("*") > 0).alias("has"))

    def find(self, **bounds) -> DataFrame:
        return self.items(max=1, **bounds)

    def get(self, key) -> DataFrame:
        """The record with the lowest key among those with this tuple."""
        found = self.df.where(self.spec.exactly(key)).orderBy(*self.full.order()).limit(1)
        return found.select(*self.of.key).join(self.of.df, self.of.key)

    def stale(self, records: DataFrame) -> DataFrame:
        """Entries whose record is gone from records."""
        return self.df.join(records, self.of.key, "left_anti")

    def first_per_prefix(self, n: int = 1) -> DataFrame:
        """The least rest of the tuple for each value of its first n elements."""
        head, rest = self.tuple[:n], self.tuple[n:]
        least = self.df.groupBy(*head).agg(F.min(F.struct(*rest)).alias("_least"))
        return least.select(*head, "_least.*")

    def groups(self, by: list[str], value: str, name: str = "keys") -> DataFrame:
        """The values of each group in index order, as one array: for groups that fit in a row; pairs() has them as rows."""
        rest = [c for c in self.tuple if c not in by]
        entries = F.array_sort(F.collect_list(F.struct(*rest, *[c for c in self.of.key if c not in rest])))
        return self.df.groupBy(*by).agg(F.transform(entries, lambda x: x[value]).alias(name))
