"""Collections: records clustered by an ordered key, and their scans."""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bounds import KeySpec
from .shared import cut


def scan(df: DataFrame, spec: KeySpec, key=None, lo=None, hi=None, prefix=None, include: bool = False, reverse: bool = False, max: int | None = None) -> DataFrame:  # noqa: A002
    """Rows within the bounds, in key order or from its end, at most max. An exact key takes neither reverse nor max."""
    condition = spec.where(key, lo, hi, prefix, include)
    if condition is not None:
        df = df.where(condition)
    df = df.orderBy(*spec.order(reverse and key is None))
    return df.limit(max) if max is not None and key is None else df


class Collection:
    """A table with declared key columns. Scans are lazy; filters and columns reach the source's scan."""

    def __init__(self, df: DataFrame, key: list[str] | str, name: str = "collection", codec=None, uuids: tuple[str, ...] = ()):
        """codec: decodes the record column where a scan isn't raw; uuids: key columns that hold UUIDs as text."""
        self.df, self.name, self.codec = df, name, codec
        self.key = [key] if isinstance(key, str) else list(key)
        self.spec = KeySpec(df.schema, self.key, uuids)
        self.indices: dict = {}

    def items(self, raw: bool = False, **bounds) -> DataFrame:
        rows = scan(self.df, self.spec, **bounds)
        return self.codec.decode(rows) if self.codec and not raw else rows

    def keys(self, **bounds) -> DataFrame:
        return scan(self.df.select(*self.key), self.spec, **bounds)

    def values(self, raw: bool = False, **bounds) -> DataFrame:
        return self.items(raw, **bounds).drop(*self.key)

    def find(self, **bounds) -> DataFrame:
        """The first row within the bounds (the last with reverse)."""
        return self.items(**bounds).limit(1)

    def find_key(self, reverse: bool = False, **bounds) -> DataFrame:
        """The first key; of a single column by an aggregate, which needs no sort."""
        if len(self.key) > 1:
            return self.keys(reverse=reverse, **bounds).limit(1)
        condition = self.spec.where(**bounds)
        rows = self.df if condition is None else self.df.where(condition)
        return rows.agg((F.max if reverse else F.min)(self.key[0]).alias(self.key[0]))

    def get(self, key, raw: bool = False) -> DataFrame:
        return self.items(raw, key=key)

    def get_many(self, keys: DataFrame) -> DataFrame:
        """Records of all given keys (rows of the key columns) in one join; missing keys give none, repeated ones one record."""
        return self.df.join(keys.select(*self.key), self.key, "left_semi")

    def has(self, key) -> bool:
        return bool(self.df.where(self.spec.exactly(key)).take(1))

    def add_index(self, name: str, entries, **kw):
        """entries: the tuple's columns by name, or an array of structs of them under multi=True."""
        from .index import Index

        self.indices[name] = Index(self, name, entries, **kw)
        return self.indices[name]

    def size(self, *columns: str) -> DataFrame:
        """Number of records, and bytes of the given text or binary columns, or of the records' JSON form."""
        parts = [F.octet_length(c) for c in columns] or [F.octet_length(F.to_json(F.struct(*self.df.columns)))]
        return self.df.agg(F.count("*").alias("n"), F.sum(reduce(operator.add, [F.coalesce(c, F.lit(0)) for c in parts])).cast("long").alias("bytes"))

    def clustered(self, path: str, partitions: int | None = None) -> None:
        """Writes the records sorted by key, so that each file and row group covers one key range."""
        n = partitions or int(self.df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        self.df.repartitionByRange(n, *self.spec.order()).sortWithinPartitions(*self.spec.order()).write.mode("overwrite").parquet(path)


def ranged(df: DataFrame, order: list[F.Column]) -> DataFrame:
    """df dealt into ranges of an order, each row's range as _part. Ranges come from a sample; once cut, they are the same whenever they are read."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()))


def ascending(columns: list[str]) -> list[F.Column]:
    return [F.col(c).asc_nulls_first() for c in columns]


def positions(df: DataFrame, order: list[F.Column], name: str = "pos") -> DataFrame:
    """Dense positions from 1 in a global order, without one task that sees all rows.

    Ranges are dealt out and sorted; each range's offset is the count of those before it.
    """
    rows = ranged(df, order)
    counts = rows.groupBy("_part").count()
    # one row for each range, as many as shuffle partitions
    before = counts.select("_part", (F.sum("count").over(Window.orderBy("_part")) - F.col("count")).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return rows.withColumn("_within", within).join(F.broadcast(before), "_part").withColumn(name, (F.col("_before") + F.col("_within")).cast("long")).drop("_part", "_before", "_within")


def previous_rows(df: DataFrame, order: list[F.Column], values: list[str], name: str) -> DataFrame:
    """Adds the given columns of the row before each in a global order, as a struct (null before the first)."""
    rows, value = ranged(df, order), F.struct(*values)
    within = Window.partitionBy("_part").orderBy(*order)
    numbered = rows.withColumns({"_n": F.row_number().over(within), name: F.lag(value).over(within)})
    last = numbered.groupBy("_part").agg(F.max_by(value, "_n").alias("_last"))
    carry = last.select("_part", F.lag("_last").over(Window.orderBy("_part")).alias("_carry"))  # one row for each range
    out = numbered.join(F.broadcast(carry), "_part").withColumn(name, F.when(F.col("_n") == 1, F.col("_carry")).otherwise(F.col(name)))
    return out.drop("_part", "_n", "_carry")


def sums_before(df: DataFrame, by: list[str], order: list[str], value: F.Column, name: str) -> DataFrame:
    """Adds the sum of value over the rows of the same group that stand before each; a group may span any number of ranges."""
    rows = ranged(df.withColumn("_value", value), ascending([*by, *order]))
    totals = rows.groupBy("_part", *by).agg(F.sum("_value").alias("_total"))
    # of each group one row for each range that it reaches
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(F.col("_part").alias("_of"), *[F.col(c).alias(f"_{c}") for c in by], F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_carry"))
    within = Window.partitionBy("_part", *by).orderBy(*ascending(order)).rowsBetween(Window.unboundedPreceding, -1)
    same = reduce(operator.and_, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by], F.col("_part") == F.col("_of"))
    out = rows.withColumn(name, F.coalesce(F.sum("_value").over(within), F.lit(0))).join(carry, same)
    return out.withColumn(name, F.col(name) + F.col("_carry")).select(*df.columns, name)
