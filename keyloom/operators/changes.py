"""Mutations as change logs: the folded state, keys by number, counters and index changes.

A log has a key, a sequence that orders changes of a key (columns, all together unique per key),
and, for deletes, a condition that marks the row as one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .collection import ascending, positions, previous_rows, sums_before
from .shared import cut


def fold(log: DataFrame, key: list[str], sequence: list[str], deleted: F.Column | None = None) -> DataFrame:
    """The current records: each key's last change, without keys that it deletes.

    max_by combines before the shuffle, so that a key with many changes sends one row per task.
    """
    values = [c for c in log.columns if c not in key]
    rows = log.withColumn("_deleted", F.lit(False) if deleted is None else F.coalesce(deleted, F.lit(False)))
    last = rows.groupBy(*key).agg(F.max_by(F.struct(*values, "_deleted"), F.struct(*sequence)).alias("_last"))
    return last.where(~F.col("_last._deleted")).select(*key, *[F.col(f"_last.{c}").alias(c) for c in values])


def upsert(current: DataFrame, changes: DataFrame, key: list[str], sequence: list[str], deleted: str | None = None) -> DataFrame:
    """Current records after a batch of changes; deleted names a boolean column of changes."""
    values = [c for c in current.columns if c not in key]
    old = current.select(*key, F.lit(0).alias("_new"), F.struct(*[F.lit(None).cast(changes.schema[c].dataType).alias(c) for c in sequence]).alias("_at"), F.lit(False).alias("_deleted"), F.struct(*values).alias("_row"))
    new = changes.select(*key, F.lit(1).alias("_new"), F.struct(*sequence).alias("_at"), (F.coalesce(F.col(deleted), F.lit(False)) if deleted else F.lit(False)).alias("_deleted"), F.struct(*values).alias("_row"))
    last = old.unionByName(new).groupBy(*key).agg(F.max_by(F.struct("_row", "_deleted"), F.struct("_new", "_at")).alias("_last"))
    return last.where(~F.col("_last._deleted")).select(*key, "_last._row.*")


def auto_increment(rows: DataFrame, order: list[str], start: int = 1, name: str = "k") -> DataFrame:
    """Dense keys in a declared order of insertion, from start."""
    return positions(rows, ascending(order), name).withColumn(name, F.col(name) + F.lit(start - 1).cast("long"))


def counters(increments: DataFrame, name: str, init: int = 1, by: str | None = None) -> DataFrame:
    """Each counter's value after all increments: name, value."""
    step = F.count("*") if by is None else F.sum(by)
    return increments.groupBy(F.col(name).alias("name")).agg((step + F.lit(init)).cast("long").alias("value"))


def counter_reads(increments: DataFrame, name: str, order: list[str], init: int = 1, by: str | None = None) -> DataFrame:
    """What each increment reads: the counter's value before it. An increment of 0 only looks."""
    out = sums_before(increments, [name], order, F.lit(1) if by is None else F.col(by), "read")
    return out.withColumn("read", (F.col("read") + F.lit(init)).cast("long"))


def _same_key(key: list[str]) -> F.Column:
    return F.struct(*[F.col(c) for c in key]).eqNullSafe(F.struct(*[F.col(f"_before.{c}").alias(c) for c in key]))


def with_previous(log: DataFrame, key: list[str], sequence: list[str], value: str, name: str = "old") -> DataFrame:
    """Each change with the value that the change before it left; a key's changes may span any number of tasks."""
    rows = previous_rows(log, ascending([*key, *sequence]), [*key, value], "_before")
    return rows.withColumn(name, F.when(_same_key(key), F.col(f"_before.{value}"))).drop("_before")


def classified(log: DataFrame, key: list[str], sequence: list[str], name: str = "ev") -> DataFrame:
    """Changes as create (the key's first) or replace."""
    rows = previous_rows(log, ascending([*key, *sequence]), key, "_before")
    return rows.withColumn(name, F.when(F.col("_before").isNotNull() & _same_key(key), "replace").otherwise("create")).drop("_before")


def index_changes(log: DataFrame, key: list[str], sequence: list[str], entries: str) -> DataFrame:
    """Entries (an array of tuples per record) to delete and to add at each replace that changes any."""
    rows = with_previous(log, key, sequence, entries, "_old")
    empty = F.array().cast(log.schema[entries].dataType)
    old, new = F.coalesce("_old", empty), F.coalesce(entries, empty)
    rows = rows.withColumns({"deleted": F.array_except(old, new), "added": F.array_except(new, old)}).drop("_old")
    return rows.where((F.size("deleted") > 0) | (F.size("added") > 0))


def rekey(rows: DataFrame, key: dict[str, F.Column]) -> DataFrame:
    """Copies records under a new key function."""
    return rows.withColumns(key)


def keep_first(rows: DataFrame, same: list[str], order: str) -> DataFrame:
    """The first row in order of each group of equal ones."""
    rest = [c for c in rows.columns if c not in (*same, order)]
    out = rows.groupBy(*same).agg(F.min(F.struct(order, *rest)).alias("_first"))
    return out.select(*same, "_first.*").select(*rows.columns)


def roll_up(rows: DataFrame, key: list[str], time: str) -> DataFrame:
    """Of each key its first and last time, and how many rows it has."""
    return rows.groupBy(*key).agg(F.min(time).alias("first_seen"), F.max(time).alias("last_seen"), F.count("*").alias("n"))


def ancestors(rows: DataFrame, node: str, parent: str) -> DataFrame:
    """node and path, the ids from the root down. Rows on no path to a root go: those under a missing parent, and those in or under a ring.

    Each round joins every open path with its head's own, so that a depth of d takes the logarithm of d rounds.
    """
    state = rows.select(F.col(node).alias("node"), F.array(F.col(node).cast(rows.schema[parent].dataType)).alias("path"), F.col(parent).alias("head"))
    state = cut(state)
    while state.where("head IS NOT NULL").take(1):
        above = state.select(F.col("node").alias("_at"), F.col("path").alias("_above"), F.col("head").alias("_head"))
        longer = state.where("head IS NOT NULL").join(above, F.col("head") == F.col("_at"))
        ring = F.arrays_overlap("path", "_above") | F.coalesce(F.array_contains("_above", F.col("_head")), F.lit(False)) | F.coalesce(F.array_contains("path", F.col("_head")), F.lit(False))
        longer = longer.where(~ring).select("node", F.concat("_above", "path").alias("path"), F.col("_head").alias("head"))
        state = cut(state.where("head IS NULL").union(longer))
    return state.select("node", "path")


def orphans(children: DataFrame, parents: DataFrame, on: list[str]) -> DataFrame:
    """Children whose reference is set in all columns, but to no parent: what breaks a foreign key."""
    return children.dropna(subset=on).join(parents.select(*on), on, "left_anti")


def import_log(current: DataFrame | None, raw: DataFrame, key: list[str], time: str, owner: str) -> tuple[DataFrame, DataFrame]:
    """An import of raw records that may repeat: the collection with the first record of each key added, and its owners with first and last time and count."""
    new = keep_first(raw, key, time)
    if current is not None:
        new = new.join(current.select(*key), key, "left_anti")
    whole = new if current is None else current.unionByName(new)
    return whole, roll_up(whole, [owner], time)


def cascade(children: DataFrame, gone: DataFrame, on: list[str]) -> DataFrame:
    """Children without those whose parent is gone."""
    return children.join(gone, on, "left_anti")
