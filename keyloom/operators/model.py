"""Declarative record models with keys, indexes, constraints and hooks over batches of records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .changes import auto_increment, fold, orphans
from .collection import Collection
from .shared import cut


class ConstraintError(Exception):
    """Records of a write break a constraint; violators holds them."""

    def __init__(self, name: str, violators: DataFrame):
        super().__init__(name)
        self.violators = violators


class Field:
    """A typed column with a default."""

    kind: T.DataType | None = None

    def __init__(self, kind: T.DataType | None = None, default=None):
        self.kind, self.default = kind or type(self).kind or T.StringType(), default

    def read(self, name: str, there: bool) -> F.Column:
        if not there:
            return F.lit(self.default).cast(self.kind).alias(name)
        c = F.col(name).cast(self.kind)
        return (c if self.default is None else F.coalesce(c, F.lit(self.default).cast(self.kind))).alias(name)


class String(Field):
    kind = T.StringType()


class Integer(Field):
    kind = T.LongType()


class Double(Field):
    kind = T.DoubleType()


class Boolean(Field):
    kind = T.BooleanType()


class Time(Field):
    kind = T.TimestampType()


class List(Field):
    """An array column that reads as empty where it is missing."""

    def __init__(self, element: T.DataType | None = None):
        super().__init__(T.ArrayType(element or T.StringType()))

    def read(self, name: str, there: bool) -> F.Column:
        empty = F.array().cast(self.kind)
        return (F.coalesce(F.col(name).cast(self.kind), empty) if there else empty).alias(name)


def _mark(role: str) -> Callable:
    def mark(f):
        f._roles = (*getattr(f, "_roles", ()), role)
        return f

    return mark


#: Functions of a model without self: key and index give columns by name, constraint a boolean
#: column, reference the columns of a foreign key and the frame that has to hold them; before_* take
#: and give a frame of records, after_* take one (after_replace: with the old ones as the struct old).
key, index, constraint, reference = _mark("key"), _mark("index"), _mark("constraint"), _mark("reference")
before_create, before_update, before_delete = _mark("before_create"), _mark("before_update"), _mark("before_delete")
after_create, after_update, after_replace, after_delete = _mark("after_create"), _mark("after_update"), _mark("after_replace"), _mark("after_delete")


class _IndexAttribute:
    """An index function, which on a bound model is the index itself."""

    def __init__(self, f: Callable):
        self.f, self._roles = f, f._roles

    def __get__(self, _, owner):
        return owner.bound().indices[self.f.__name__] if owner.store is not None else self.f


class Model:
    """Subclasses declare Fields and functions marked as key, index, constraint, reference or hook; both are inherited.

    save and delete give a collection's new rows and leave it at that. Of a model that is bound to
    a store, put and remove write them in a transaction, and after_* hooks hear of what was written.
    """

    fields: dict[str, Field] = {}
    hooks: dict[str, list[Callable]] = {}
    store = None
    name: str | None = None

    def __init_subclass__(cls, **kw):
        super().__init_subclass__(**kw)
        inherited = {n for c in cls.__mro__[1:] for n, v in vars(c).items() if isinstance(v, _IndexAttribute)}
        if again := inherited.intersection(n for n, v in vars(cls).items() if "index" in getattr(v, "_roles", ())):
            raise TypeError(f"{cls.__name__} declares an inherited index anew: {min(again)}")
        for n, v in list(vars(cls).items()):
            if "index" in getattr(v, "_roles", ()) and not isinstance(v, _IndexAttribute):
                setattr(cls, n, _IndexAttribute(v))
        cls.fields = {n: v for c in reversed(cls.__mro__) for n, v in vars(c).items() if isinstance(v, Field)}
        named = {n: v for c in reversed(cls.__mro__) for n, v in vars(c).items() if hasattr(v, "_roles") or hasattr(getattr(v, "__func__", None), "_roles")}
        functions = {n: v.f if isinstance(v, _IndexAttribute) else getattr(v, "__func__", v) for n, v in named.items()}
        cls.hooks = {}
        for f in functions.values():
            for role in f._roles:
                cls.hooks.setdefault(role, []).insert(0, f)  # newest first
        if len(cls.hooks.get("key", ())) > 1:
            raise TypeError(f"{cls.__name__} has more than one key")

    @classmethod
    def shape(cls, df: DataFrame) -> DataFrame:
        """The fields' columns with types and defaults, and whatever else df has."""
        more = [c for c in df.columns if c not in cls.fields]
        return df.select(*[f.read(n, n in df.columns) for n, f in cls.fields.items()], *more)

    @classmethod
    def key_columns(cls, df: DataFrame) -> dict[str, F.Column]:
        found = cls.hooks.get("key")
        return found[0]() if found else {}

    @classmethod
    def violations(cls, df: DataFrame) -> DataFrame:
        """Rows that break a constraint, with its name; null breaks it too."""
        rows = cls.shape(df)
        broken = F.array_compact(F.array(*[F.when(~F.coalesce(f(), F.lit(False)), f.__name__) for f in cls.hooks.get("constraint", ())]))
        return rows.withColumn("constraint", F.explode(broken)) if cls.hooks.get("constraint") else rows.limit(0).withColumn("constraint", F.lit(""))

    @classmethod
    def collection(cls, df: DataFrame) -> Collection:
        """Records as a collection, with the model's indexes."""
        columns = cls.key_columns(df)
        rows = cls.shape(df).withColumns(columns) if columns else cls.shape(df)
        out = Collection(rows, list(columns) or ["id"], cls.__name__)
        for f in reversed(cls.hooks.get("index", [])):
            out.add_index(f.__name__, f())
        return out

    @classmethod
    def broken_references(cls, df: DataFrame) -> DataFrame:
        """Rows whose foreign keys refer to nothing, with the reference's name."""
        rows = cls.shape(df)
        out = rows.limit(0).withColumn("constraint", F.lit(""))
        for f in cls.hooks.get("reference", ()):
            columns, parents = f()
            out = out.unionByName(orphans(rows, parents, columns).withColumn("constraint", F.lit(f.__name__)))
        return out

    @classmethod
    def save(cls, current: DataFrame | None, records: DataFrame, order: list[str] | None = None) -> DataFrame:
        """The collection's rows after saving records, one for each key. Hooks and constraints apply to every write.

        Of several records with one key the last in the given order is saved; without an order they break
        the constraint `key`. Without a key function new records get the next numbers as id, in that order.
        """
        records = cls.shape(records)
        columns = cls.key_columns(records)
        if columns:
            records = records.withColumns(columns)
        elif "id" not in records.columns:
            start = 1 if current is None else (current.agg(F.max("id")).first()[0] or 0) + 1
            records = auto_increment(records, order or list(cls.fields), start, "id")
        names = list(columns) or ["id"]
        if order:
            records = fold(records, names, order).select(*records.columns)
        else:
            repeated = records.groupBy(*names).count().where("count > 1")
            if repeated.take(1):
                raise ConstraintError("key", records.join(repeated.select(*names), names, "left_semi"))
        old = None if current is None else current.select(*names)
        there = records.limit(0) if old is None else records.join(old, names, "left_semi")
        new = records if old is None else records.join(old, names, "left_anti")
        for f in cls.hooks.get("before_create", ()):
            new = f(new)
        written = new.unionByName(there, allowMissingColumns=True)
        for f in cls.hooks.get("before_update", ()):
            written = f(written)
        for broken in (cls.violations(written), cls.broken_references(written)):
            first = broken.select("constraint").limit(1).collect()
            if first:
                raise ConstraintError(first[0][0], broken)
        return written if current is None else current.join(written, names, "left_anti").unionByName(written, allowMissingColumns=True)

    @classmethod
    def delete(cls, current: DataFrame, keys: DataFrame) -> DataFrame:
        """The rows without those of the given keys."""
        gone = current.join(keys, keys.columns, "left_semi")
        for f in cls.hooks.get("before_delete", ()):
            gone = f(gone)
        return current.join(gone.select(*keys.columns), keys.columns, "left_anti")

    @classmethod
    def bind(cls, store, name: str | None = None) -> type[Model]:
        """Binds the model to a collection of a store; its after_* hooks hear of the collection's changes. None unbinds it."""
        cls.store, cls.name = store, name or cls.__name__
        if store is not None:
            for role in ("after_create", "after_update", "after_replace", "after_delete"):
                for f in reversed(cls.hooks.get(role, [])):
                    store.listen(role, f, cls.name)
        return cls

    @classmethod
    def rows(cls) -> DataFrame | None:
        """The bound collection's rows; None before the first write."""
        if cls.store is None:
            raise TypeError(f"{cls.__name__} is not bound to a store")
        return cls.store[cls.name].df if cls.name in cls.store.manifest()["collections"] else None

    @classmethod
    def bound(cls) -> Collection:
        rows = cls.rows()
        return cls.collection(cls.empty(cls.store.spark).withColumn("id", F.lit(0).cast("long")) if rows is None else rows)

    @classmethod
    def put(cls, records: DataFrame, order: list[str] | None = None) -> None:
        """Saves records in the bound collection."""
        current = cls.rows()
        new = cut(cls.save(current, records, order))
        cls.store.put(cls.name, new, list(cls.key_columns(new)) or ["id"])

    @classmethod
    def remove(cls, keys: DataFrame) -> None:
        """Deletes the records of the given keys from the bound collection."""
        current = cls.rows()
        if current is not None:
            new = cut(cls.delete(current, keys))
            cls.store.put(cls.name, new, list(cls.key_columns(new)) or ["id"])

    @classmethod
    def empty(cls, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([], T.StructType([T.StructField(n, f.kind) for n, f in cls.fields.items()]))


def subtree(df: DataFrame, path: str, prefix: list[int]) -> DataFrame:
    """Rows whose array key begins with prefix, in key order: arrays compare element by element, shorter ones first."""
    return df.where(F.slice(path, 1, len(prefix)) == F.lit(prefix).cast(df.schema[path].dataType)).orderBy(path)
