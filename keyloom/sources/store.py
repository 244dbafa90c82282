"""Stores: named collections as versioned Parquet tables under one folder, with transactions.

A write of a collection adds files; a manifest names each collection's current ones. A transaction
writes files first and publishes all of them at once with one new manifest, so readers see all
of its changes or none, and keep reading the version that they began with.

Listeners hear of a collection's changes once its files are written and before they are published,
so that they may write to other collections within the same transaction; what they are given is
read from files and stays as it is. Transactions have listeners of their own. A listener that
returns False is not called again; one that raises ends the transaction.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from contextlib import contextmanager
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.changes import fold
from ..operators.collection import Collection
from .codecs import Registry
from .errors import AbortError, ConfigError, NameInUse, NotFound, TxnError

#: Events of transactions (their listeners take none), and of collections (a frame of records; after_replace: with the old ones as the struct old).
TRANSACTION_EVENTS = ("on_commit", "after_commit", "after_abort")
COLLECTION_EVENTS = ("after_create", "after_update", "after_replace", "after_delete")


def parse_url(url: str) -> dict:
    """scheme:path;key=value,flag to a dictionary; options part at ; or ,."""
    head, _, options = url.partition(";")
    split = urlsplit(head)
    out = {"scheme": split.scheme, "path": (split.netloc and f"//{split.netloc}") + split.path}
    for option in filter(None, options.replace(";", ",").split(",")):
        name, given, value = option.partition("=")
        out[name.strip()] = value.strip() if given else True
    return out


class Store:
    def __init__(self, spark: SparkSession, path: str, readonly: bool = False):
        self.spark, self.path, self.readonly = spark, path.rstrip("/"), readonly
        self.staged: dict | None = None
        self.writing = False
        self.listeners: dict[tuple[str, str | None], list[Callable]] = {}
        self.codecs = Registry(self.manifest().get("codecs"))

    # manifests are small files read and written through Hadoop's file systems, so any store that Spark reads will do

    def _fs(self):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _files(self, folder: str) -> list[str]:
        fs, path = self._fs()
        return sorted(s.getPath().toString() for s in fs.listStatus(path(folder))) if fs.exists(path(folder)) else []

    def _manifests(self) -> list[str]:
        return self._files(f"{self.path}/_manifests")

    def manifest(self) -> dict:
        if self.staged is not None:
            return self.staged
        found = self._manifests()
        return self._read(found[-1]) if found else {"collections": {}, "counters": {}, "meta": {}}

    def _read(self, name: str) -> dict:
        return json.loads(self.spark.read.text(name, wholetext=True).first()[0])

    def _publish(self, manifest: dict) -> None:
        fs, path = self._fs()
        last = self._manifests()
        n = int(last[-1].rpartition("/")[2].removesuffix(".json")) + 1 if last else 0
        out = fs.create(path(f"{self.path}/_manifests/{n:012d}.json"), False)  # fails if another writer was first
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()

    def listen(self, event: str, f: Callable, name: str | None = None) -> None:
        """Calls f at an event of transactions, or of the collection with the given name. The newest listener comes first."""
        if event not in (TRANSACTION_EVENTS if name is None else COLLECTION_EVENTS):
            raise ConfigError(f"no event {event}")
        self.listeners.setdefault((event, name), []).insert(0, f)

    def _tell(self, event: str, name: str | None, *args) -> None:
        heard = self.listeners.get((event, name), [])
        for f in list(heard):
            if f(*args) is False:
                heard.remove(f)

    @contextmanager
    def begin(self, write: bool = False):
        """A transaction; AbortError leaves it quietly, any other error is raised again, both without changes."""
        if self.staged is not None:
            raise TxnError("a transaction is open")
        if write and self.readonly:
            raise TxnError("the store is read-only")
        self.staged, self.writing, done = self.manifest(), write, False
        try:
            yield self
            if write:
                self._tell("on_commit", None)
                manifest, self.staged = self.staged, None
                self._publish(manifest)
            done = True
        except AbortError:
            pass
        finally:
            self.staged, self.writing = None, False
            if write:
                self._tell("after_commit" if done else "after_abort", None)

    @contextmanager
    def _write(self):
        if self.staged is not None:
            if not self.writing:
                raise TxnError("the transaction only reads")
            yield self.staged
        else:
            with self.begin(write=True):
                yield self.staged

    def _new_files(self, df: DataFrame, key: list[str], name: str, partitions: int | None) -> list[str]:
        folder = f"{self.path}/{name}/{int(time.time() * 1000):013d}-{uuid.uuid4().hex[:8]}"
        Collection(df, key, name).clustered(folder, partitions)
        return [x for x in self._files(folder) if x.endswith(".parquet")]

    def _frame(self, files: list[str], schema: str) -> DataFrame:
        from pyspark.sql.types import StructType

        shape = StructType.fromJson(json.loads(schema))
        return self.spark.read.schema(shape).parquet(*files) if files else self.spark.createDataFrame([], shape)

    def _set(self, manifest: dict, name: str, df: DataFrame, key: list[str], files: list[str]) -> None:
        old = manifest["collections"].get(name)
        manifest["collections"][name] = {"key": list(key), "files": files, "schema": df.schema.json()}
        heard = [e for e in COLLECTION_EVENTS if self.listeners.get((e, name))]
        if not heard:  # versions are compared only if somebody needs it
            return
        new = self._frame(files, df.schema.json())
        before = self._frame(old["files"], old["schema"]) if old else new.limit(0)
        keys = list(key)
        known = before.select(*keys, F.struct(*before.columns).alias("old"))
        created = new.join(known, keys, "left_anti")
        both = new.join(known, keys)
        replaced = both.where(~F.struct(*new.columns).eqNullSafe(F.col("old"))) if before.schema == new.schema else both
        frames = {"after_create": created, "after_replace": replaced, "after_update": created.unionByName(replaced.drop("old")), "after_delete": before.join(new, keys, "left_anti")}
        for event in heard:
            self._tell(event, name, frames[event])

    def put(self, name: str, df: DataFrame, key: list[str], partitions: int | None = None) -> None:
        """Writes a collection's new version, clustered by key."""
        with self._write() as manifest:
            old = manifest["collections"].get(name)
            if old and old["key"] != list(key):
                raise ConfigError(f"{name} has the key {old['key']}")
            self._set(manifest, name, df, key, self._new_files(df, key, name, partitions))

    def merge(self, name: str, changes: DataFrame, key: list[str], sequence: list[str], most_files: int = 10_000) -> None:
        """Folds changes into a collection: each key's last row by sequence stays. Only files that hold a changed key are written anew.

        changes: the collection's columns. Beyond most_files, all files are.
        """
        with self._write() as manifest:
            old = manifest["collections"].get(name)
            if not old or not old["files"]:
                self.put(name, fold(changes, key, sequence), key)
                return
            if old["key"] != list(key):
                raise ConfigError(f"{name} has the key {old['key']}")
            rows = self._frame(old["files"], old["schema"])
            if len(old["files"]) > most_files:
                touched = set(old["files"])
            else:
                found = rows.select(*key, F.col("_metadata.file_path").alias("_file")).join(changes.select(*key).distinct(), key, "left_semi")
                names = {r["_file"] for r in found.select("_file").distinct().collect()}  # as many as there are files at most
                touched = {x for x in old["files"] if x.rpartition("/")[2] in {y.rpartition("/")[2] for y in names}}
            whole = self._frame(sorted(touched), old["schema"]).unionByName(changes.select(*rows.columns))
            new = fold(whole, key, sequence).select(*rows.columns)
            files = [x for x in old["files"] if x not in touched] + self._new_files(new, key, name, max(1, len(touched)))
            self._set(manifest, name, rows, key, files)

    def __getitem__(self, name: str) -> Collection:
        found = self.manifest()["collections"].get(name)
        if not found:
            raise NotFound(name)
        return Collection(self._frame(found["files"], found["schema"]), found["key"], name)

    def rename(self, old: str, new: str) -> None:
        with self._write() as manifest:
            if new in manifest["collections"]:
                raise NameInUse(new)
            if old not in manifest["collections"]:
                raise NotFound(old)
            manifest["collections"][new] = manifest["collections"].pop(old)

    def count(self, name: str, n: int = 1, init: int = 1) -> int:
        """A counter's value before n is added; with n = 0 it only looks."""
        if not n:
            return self.manifest()["counters"].get(name, init)
        with self._write() as manifest:
            value = manifest["counters"].get(name, init)
            manifest["counters"][name] = value + n
        return value

    def set_meta(self, kind: str, name: str, attribute: str, value) -> None:
        """Keeps a JSON value under a kind (collection, index, or any other), a name and an attribute; None forgets it."""
        with self._write() as manifest:
            held = manifest.setdefault("meta", {}).setdefault(kind, {}).setdefault(name, {})
            held[attribute] = value
            if value is None:
                del held[attribute]

    def get_meta(self, kind: str, name: str, attribute: str, default=None):
        return self.manifest().get("meta", {}).get(kind, {}).get(name, {}).get(attribute, default)

    def add_codec(self, name: str, encode, decode) -> int:
        """A codec and its number, which stays with the store."""
        number = self.codecs.add(name, encode, decode)
        if self.manifest().get("codecs", {}).get(name) != number:
            with self._write() as manifest:
                manifest["codecs"] = dict(self.codecs.numbers)
        return number

    def clean(self, keep: int = 2) -> int:
        """Deletes all manifests but the newest ones, and the files that none of these names; gives the number of files. Not to be run beside writers."""
        fs, path = self._fs()
        names = self._manifests()
        held = {x for n in names[-keep:] for c in self._read(n)["collections"].values() for x in c["files"]}
        gone = 0
        for folder in self._files(self.path):
            for version in self._files(folder) if not folder.endswith("/_manifests") else ():
                files = [x for x in self._files(version) if x.endswith(".parquet")]
                for x in files:
                    if x not in held:
                        fs.delete(path(x), False)
                        gone += 1
                if not held.intersection(files):
                    fs.delete(path(version), True)
        for n in names[:-keep]:
            fs.delete(path(n), False)
        return gone

    def info(self) -> DataFrame:
        """kind, name, attribute and value of all that is stored."""
        m = self.manifest()
        rows = [("collection", n, a, json.dumps(v)) for n, c in sorted(m["collections"].items()) for a, v in sorted(c.items())] + [("counter", n, "value", str(v)) for n, v in sorted(m["counters"].items())] + [("codec", n, "number", str(v)) for n, v in self.codecs.numbers.items()]
        rows += [(k, n, a, json.dumps(v)) for k, names in sorted(m.get("meta", {}).items()) for n, held in sorted(names.items()) for a, v in sorted(held.items())]
        return self.spark.createDataFrame(rows, "kind string, name string, attribute string, value string")


_schemes = {}


def register(scheme: str, make) -> None:
    """make(spark, options of the URL) gives a Store."""
    _schemes[scheme] = make


def open_store(spark: SparkSession, url: str) -> Store:
    options = parse_url(url)
    if options["scheme"] not in _schemes:
        raise ConfigError(f"no source for {url}")
    return _schemes[options["scheme"]](spark, options)


for _scheme in ("", "file", "parquet"):
    register(_scheme, lambda spark, o: Store(spark, o["path"], bool(o.get("readonly"))))
