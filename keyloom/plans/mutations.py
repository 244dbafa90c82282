"""Registered queries of stores, transactions, models, hooks, batches that change, and streams, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import batches, changes, model
from ..operators.collection import Collection
from ..operators.shared import cut, scratch
from ..sources.codecs import JsonCodec
from ..sources.errors import AbortError
from ..sources.store import Store
from ..streaming.upserts import upsert_stream
from .catalog import _table, query


def _store(spark) -> Store:
    return Store(spark, scratch(spark, "store"))


def _orders(spark, d) -> DataFrame:
    return _table(spark, d, "orders").select("o_orderkey", "o_totalprice")


def _doubled(rows: DataFrame) -> DataFrame:
    """Tens doubled, fives gone: the changes of several queries."""
    return rows.where("o_orderkey % 10 <> 5").withColumn("o_totalprice", F.when(F.col("o_orderkey") % 10 == 0, F.col("o_totalprice") * 2).otherwise(F.col("o_totalprice")))


DOUBLED = "select o_orderkey, case when o_orderkey % 10 = 0 then o_totalprice * 2 else o_totalprice end o_totalprice from orders where o_orderkey % 10 <> 5"


@query(f"with new as ({DOUBLED}) select 'orders' coll, count(*) n, cast(sum(cast(round(o_totalprice * 100) as bigint)) as bigint) cents from new union all select 'gone', count(*), cast(sum(cast(round(o_totalprice * 100) as bigint)) as bigint) from orders where o_orderkey % 10 = 5")
def txn_commit(spark, d):
    store, rows = _store(spark), _orders(spark, d)
    store.put("orders", rows, ["o_orderkey"])
    with store.begin(write=True):  # both collections change at once
        old = store["orders"].df
        store.put("gone", old.where("o_orderkey % 10 = 5"), ["o_orderkey"])
        store.put("orders", _doubled(old), ["o_orderkey"])
    total = lambda name: store[name].df.agg(F.count("*").alias("n"), F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents")).select(F.lit(name).alias("coll"), "n", "cents")
    return total("orders").union(total("gone"))


@query("select o_orderkey, o_totalprice from orders")
def txn_abort(spark, d):
    store = _store(spark)
    store.put("orders", _orders(spark, d), ["o_orderkey"])
    with store.begin(write=True):
        store.put("orders", store["orders"].df.where("o_orderkey < 5"), ["o_orderkey"])
        raise AbortError
    return store["orders"].items()


@query(f"select o_orderkey, o_totalprice, 'before' seen from orders union all select o_orderkey, o_totalprice, 'after' from ({DOUBLED})")
def txn_snapshot(spark, d):
    store = _store(spark)
    store.put("orders", _orders(spark, d), ["o_orderkey"])
    before = store["orders"].df  # keeps the version that it began with
    store.put("orders", _doubled(before), ["o_orderkey"])
    return before.withColumn("seen", F.lit("before")).union(store["orders"].df.withColumn("seen", F.lit("after")))


@query("select * from (values ('on_commit', cast(2 as bigint)), ('after_commit', cast(2 as bigint)), ('after_abort', cast(1 as bigint))) t(event, n)")
def txn_events(spark, d):
    store, heard = _store(spark), []
    for event in ("on_commit", "after_commit", "after_abort"):
        store.listen(event, lambda event=event: heard.append(event))
    region = _table(spark, d, "region")
    store.put("region", region, ["r_regionkey"])
    with store.begin(write=True):
        store.put("region", region.where("r_regionkey > 0"), ["r_regionkey"])
    with store.begin(write=True):
        raise AbortError
    return spark.createDataFrame([(x,) for x in heard], "event string").groupBy("event").agg(F.count("*").alias("n"))


@query("select c_custkey as k, 'customer' coll from customer union all select s_suppkey, 'supplier' from supplier")
def store_collections(spark, d):
    store = _store(spark)
    with store.begin(write=True):
        store.put("a", _table(spark, d, "customer").select(F.col("c_custkey").alias("k")), ["k"])
        store.put("b", _table(spark, d, "supplier").select(F.col("s_suppkey").alias("k")), ["k"])
    again = Store(spark, store.path)  # found by what is stored
    again.rename("b", "c")
    return again["a"].keys().withColumn("coll", F.lit("customer")).union(again["c"].keys().withColumn("coll", F.lit("supplier")))


@query("select * from (values (cast(10 as bigint), cast(10 as bigint), cast(11 as bigint), cast(13 as bigint), 'x')) t(first, second, third, peek, meta)")
def store_counters(spark, d):
    store = _store(spark)
    store.set_meta("index", "by_name", "of", "x")
    reads = [store.count("c", 0, 10), store.count("c", 1, 10), store.count("c", 2), store.count("c", 0)]
    return spark.createDataFrame([(*reads, Store(spark, store.path).get_meta("index", "by_name", "of"))], "first long, second long, third long, peek long, meta string")


@query("select count(*) n, cast(sum(strlen(text)) as bigint) as bytes from documents")
def collection_size(spark, d):
    return Collection(_table(spark, d, "documents").select("doc_id", "text"), "doc_id").size("text")


def _customer(hooks: dict | None = None) -> type[model.Model]:
    """A model of customers; hooks: more members, by name."""

    class Customer(model.Model):
        c_custkey = model.Integer()
        c_name = model.String()
        c_mktsegment = model.String(default="none")
        c_acctbal = model.Double(default=0.0)

        @model.key
        def by_key():
            return {"c_custkey": F.col("c_custkey")}

        @model.index
        def by_segment():
            return {"segment": F.col("c_mktsegment")}

        @model.constraint
        def named():
            return F.length("c_name") > 0

    return type("Customer", (Customer,), hooks or {})


def _customers(spark, d) -> DataFrame:
    return _table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_acctbal")


@query("select c_custkey, c_name, case when c_custkey % 4 = 0 then 'NEW' else c_mktsegment end c_mktsegment, c_acctbal, case when c_custkey % 4 = 0 then 'updated' else 'created' end stamp from customer")
def model_save(spark, d):
    stamp = lambda state: lambda rows: rows.withColumn("stamp", F.lit(state))
    hooks = {"created": model.before_create(stamp("created")), "updated": model.before_update(lambda rows: rows.withColumn("stamp", F.coalesce(F.col("stamp"), F.lit("updated"))))}
    kind = _customer(hooks)
    rows = _customers(spark, d)
    saved = cut(kind.save(None, rows))
    changed = saved.where("c_custkey % 4 = 0").drop("stamp").withColumns({"c_mktsegment": F.lit("NEW"), "stamp": F.lit(None).cast("string")})
    return kind.save(saved, changed).select("c_custkey", "c_name", "c_mktsegment", "c_acctbal", "stamp")


@query("select c_custkey, max_by(c_name, n) c_name from (select c_custkey, c_name, 0 n from customer union all select c_custkey, c_name || '-' || n, n from customer, (values (1), (2)) t(n) where c_custkey % 3 = 0) group by 1")
def model_save_last(spark, d):
    kind, rows = _customer(), _customers(spark, d)
    copies = reduce(DataFrame.union, [rows.where("c_custkey % 3 = 0").withColumn("c_name", F.concat("c_name", F.lit(f"-{n}"))).withColumn("n", F.lit(n)) for n in (1, 2)])
    return kind.save(rows, copies, ["n"]).select("c_custkey", "c_name")


@query("select c_custkey, c_name from customer where c_custkey % 5 <> 0 or c_acctbal < 0")
def model_delete(spark, d):
    kind = _customer({"spare": model.before_delete(lambda rows: rows.where("c_acctbal >= 0"))})
    rows = _customers(spark, d)
    return kind.delete(rows, rows.where("c_custkey % 5 = 0").select("c_custkey")).select("c_custkey", "c_name")


@query("select n_name as name, 'none' note, 0 tags, row_number() over (order by n_name) id from nation")
def model_defaults(spark, d):
    class Nation(model.Model):
        name = model.String()
        note = model.String(default="none")
        tags = model.List()

    saved = Nation.save(None, _table(spark, d, "nation").select(F.col("n_name").alias("name")))
    return saved.select("name", "note", F.size("tags").alias("tags"), "id")


@query("select c_custkey, c_name from customer where c_mktsegment = 'BUILDING'")
def model_index(spark, d):
    kind = _customer().bind(_store(spark))
    kind.put(_customers(spark, d))
    return kind.by_segment.items(key="BUILDING").select("c_custkey", "c_name")


@query("select c_custkey, c_mktsegment from customer where c_custkey >= 100 and c_custkey < 300")
def model_range(spark, d):
    kind = _customer().bind(_store(spark))
    kind.put(_customers(spark, d))
    return kind.bound().items(lo=100, hi=300).select("c_custkey", "c_mktsegment")


def _heard(spark, d, role) -> DataFrame:
    """What one after_* hook hears when customers are saved, a quarter of them changed, some added, and a tenth removed."""
    heard: list[DataFrame] = []
    kind = _customer({"hear": role(lambda rows: heard.append(rows))}).bind(_store(spark))
    rows = _customers(spark, d)
    kind.put(rows.where("c_custkey % 7 <> 0"))
    changed = kind.rows().where("c_custkey % 4 = 0").withColumn("c_mktsegment", F.lit("NEW"))
    kind.put(changed.unionByName(rows.where("c_custkey % 7 = 0")))
    kind.remove(rows.where("c_custkey % 10 = 0").select("c_custkey"))
    return reduce(DataFrame.unionByName, heard)


@query("select c_custkey, c_mktsegment from customer")
def hook_after_create(spark, d):
    return _heard(spark, d, model.after_create).select("c_custkey", "c_mktsegment")


@query("select c_custkey, c_mktsegment from customer union all select c_custkey, 'NEW' from customer where c_custkey % 4 = 0 and c_custkey % 7 <> 0")
def hook_after_update(spark, d):
    return _heard(spark, d, model.after_update).select("c_custkey", "c_mktsegment")


@query("select c_custkey, c_mktsegment as old, 'NEW' as new from customer where c_custkey % 4 = 0 and c_custkey % 7 <> 0")
def hook_after_replace(spark, d):
    return _heard(spark, d, model.after_replace).select("c_custkey", F.col("old.c_mktsegment").alias("old"), F.col("c_mktsegment").alias("new"))


@query("select c_custkey from customer where c_custkey % 10 = 0")
def hook_after_delete(spark, d):
    return _heard(spark, d, model.after_delete).select("c_custkey")


@query("select o_orderkey, o_custkey from orders where o_custkey not in (select c_custkey from customer where c_acctbal < 0)")
def hook_cascade(spark, d):
    """Deleting customers deletes their orders, in the same transaction."""
    store = _store(spark)
    store.put("orders", _table(spark, d, "orders").select("o_orderkey", "o_custkey"), ["o_orderkey"])
    gone = lambda rows: store.put("orders", changes.cascade(store["orders"].df, rows.select(F.col("c_custkey").alias("o_custkey")), ["o_custkey"]), ["o_orderkey"])
    kind = _customer({"cascade": model.after_delete(gone)}).bind(store)
    rows = _customers(spark, d)
    kind.put(rows)
    kind.remove(rows.where("c_acctbal < 0").select("c_custkey"))
    return store["orders"].df


@query("select o_orderkey, 'customer' as constraint_name from orders where o_custkey not in (select c_custkey from customer where c_acctbal >= 0)")
def reference_violations(spark, d):
    parents = _customers(spark, d).where("c_acctbal >= 0").select(F.col("c_custkey").alias("o_custkey"))

    class Order(model.Model):
        o_orderkey = model.Integer()
        o_custkey = model.Integer()

        @model.reference
        def customer():
            return ["o_custkey"], parents

    return Order.broken_references(_table(spark, d, "orders")).select("o_orderkey", F.col("constraint").alias("constraint_name"))


@query("""with recursive p as (select o_orderkey node, cast(0 as bigint) depth, cast(o_orderkey as varchar) path from orders where o_orderkey = 0
    union all select o.o_orderkey, p.depth + 1, p.path || '/' || o.o_orderkey from orders o join p on o.o_orderkey // 3 = p.node where o.o_orderkey > 0) select * from p""")
def parent_chain(spark, d):
    rows = _table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") > 0, F.floor(F.col("o_orderkey") / 3)).alias("parent"))
    found = changes.ancestors(rows, "o_orderkey", "parent")
    return found.select("node", (F.size("path") - 1).cast("long").alias("depth"), F.array_join(F.col("path").cast("array<string>"), "/").alias("path"))


@query("select o_orderkey from orders where o_orderkey // 1000 = 1 and o_orderkey // 100 % 10 = 3")
def subtree_scan(spark, d):
    path = F.array(*[F.floor(F.col("o_orderkey") / n) % 10 for n in (1000, 100, 10)])
    rows = _table(spark, d, "orders").where("o_orderkey < 10000").select("o_orderkey", path.cast("array<bigint>").alias("path"))
    return model.subtree(rows, "path", [1, 3]).select("o_orderkey")


@query("select reverse(c_name) k, c_custkey from customer")
def rekey_copy(spark, d):
    store = _store(spark)
    store.put("by_name", changes.rekey(_table(spark, d, "customer").select("c_name", "c_custkey"), {"k": F.reverse("c_name")}).drop("c_name"), ["k"])
    return store["by_name"].items()


@query("""with s as (select *, case when event_type <> 'error' then event_type end as new from events), l as (select *, lag(new) over (partition by user_id order by ts, event_id) old from s)
    select user_id, event_id, old as gone, new as added from l where old is distinct from new""")
def index_entry_deletes(spark, d):
    log = _table(spark, d, "events").select("user_id", "event_id", "ts", F.array_compact(F.array(F.when(F.col("event_type") != "error", F.col("event_type")))).alias("entries"))
    rows = changes.index_changes(log, ["user_id"], ["ts", "event_id"], "entries")
    return rows.select("user_id", "event_id", F.get("deleted", F.lit(0)).alias("gone"), F.get("added", F.lit(0)).alias("added"))


@query("select c_custkey, c_name, c_acctbal from customer where c_custkey < 1000")
def codec_json(spark, d):
    codec = JsonCodec("c_name string, c_acctbal double")
    packed = codec.encode(_table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal"), ["c_custkey"])
    return Collection(packed, "c_custkey", codec=codec).items(hi=1000)


@query("select user_id, min(f) first_seen, max(f) last_seen, count(*) n from (select user_id, event_type, min(event_id) f from events group by 1, 2) group by 1")
def import_rolled_up(spark, d):
    """Raw events come twice and in two loads; what is stored holds the first of each kind of each user."""
    raw = _table(spark, d, "events").select("user_id", "event_type", "event_id")
    key = ["user_id", "event_type"]
    held, _ = changes.import_log(None, raw.where("event_id % 2 = 0").union(raw.where("event_id % 4 = 0")), key, "event_id", "user_id")
    whole, _ = changes.import_log(None, held.unionByName(raw.where("event_id % 2 = 1")), key, "event_id", "user_id")
    return changes.import_log(whole, raw, key, "event_id", "user_id")[1]


def _packed(rows: DataFrame, n: int = 10) -> DataFrame:
    return batches.pack_batches(batches.batch_numbers(rows, ["o_orderkey"], n), ["o_orderkey"])


@query(f"select o_orderkey, o_totalprice from ({DOUBLED}) union all select -1, 0.5")
def batch_write(spark, d):
    rows = _orders(spark, d)
    put = rows.where("o_orderkey % 10 = 0").withColumn("o_totalprice", F.col("o_totalprice") * 2).withColumn("gone", F.lit(False))
    gone = rows.where("o_orderkey % 10 = 5").withColumn("gone", F.lit(True))
    new = spark.createDataFrame([(-1, 0.5, None)], "o_orderkey long, o_totalprice double, gone boolean")
    return batches.expand(batches.replace_in(_packed(rows), ["o_orderkey"], put.union(gone).union(new), F.col("gone")))


@query("select o_orderkey, o_totalprice from orders order by o_orderkey limit 10 offset 30")
def batch_members(spark, d):
    return batches.members(_packed(_orders(spark, d)), 3)


@query("(select o_orderkey, 'first' as part from orders order by o_orderkey limit 20) union all (select o_orderkey, 'last' from orders where o_orderkey // 10 >= (select max(o_orderkey) // 10 - 1 from orders))")
def batch_max_phys(spark, d):
    packed = cut(_packed(_orders(spark, d).select("o_orderkey")))
    first, last = batches.scan_batches(packed, 2), batches.scan_batches(packed, 2, reverse=True)
    return first.withColumn("part", F.lit("first")).union(last.withColumn("part", F.lit("last")))


@query("""with r as (select o_orderkey k, case when o_orderkey < 500 then 0 when o_orderkey < 800 then 1 else 2 end part from orders),
    n as (select k, part, (row_number() over (partition by part order by k) - 1) // case when part = 1 then 10 else 7 end b from r)
    select min(k) lo, max(k) hi, count(*) n from n group by part, b""")
def batch_preserve(spark, d):
    rows = _orders(spark, d).select("o_orderkey")
    held = cut(_packed(rows.where("o_orderkey >= 500 AND o_orderkey < 800")))
    out = batches.rebatch(held, rows.where("o_orderkey < 500 OR o_orderkey >= 800"), ["o_orderkey"], 7)
    return out.select("lo.o_orderkey", F.col("hi.o_orderkey").alias("hi"), "n").withColumnRenamed("o_orderkey", "lo")


@query("select cast((rn - 1) // 10 as bigint) batch, min(o_orderkey) lo, max(o_orderkey) hi, count(*) n from (select o_orderkey, row_number() over (order by o_orderkey) rn from orders) group by 1")
def batch_incremental(spark, d):
    rows = batches.incremental_batches(_orders(spark, d).select("o_orderkey"), "o_orderkey", 10, 50_000)
    return rows.groupBy("batch").agg(F.min("o_orderkey").alias("lo"), F.max("o_orderkey").alias("hi"), F.count("*").alias("n"))


@query("select user_id, arg_max(event_type, (ts, event_id)) event_type from events group by 1 having arg_max(event_type, (ts, event_id)) <> 'error'")
def stream_upserts(spark, d):
    """The events as a stream of a few files, some of them late."""
    at, store = scratch(spark, "log"), _store(spark)
    rows = _table(spark, d, "events").select("user_id", "ts", "event_id", "event_type", (F.col("event_type") == "error").alias("gone"))
    rows.repartition(3, F.col("event_id") % 3).write.parquet(at)
    log = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(at)
    upsert_stream(log, store, "users", ["user_id"], ["ts", "event_id"], scratch(spark, "stream"), "gone").awaitTermination()
    return store["users"].df.where("NOT deleted").select("user_id", "event_type")
