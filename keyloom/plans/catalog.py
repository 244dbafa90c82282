"""Registered queries of the library and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keycodec
from ..operators import batches, changes
from ..operators.collection import Collection, positions
from ..operators.index import Index

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):
    """Registers a query by its function's name, with its SQL where SQL can express it."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def orders(spark, d) -> Collection:
    return Collection(_table(spark, d, "orders"), "o_orderkey", "orders")


def turns(spark, d) -> Collection:
    return Collection(_table(spark, d, "conversations"), ["conv_id", "turn"], "turns")


def customers(spark, d) -> Collection:
    return Collection(_table(spark, d, "customer"), "c_custkey", "customers")


def parts(spark, d) -> Collection:
    return Collection(_table(spark, d, "part"), "p_partkey", "parts")


def _cents(c: str) -> F.Column:
    return F.round(F.col(c) * 100).cast("long")


def _by_segment(spark, d) -> Index:
    return customers(spark, d).add_index("segment", {"c_mktsegment": F.col("c_mktsegment")})


def _by_segment_cents(spark, d) -> Index:
    return customers(spark, d).add_index("segment_cents", {"c_mktsegment": F.col("c_mktsegment"), "cents": _cents("c_acctbal")})


def _log(spark, d) -> DataFrame:
    return _table(spark, d, "events").select("user_id", "event_id", "ts", "event_type", "value")


@query("select o_orderkey, o_custkey, o_totalprice, row_number() over (order by o_orderkey) pos from orders")
def scan_items(spark, d):
    rows = orders(spark, d).df.select("o_orderkey", "o_custkey", "o_totalprice")
    return positions(rows, [F.col("o_orderkey").asc_nulls_first()])


@query("select o_orderkey from orders")
def scan_keys(spark, d):
    return orders(spark, d).keys()


@query("select props from events")
def scan_values_raw(spark, d):
    return Collection(_table(spark, d, "events").select("event_id", "props"), "event_id").values(raw=True)


@query("select o_orderkey from orders where o_orderkey >= 14000")
def range_lo(spark, d):
    return orders(spark, d).keys(lo=14000)


@query("select o_orderkey from orders where o_orderkey >= 1000 and o_orderkey < 2000")
def range_lo_hi(spark, d):
    return orders(spark, d).keys(lo=1000, hi=2000)


@query("select o_orderkey from orders where o_orderkey >= 1000 and o_orderkey <= 2000")
def range_hi_include(spark, d):
    return orders(spark, d).keys(lo=1000, hi=2000, include=True)


@query("select conv_id, turn, role from conversations where (conv_id > 7 or (conv_id = 7 and turn >= 2)) and (conv_id < 9 or (conv_id = 9 and turn < 1))")
def range_compound(spark, d):
    return turns(spark, d).items(lo=(7, 2), hi=(9, 1)).select("conv_id", "turn", "role")


@query("select conv_id, turn from conversations where conv_id < 9")
def range_short_hi_include(spark, d):
    return turns(spark, d).keys(hi=(9,), include=True)


@query("select conv_id, turn, role from conversations where conv_id = 7 and turn = 1")
def exact_get(spark, d):
    return turns(spark, d).get((7, 1)).select("conv_id", "turn", "role")


@query("select conv_id, turn, role from conversations where conv_id = 7")
def prefix_int(spark, d):
    return turns(spark, d).items(prefix=(7,)).select("conv_id", "turn", "role")


@query("select p_partkey, p_name from part where starts_with(p_name, 'blue')")
def prefix_text(spark, d):
    index = parts(spark, d).add_index("name", {"p_name": F.col("p_name")})
    return index.pairs(prefix="blue").select("p_partkey", "p_name")


@query("select o_orderkey, row_number() over (order by o_orderkey desc) pos from orders order by o_orderkey desc limit 5")
def reverse_max(spark, d):
    return _numbered(orders(spark, d).keys(reverse=True, max=5), F.col("o_orderkey").desc())


def _numbered(few: DataFrame, *order: F.Column) -> DataFrame:
    """Positions of a result that a small limit bounds."""
    from pyspark.sql.window import Window

    return few.withColumn("pos", F.row_number().over(Window.orderBy(*order)).cast("long"))


@query("select o_orderkey, row_number() over (order by o_orderkey desc) pos from orders where o_orderkey >= 100 and o_orderkey < 200 order by o_orderkey desc limit 5")
def range_reverse_max(spark, d):
    return _numbered(orders(spark, d).keys(lo=100, hi=200, reverse=True, max=5), F.col("o_orderkey").desc())


@query("select o_orderkey, o_totalprice from orders where o_orderkey >= 100 order by o_orderkey limit 1")
def find_first(spark, d):
    return orders(spark, d).find(lo=100).select("o_orderkey", "o_totalprice")


@query("select max(o_orderkey) o_orderkey from orders")
def findkey_last(spark, d):
    return orders(spark, d).find_key(reverse=True)


@query("select o_orderkey from orders where o_orderkey < 500 order by o_orderkey desc limit 5")
def keyset_page(spark, d):
    return orders(spark, d).keys(hi=500, reverse=True, max=5)


@query("select o_orderkey, o_totalprice from orders where o_orderkey % 3 = 1")
def get_many(spark, d):
    keys = orders(spark, d).keys().where("o_orderkey % 3 = 1")
    return orders(spark, d).get_many(keys).select("o_orderkey", "o_totalprice")


@query("select c_mktsegment, c_custkey, row_number() over (order by c_mktsegment, c_custkey) pos from customer")
def idx_pairs(spark, d):
    index = _by_segment(spark, d)
    return positions(index.df, index.full.order())


@query("select c_mktsegment from customer")
def idx_tups(spark, d):
    return _by_segment(spark, d).tups()


@query("select c_custkey from customer where c_mktsegment = 'BUILDING'")
def idx_keys(spark, d):
    return _by_segment(spark, d).keys(key="BUILDING")


@query("select c_custkey, c_name, c_nationkey, c_mktsegment from customer where c_mktsegment = 'BUILDING'")
def idx_items(spark, d):
    return _by_segment(spark, d).items(key="BUILDING").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")


@query("""select c_mktsegment, cents, c_custkey from (select *, cast(round(c_acctbal * 100) as bigint) cents from customer)
    where (c_mktsegment > 'BUILDING' or (c_mktsegment = 'BUILDING' and cents >= 0)) and (c_mktsegment < 'FURNITURE' or (c_mktsegment = 'FURNITURE' and cents < 0))""")
def idx_values_compound(spark, d):
    return _by_segment_cents(spark, d).items(lo=("BUILDING", 0), hi=("FURNITURE", 0)).select("c_mktsegment", "cents", "c_custkey")


@query("select count(*) n from part where starts_with(p_name, 'blue')")
def idx_count(spark, d):
    return parts(spark, d).add_index("name", {"p_name": F.col("p_name")}).count(prefix="blue")


@query("select exists(select 1 from customer where c_mktsegment = 'BUILDING') has")
def idx_has(spark, d):
    return _by_segment(spark, d).has("BUILDING")


@query("select c_custkey, c_name from customer where c_mktsegment = 'BUILDING' order by c_custkey limit 1")
def idx_get_lowest(spark, d):
    return _by_segment(spark, d).get("BUILDING").select("c_custkey", "c_name")


@query("select c_custkey, c_name, c_mktsegment from customer order by c_mktsegment desc, c_custkey desc limit 1")
def idx_find_reverse(spark, d):
    return _by_segment(spark, d).find(reverse=True).select("c_custkey", "c_name", "c_mktsegment")


@query("select cast(round(c_acctbal * 100) as bigint) cents, c_custkey from customer where c_acctbal < 0")
def idx_partial(spark, d):
    return customers(spark, d).add_index("overdrawn", {"cents": _cents("c_acctbal")}, where=F.col("c_acctbal") < 0).pairs().select("cents", "c_custkey")


@query("select distinct w, p_partkey from (select unnest(string_split(p_name, ' ')) w, p_partkey from part)")
def idx_multi(spark, d):
    words = F.transform(F.split("p_name", " "), lambda x: F.struct(x.alias("w")))
    return parts(spark, d).add_index("words", words, multi=True).pairs().select("w", "p_partkey")


@query("""select c_mktsegment, -cast(round(c_acctbal * 100) as bigint) neg_cents, c_custkey,
    row_number() over (order by c_mktsegment, -cast(round(c_acctbal * 100) as bigint), c_custkey) pos from customer""")
def idx_desc_component(spark, d):
    index = customers(spark, d).add_index("richest", {"c_mktsegment": F.col("c_mktsegment"), "neg_cents": -_cents("c_acctbal")})
    return positions(index.df, index.full.order())


@query("select p_brand, p_size, p_name from part where p_brand = 'Brand#2'")
def idx_covering(spark, d):
    index = parts(spark, d).add_index("brand", {"p_brand": F.col("p_brand"), "p_size": F.col("p_size"), "p_name": F.col("p_name")})
    return index.tups(lo="Brand#2", hi="Brand#2\x00").select("p_brand", "p_size", "p_name")


@query("select l_orderkey, l_linenumber from lineitem where l_orderkey not in (select o_orderkey from orders where o_orderstatus <> 'F')")
def idx_stale(spark, d):
    lines = _table(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    index = Collection(lines.withColumnRenamed("l_orderkey", "o_orderkey"), "o_orderkey").add_index("lines", {"l_linenumber": F.col("l_linenumber")})
    left = index.stale(_table(spark, d, "orders").where("o_orderstatus <> 'F'").select("o_orderkey"))
    return left.select(F.col("o_orderkey").alias("l_orderkey"), "l_linenumber")


@query("select c_mktsegment, min(cast(round(c_acctbal * 100) as bigint)) cents from customer group by 1")
def idx_first_per_prefix(spark, d):
    return _by_segment_cents(spark, d).first_per_prefix()


@query("select c_mktsegment, list(c_custkey order by c_acctbal, c_custkey) keys from customer group by 1")
def groupby_index_order(spark, d):
    return _by_segment_cents(spark, d).groups(["c_mktsegment"], "c_custkey")


@query("select row_number() over (order by ts, event_id) k, event_id from events")
def autoincrement(spark, d):
    return changes.auto_increment(_table(spark, d, "events").select("event_id", "ts"), ["ts", "event_id"]).select("k", "event_id")


@query("select event_type name, 1 + count(*) as value from events group by 1")
def counter_state(spark, d):
    return changes.counters(_table(spark, d, "events"), "event_type")


@query("select event_id, event_type, 9 + row_number() over (partition by event_type order by ts, event_id) as read from events")
def counter_reads(spark, d):
    rows = _table(spark, d, "events").select("event_id", "event_type", "ts")
    return changes.counter_reads(rows, "event_type", ["ts", "event_id"], init=10).select("event_id", "event_type", "read")


@query("select user_id, arg_max(event_type, (ts, event_id)) event_type, arg_max(value, (ts, event_id)) as value from events group by 1")
def upsert_lww(spark, d):
    return changes.fold(_log(spark, d), ["user_id"], ["ts", "event_id"]).select("user_id", "event_type", "value")


@query("select user_id, arg_max(event_type, (ts, event_id)) last_type from events group by 1 having arg_max(event_type, (ts, event_id)) <> 'error'")
def upsert_delete(spark, d):
    state = changes.fold(_log(spark, d), ["user_id"], ["ts", "event_id"], F.col("event_type") == "error")
    return state.select("user_id", F.col("event_type").alias("last_type"))


@query("""with s as (select user_id, event_id, event_type, lag(event_type) over (partition by user_id order by ts, event_id) old from events)
    select user_id, event_id, old, event_type as new from s where old is not null and old <> event_type""")
def index_delta(spark, d):
    rows = changes.with_previous(_log(spark, d), ["user_id"], ["ts", "event_id"], "event_type")
    return rows.where("old <> event_type").select("user_id", "event_id", "old", F.col("event_type").alias("new"))


@query("""with s as (select user_id, event_id, event_type, lag(event_type) over (partition by user_id order by ts, event_id) old from events)
    select user_id, event_id, old as gone, event_type as added from s where old is distinct from event_type""")
def index_entry_changes(spark, d):
    log = _log(spark, d).withColumn("entries", F.array("event_type"))
    rows = changes.index_changes(log, ["user_id"], ["ts", "event_id"], "entries")
    return rows.select("user_id", "event_id", F.get("deleted", F.lit(0)).alias("gone"), F.get("added", F.lit(0)).alias("added"))


@query("select case when row_number() over (partition by user_id order by ts, event_id) = 1 then 'create' else 'replace' end ev, event_id from events")
def create_vs_replace(spark, d):
    return changes.classified(_log(spark, d), ["user_id"], ["ts", "event_id"]).select("ev", "event_id")


@query("""select o_orderkey, case when o_orderkey % 10 = 0 then o_totalprice * 2 else o_totalprice end o_totalprice from orders where o_orderkey % 10 <> 5""")
def upsert_into(spark, d):
    rows = _table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    put = rows.where("o_orderkey % 10 = 0").select("o_orderkey", (F.col("o_totalprice") * 2).alias("o_totalprice"), F.lit(1).alias("seq"), F.lit(False).alias("gone"))
    gone = rows.where("o_orderkey % 10 = 5").select("o_orderkey", "o_totalprice", F.lit(1).alias("seq"), F.lit(True).alias("gone"))
    return changes.upsert(rows, put.union(gone), ["o_orderkey"], ["seq"], "gone")


@query("select c_custkey from customer where not (c_acctbal > 0)")
def constraint_violations(spark, d):
    from ..operators import model

    class Customer(model.Model):
        c_custkey = model.Integer()
        c_acctbal = model.Double()

        @model.constraint
        def positive():
            return F.col("c_acctbal") > 0

    return Customer.violations(_table(spark, d, "customer").select("c_custkey", "c_acctbal")).select("c_custkey")


@query("select user_id, min(ts) first_seen, max(ts) last_seen, count(*) n from events group by 1")
def first_seen_last_seen(spark, d):
    return changes.roll_up(_table(spark, d, "events"), ["user_id"], "ts")


@query("select min(doc_id) doc_id, text from documents group by text")
def dedupe_first_seen(spark, d):
    return changes.keep_first(_table(spark, d, "documents").select("doc_id", "text"), ["text"], "doc_id")


@query("select cast((rn - 1) // 10 as bigint) batch, min(o_orderkey) lo, max(o_orderkey) hi, count(*) n from (select o_orderkey, row_number() over (order by o_orderkey) rn from orders) group by 1")
def batch_max_recs(spark, d):
    rows = batches.batch_numbers(_table(spark, d, "orders").select("o_orderkey"), ["o_orderkey"], 10)
    return rows.groupBy("batch").agg(F.min("o_orderkey").alias("lo"), F.max("o_orderkey").alias("hi"), F.count("*").alias("n"))


@query(r"""with p as (select url, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) dom from pages),
    b as (select *, case when dom is distinct from lag(dom) over (order by url) then 1 else 0 end brk from p),
    i as (select *, sum(brk) over (order by url) isl from b), r as (select *, (row_number() over (partition by isl order by url) - 1) // 10 bt from i)
    select min(url) lo, max(url) hi, count(*) n from r group by isl, bt""")
def batch_grouper(spark, d):
    domain = F.regexp_extract("url", "^[a-z]+://([^/:?#]+)", 1)
    rows = batches.grouped_batch_numbers(_table(spark, d, "pages").select("url"), ["url"], 10, domain)
    return rows.groupBy("batch").agg(F.min("url").alias("lo"), F.max("url").alias("hi"), F.count("*").alias("n")).drop("batch")


@query("select o_orderkey, o_totalprice from orders")
def batch_roundtrip(spark, d):
    rows = batches.batch_numbers(_table(spark, d, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"], 10)
    return batches.expand(batches.pack_batches(rows, ["o_orderkey"]))


@query("select o_orderkey, o_totalprice from orders")
def batch_compressed_roundtrip(spark, d):
    rows = _table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return batches.expand_compressed(batches.compressed_batches(rows, ["o_orderkey"], 4096), "o_orderkey bigint, o_totalprice double")


@query("select cast((rn - 1) // 10 as bigint) batch from (select o_orderkey, row_number() over (order by o_orderkey) rn from orders) where o_orderkey = 1234")
def batch_prune(spark, d):
    rows = batches.batch_numbers(_table(spark, d, "orders").select("o_orderkey"), ["o_orderkey"], 10)
    return batches.look_up(batches.pack_batches(rows, ["o_orderkey"]), ["o_orderkey"], 1234).select("batch")


@query("select o_orderkey, case when o_orderkey <= 240 then 2 when o_orderkey <= 2287 then 3 when o_orderkey <= 67823 then 4 else 5 end len from orders")
def key_pack_int_len(spark, d):
    return _table(spark, d, "orders").select("o_orderkey", F.octet_length(keycodec.pack_int(F.col("o_orderkey"))).alias("len"))


@query("""select o_orderkey, '15' || case when o_orderkey <= 240 then printf('%02x', o_orderkey) when o_orderkey <= 2287 then printf('%02x%02x', 241 + ((o_orderkey - 240) >> 8), (o_orderkey - 240) & 255)
    else printf('f9%04x', o_orderkey - 2288) end hex from orders""")
def key_pack_int_hex(spark, d):
    return _table(spark, d, "orders").select("o_orderkey", F.lower(F.hex(keycodec.pack_int(F.col("o_orderkey")))).alias("hex"))


@query("select event_id, epoch_us(ts) // 1000 ms from events")
def key_time_ms(spark, d):
    value = keycodec.time_value(F.col("ts"))
    return _table(spark, d, "events").select("event_id", F.shiftright(value, keycodec.OFFSET_BITS).alias("ms"))


@query("select c_custkey, c_name from customer")
def key_text_roundtrip(spark, d):
    rows = _table(spark, d, "customer").select("c_custkey", keycodec.pack_columns(keycodec.pack_text(F.col("c_name")), keycodec.pack_int(F.col("c_custkey"))).alias("k"))
    return rows.select("c_custkey", keycodec.unpack_column(F.col("k"))[0]["value"].alias("c_name"))


@query("select c_custkey, row_number() over (order by c_mktsegment, c_custkey) pos from customer")
def key_packed_order(spark, d):
    packed = keycodec.pack_columns(keycodec.pack_text(F.col("c_mktsegment")), keycodec.pack_int(F.col("c_custkey")))
    return positions(_table(spark, d, "customer").select("c_custkey", packed.alias("k")), [F.col("k").asc()]).select("c_custkey", "pos")


@query("select count(*) n, cast(sum(n_chars) as bigint) as chars from documents")
def store_size(spark, d):
    return _table(spark, d, "documents").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("select o_orderkey from orders where o_custkey not in (select c_custkey from customer where c_acctbal < 0)")
def cascade_delete(spark, d):
    rows = _table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    return changes.cascade(rows, _table(spark, d, "customer").where("c_acctbal < 0").select("c_custkey"), ["c_custkey"]).select("o_orderkey")
