"""Indexes, changes, batches, models, stores and streams on small tables."""

import pytest
from pyspark.sql import functions as F

from keyloom.operators import batches, changes, model
from keyloom.operators.collection import Collection, positions
from keyloom.sources import codecs, errors, store, trace
from keyloom.streaming.upserts import upsert_stream

PEOPLE = [("Alfred", "Nairobi", 46), ("Jemima", "Madrid", 64), ("Mildred", "Paris", 34), ("Winnifred", "Paris", 24)]


@pytest.fixture(scope="module")
def people(spark):
    return Collection(spark.createDataFrame(PEOPLE, "name string, city string, age int"), "name")


def test_index_scans(people):
    index = people.add_index("age_city", {"age": F.col("age"), "city": F.col("city")})
    assert [r.name for r in index.keys().collect()] == ["Winnifred", "Mildred", "Alfred", "Jemima"]
    assert [r.name for r in index.keys(lo=34, hi=64).collect()] == ["Mildred", "Alfred"]
    assert index.find(reverse=True).first().name == "Jemima"
    assert index.has((34, "Paris")).first().has and not index.has((34,)).first().has
    by_city = people.add_index("city", {"city": F.col("city")})
    assert [r.name for r in by_city.items(key="Paris", reverse=True).collect()] == ["Winnifred", "Mildred"]
    assert by_city.get("Paris").first().name == "Mildred"
    assert by_city.count(prefix="P").first().n == 2
    assert by_city.items(max=1, reverse=True).first().name == "Winnifred"


def test_multi_entry_index_is_a_set(spark):
    c = Collection(spark.createDataFrame([(1, ["a", "b", "a"]), (2, None), (3, [])], "k int, names array<string>"), "k")
    index = c.add_index("names", F.transform("names", lambda x: F.struct(x.alias("n"))), multi=True)
    assert [tuple(r) for r in index.pairs().collect()] == [("a", 1), ("b", 1)]
    assert index.stale(c.df.where("k > 1")).count() == 2


def test_fold_and_deltas(spark):
    log = spark.createDataFrame([(1, 1, "a", False), (1, 2, "b", False), (2, 1, "c", False), (2, 2, None, True), (3, 1, "d", True), (3, 2, "e", False)], "k int, seq int, v string, gone boolean")
    assert {(r.k, r.v) for r in changes.fold(log, ["k"], ["seq"], F.col("gone")).collect()} == {(1, "b"), (3, "e")}
    assert changes.fold(log.limit(0), ["k"], ["seq"]).count() == 0
    rows = changes.index_changes(log.withColumn("e", F.array_compact(F.array("v"))), ["k"], ["seq"], "e").collect()
    assert {(r.k, r.seq, tuple(r.deleted), tuple(r.added)) for r in rows} == {(1, 1, (), ("a",)), (1, 2, ("a",), ("b",)), (2, 1, (), ("c",)), (2, 2, ("c",), ()), (3, 1, (), ("d",)), (3, 2, ("d",), ("e",))}


def test_counters(spark):
    rows = spark.createDataFrame([("t", 1, 1), ("t", 2, 0), ("t", 3, 1)], "name string, seq int, n int")
    assert [r.read for r in changes.counter_reads(rows, "name", ["seq"], 10, "n").orderBy("seq").collect()] == [10, 11, 11]
    assert changes.counters(rows, "name", 10, "n").first().value == 12


def test_ancestors(spark):
    rows = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 99)], "id int, parent int")
    assert {tuple(r.path) for r in changes.ancestors(rows, "id", "parent").collect()} == {(1,), (1, 2), (1, 2, 3)}


@pytest.mark.parametrize("n", [0, 1, 57])
def test_positions(spark, n):
    rows = positions(spark.range(n).select((F.col("id") * 7 % 57).alias("x")), [F.col("x").asc()])
    assert sorted((r.x, r.pos) for r in rows.collect()) == [(x, i + 1) for i, x in enumerate(sorted(i * 7 % 57 for i in range(n)))]


def test_batches(spark):
    rows = spark.createDataFrame([(1, "dave"), (3, "jim"), (4, "zork")], "k int, v string")
    packed = batches.pack_batches(batches.batch_numbers(rows, ["k"], 3), ["k"])
    assert packed.count() == 1 and [r.v for r in batches.expand(packed).orderBy("k").collect()] == ["dave", "jim", "zork"]
    assert batches.look_up(packed, ["k"], 3).count() == 1 and batches.look_up(packed, ["k"], 5).count() == 0
    after = batches.replace_in(packed, ["k"], spark.createDataFrame([(3, "", True)], "k int, v string, gone boolean"), F.col("gone"))
    assert after.count() == 2 and [r.k for r in batches.expand(after).orderBy("k").collect()] == [1, 4]
    after = batches.replace_in(packed, ["k"], spark.createDataFrame([(3, "james")], "k int, v string"))
    assert after.count() == 3 and {(r.k, r.v) for r in batches.expand(after).collect()} == {(1, "dave"), (3, "james"), (4, "zork")}


def test_batches_break_where_the_group_changes(spark):
    rows = spark.createDataFrame([(i, g) for i, g in enumerate("aaabbaac")], "k int, g string")
    got = batches.grouped_batch_numbers(rows, ["k"], 2, F.col("g")).groupBy("batch").agg(F.min("k").alias("lo"), F.count("*").alias("n")).orderBy("lo").collect()
    assert [(r.lo, r.n) for r in got] == [(0, 2), (2, 1), (3, 2), (5, 2), (7, 1)]


def test_compressed_batches(spark):
    rows = spark.range(500).selectExpr("id k", "repeat(uuid(), 3) v").cache()
    packed = batches.compressed_batches(rows, ["k"], 2000)
    assert packed.agg(F.max(F.octet_length("payload"))).first()[0] <= 2000
    assert sorted(map(tuple, batches.expand_compressed(packed, "k long, v string").collect())) == sorted(map(tuple, rows.collect()))


class Post(model.Model):
    name = model.String()
    text = model.String(default="")
    tags = model.List()

    @model.constraint
    def long_name():
        return F.length("name") >= 3

    @model.index
    def by_name():
        return {"name": F.col("name")}

    @model.before_create
    def stamp(rows):
        return rows.withColumn("created", F.lit(1.0))


def test_model(spark):
    saved = Post.save(None, spark.createDataFrame([("dave",), ("jim",)], "name string"), ["name"])
    assert sorted((r.id, r.name, r.text, r.tags, r.created) for r in saved.collect()) == [(1, "dave", "", [], 1.0), (2, "jim", "", [], 1.0)]
    again = Post.save(saved, saved.where("id = 1").withColumn("text", F.lit("x")))
    assert sorted((r.id, r.text) for r in again.collect()) == [(1, "x"), (2, "")]
    with pytest.raises(model.ConstraintError) as e:
        Post.save(again, spark.createDataFrame([("x",)], "name string"), ["name"])
    assert e.value.violators.count() == 1 and str(e.value) == "long_name"
    assert Post.delete(again, spark.createDataFrame([(1,)], "id long")).count() == 1
    assert Post.collection(again).indices["by_name"].get("jim").first().id == 2
    with pytest.raises(TypeError):
        type("Two", (model.Model,), {"a": model.key(lambda: {}), "b": model.key(lambda: {})})


def test_subtree(spark):
    rows = spark.createDataFrame([([1],), ([1, 2],), ([1, 2, 3],), ([1, 20],), ([2],)], "path array<bigint>")
    assert [r.path for r in model.subtree(rows, "path", [1, 2]).collect()] == [[1, 2], [1, 2, 3]]


def test_store(spark, tmp_path):
    s = store.open_store(spark, f"file:{tmp_path}/s;x=1,readonly=")
    df = spark.createDataFrame([(2, "b"), (1, "a")], "k int, v string")
    s.put("t", df, ["k"])
    assert [r.v for r in s["t"].values().collect()] == ["a", "b"]
    before = s["t"].df
    with s.begin(write=True):
        s.put("t", df.where("k = 1"), ["k"])
        assert s["t"].df.count() == 1
    assert before.count() == 2 and s["t"].df.count() == 1
    with s.begin(write=True):
        s.put("t", df, ["k"])
        raise errors.AbortError
    assert s["t"].df.count() == 1
    with pytest.raises(ZeroDivisionError), s.begin(write=True):
        s.count("c")
        1 / 0
    assert (s.count("c", 1, 10), s.count("c", 0), s.count("c", 2), s.count("c", 0)) == (10, 11, 11, 13)
    s.rename("t", "u")
    assert store.Store(spark, f"{tmp_path}/s")["u"].df.count() == 1
    with pytest.raises(errors.NotFound):
        s["t"]
    with pytest.raises(errors.ConfigError):
        s.put("u", df, ["v"])
    with pytest.raises(errors.TxnError), s.begin():
        s.put("u", df, ["k"])
    with pytest.raises(errors.ConfigError):
        store.open_store(spark, "lisp:/x")
    assert {r.name for r in s.info().where("kind = 'collection'").collect()} == {"u"}


def test_codecs(spark):
    c = codecs.JsonCodec("a int, b string")
    df = spark.createDataFrame([(1, 5, "x")], "k int, a int, b string")
    packed = c.encode(df, ["k"])
    assert packed.first().value == '{"a":5,"b":"x"}' and tuple(Collection(packed, "k", codec=c).items().first()) == (1, 5, "x")
    assert Collection(packed, "k", codec=c).values(raw=True).first().value == '{"a":5,"b":"x"}'
    pack, unpack = codecs.Registry().get("ZLIB")
    row = spark.createDataFrame([(b"abc" * 50,), (None,)], "x binary").select("x", pack(F.col("x")).alias("z")).select("x", "z", unpack(F.col("z")).alias("y")).collect()
    assert row[0].x == row[0].y and len(row[0].z) < 30 and row[1].y is None


def test_trace(spark, tmp_path):
    log = spark.createDataFrame([(1, "t", "put", b"a", b"1"), (2, "t", "put", b"b", b"2"), (3, "t", "delete", b"a", None)], "seq long, txn string, op string, key binary, value binary")
    trace.write_trace(log, str(tmp_path / "x"))
    assert [tuple(map(bytes, r)) for r in trace.replay(trace.read_trace(spark, str(tmp_path / "x"))).collect()] == [(b"b", b"2")]


def test_stream(spark, tmp_path):
    schema = "k int, seq int, v string, gone boolean"
    s = store.Store(spark, str(tmp_path / "s"))
    for rows in ([(1, 1, "a", False), (2, 1, "b", False)], [(1, 3, "c", False), (2, 2, None, True)], [(1, 2, "late", False)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
        log = spark.readStream.schema(schema).parquet(str(tmp_path / "log"))
        upsert_stream(log, s, "t", ["k"], ["seq"], str(tmp_path / "cp"), "gone").awaitTermination()
    assert {(r.k, r.v) for r in s["t"].df.where("NOT deleted").collect()} == {(1, "c")}


def test_ancestors_of_any_depth(spark):
    chain = [(i, i - 1 if i else None) for i in range(200)]
    rings = [(1000, 1001), (1001, 1000), (1002, 1000), (1003, 1003), (1004, 7777), (1005, 1004)]
    rows = spark.createDataFrame(chain + rings, "id int, parent int")
    assert {r.node: r.path for r in changes.ancestors(rows, "id", "parent").collect()} == {i: list(range(i + 1)) for i in range(200)}
    assert changes.ancestors(rows.limit(0), "id", "parent").count() == 0


def test_groups_may_span_ranges(spark):
    rows = spark.createDataFrame([("hot" if i % 10 else None, i, i % 3) for i in range(300)], "k string, seq int, n int")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        reads = {r.seq: r.read for r in changes.counter_reads(rows, "k", ["seq"], 5, "n").collect()}
        old = {r.seq: r.old for r in changes.with_previous(rows, ["k"], ["seq"], "n").collect()}
        kinds = {r.seq: r.ev for r in changes.classified(rows, ["k"], ["seq"]).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    for first, members in ((0, range(0, 300, 10)), (1, [i for i in range(300) if i % 10])):
        total, last = 5, None
        for i in members:
            assert (reads[i], old[i], kinds[i]) == (total, last, "create" if i == first else "replace")
            total, last = total + i % 3, i % 3


def test_greedy_batches(spark):
    rows = spark.createDataFrame([(i, "x" * (i * 7 % 23), i // 40) for i in range(200)], "k int, v string, g int")
    sizes = {r.k: len(r.j) for r in rows.selectExpr("k", "to_json(struct(k, v, g)) j").collect()}
    got = batches.greedy_batch_numbers(rows, ["k"], 5, 150, F.col("g")).groupBy("batch").agg(F.sort_array(F.collect_list("k")).alias("ks")).collect()
    ends = {r.batch >> 40: max(r.ks[-1] for r in got if r.batch >> 40 == of) for of in {r.batch >> 40 for r in got} for r in got if r.batch >> 40 == of}
    want, held = [], []
    for k in range(200):
        if held and (k // 40 != held[-1] // 40 or len(held) == 5 or sum(sizes[x] for x in held) + sizes[k] > 150 or held[-1] in ends.values()):
            want.append(held)
            held = []
        held.append(k)
    assert sorted(r.ks for r in got) == [*want, held]
    with pytest.raises(ValueError):
        batches.greedy_batch_numbers(rows, ["k"])


def test_rebatch(spark):
    rows = spark.range(20).selectExpr("id k", "id * 2 v")
    held = batches.pack_batches(batches.batch_numbers(rows.where("k between 5 and 9"), ["k"], 3), ["k"])
    rest = rows.where("k not between 5 and 9")
    kept = batches.rebatch(held, rest, ["k"], 4)
    assert sorted((r.lo.k, r.hi.k) for r in kept.collect()) == [(0, 3), (4, 4), (5, 7), (8, 9), (10, 13), (14, 17), (18, 19)]
    assert kept.select("batch").distinct().count() == 7
    anew = batches.rebatch(held, rest, ["k"], 4, preserve=False)
    assert sorted((r.lo.k, r.hi.k) for r in anew.collect()) == [(0, 3), (4, 7), (8, 11), (12, 15), (16, 19)]
    assert sorted(map(tuple, batches.expand(anew).collect())) == sorted(map(tuple, rows.collect()))


def test_uuid_keys(spark):
    import uuid

    ids = [str(uuid.UUID(int=i << 96)) for i in (1, 5, 9)]
    c = Collection(spark.createDataFrame([(x,) for x in ids], "id string"), "id", uuids=("id",))
    assert [r.id for r in c.keys(lo=uuid.UUID(int=5 << 96)).collect()] == ids[1:]
    assert c.has(uuid.UUID(int=9 << 96)) and c.keys(lo="zzz").count() == 3 and c.keys(hi="zzz").count() == 0  # texts come before


def test_save_refuses_repeated_keys(spark):
    class Pair(model.Model):
        k = model.Integer()
        v = model.String()

        @model.key
        def by_k():
            return {"k": F.col("k")}

    rows = spark.createDataFrame([(1, "x"), (1, "y")], "k long, v string")
    with pytest.raises(model.ConstraintError) as e:
        Pair.save(None, rows)
    assert str(e.value) == "key" and e.value.violators.count() == 2
    assert [tuple(r) for r in Pair.save(None, rows, ["v"]).collect()] == [(1, "y")]
    with pytest.raises(TypeError):
        Pair.rows()
    with pytest.raises(TypeError):
        type("Other", (Post,), {"by_name": model.index(lambda: {"name": F.col("text")})})


def test_references_and_hooks(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "s"))
    heard = []

    class Line(model.Model):
        k = model.Integer()
        parent = model.Integer()

        @model.key
        def by_k():
            return {"k": F.col("k")}

        @model.index
        def by_parent():
            return {"parent": F.col("parent")}

        @model.reference
        def above():
            return ["parent"], spark.createDataFrame([(7,)], "parent long")

        @model.after_replace
        def hear(rows):
            heard.append([(r.k, r.old.parent, r.parent) for r in rows.collect()])
            return False  # once only

    assert callable(Line.by_parent)
    Line.bind(s)
    Line.put(spark.createDataFrame([(1, 7), (2, None)], "k long, parent long"))
    Line.put(spark.createDataFrame([(2, 7)], "k long, parent long"))
    Line.put(spark.createDataFrame([(1, None)], "k long, parent long"))
    assert heard == [[(2, None, 7)]] or heard == [[]]
    assert [r.k for r in Line.by_parent.keys(key=7).collect()] == [2]
    with pytest.raises(model.ConstraintError) as e:
        Line.put(spark.createDataFrame([(3, 8)], "k long, parent long"))
    assert str(e.value) == "above" and Line.rows().count() == 2
    Line.remove(spark.createDataFrame([(1,)], "k long"))
    assert [r.k for r in Line.rows().collect()] == [2]


def test_store_events_meta_and_cleaning(spark, tmp_path):
    s, heard = store.Store(spark, str(tmp_path / "s")), []
    s.listen("on_commit", lambda: heard.append("older"))
    s.listen("on_commit", lambda: heard.append("newer"))
    for event in ("after_commit", "after_abort"):
        s.listen(event, lambda event=event: heard.append(event))
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    s.put("t", df, ["k"])
    assert heard == ["newer", "older", "after_commit"]
    s.listen("on_commit", lambda: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        s.put("t", df.limit(0), ["k"])
    assert heard[-1] == "after_abort" and s["t"].df.count() == 2
    s.listeners.clear()
    with pytest.raises(errors.ConfigError):
        s.listen("on_commit", print, "t")
    s.set_meta("collection", "t", "note", {"x": 1})
    number = s.add_codec("MINE", lambda c: c, lambda c: c)
    again = store.Store(spark, s.path)
    assert again.get_meta("collection", "t", "note") == {"x": 1} and again.codecs.numbers["MINE"] == number == again.add_codec("MINE", lambda c: c, lambda c: c)
    s.set_meta("collection", "t", "note", None)
    assert s.get_meta("collection", "t", "note", 5) == 5
    s.put("t", df.limit(0), ["k"])
    s.put("t", df, ["k"])
    assert s.clean(keep=1) > 0 and store.Store(spark, s.path)["t"].df.count() == 2
    with s.begin(write=True):
        assert s.count("n") == 1 and s.count("n") == 2


def test_merge_leaves_other_files_alone(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "s"))
    s.put("t", spark.range(1000).selectExpr("id k", "1 seq", "'old' v"), ["k"], 8)
    before = set(s.manifest()["collections"]["t"]["files"])
    s.merge("t", spark.createDataFrame([(3, 2, "new"), (3, 0, "late"), (2000, 1, "new")], "k long, seq int, v string"), ["k"], ["seq"])
    assert len(before & set(s.manifest()["collections"]["t"]["files"])) == 7
    assert {r.k for r in s["t"].df.where("v = 'new'").collect()} == {3, 2000} and s["t"].df.count() == 1001


def test_forgetting_deletes(spark, tmp_path):
    from keyloom.streaming.upserts import forget

    s = store.Store(spark, str(tmp_path / "s"))
    s.put("t", spark.createDataFrame([(1, 1, True), (2, 9, True), (3, 1, False)], "k int, seq int, deleted boolean"), ["k"])
    forget(s, "t", F.col("seq") < 5)
    assert sorted(r.k for r in s["t"].df.collect()) == [2, 3]


def test_incremental_batches_at_a_step_s_end(spark, tmp_path):
    """Records of one key on both sides of a step's end all count."""
    from keyloom.plans import mutations

    rows = spark.range(100_000).select(F.greatest("id", F.lit(3)).alias("o_orderkey"), F.lit(1.0).alias("o_totalprice"))
    rows.union(rows.where("o_orderkey IN (49999, 99990)")).write.parquet(f"{tmp_path}/orders.parquet")
    got = mutations.batch_incremental(spark, str(tmp_path)).orderBy("batch").collect()
    keys = sorted([max(i, 3) for i in range(100_000)] + [49999, 99990])
    assert [tuple(r[c] for c in ("batch", "lo", "hi", "n")) for r in got] == [(i // 10, keys[i], keys[min(i + 10, len(keys)) - 1], min(10, len(keys) - i)) for i in range(0, len(keys), 10)]


def test_incremental_batches_number_every_record(spark):
    keys = [None, None, None, *range(20), 7, 7, 7, 7]
    got = batches.incremental_batches(spark.createDataFrame([(k,) for k in keys], "k long"), "k", 3, 7).collect()
    ordered = sorted(keys, key=lambda k: -1 if k is None else k)
    want = [(k, i // 7, i // 7 * 3 + i % 7 // 3) for i, k in enumerate(ordered)]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_incremental_batches_need_no_job_for_each_step(spark):
    jobs = []
    for step in (500, 5):
        spark.sparkContext.setJobGroup(f"step-{step}", "")
        assert batches.incremental_batches(spark.range(500), "id", 5, step).agg(F.max("batch")).first()[0] == 99
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"step-{step}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[0] == jobs[1]
