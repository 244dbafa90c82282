"""Exact, line and near-duplicate removal against brute force."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from keyloom.llm import exact_dedup, graph, line_dedup, simhash_dedup

SPACE = re.compile(r"[\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    base = ["\n".join(" ".join(r.choice(words) for _ in range(r.randint(1, 9))) for _ in range(r.randint(1, 8))) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(base)]
    for i in range(40, 120):
        t = r.choice(base)
        kind = r.random()
        if kind < 0.3:
            t = t.replace(" ", "  ").replace("\n", " \n\t")
        elif kind < 0.6:
            t = "\n".join([*t.split("\n"), *r.choice(base).split("\n")])
        elif kind < 0.8:
            w = t.split(" ")
            w[r.randrange(len(w))] = "changed"
            t = " ".join(w)
        rows.append((i, t))
    rows += [(120, None), (121, ""), (122, " "), (123, "one"), (124, "One"), (5, base[5]), (125, "a b " * 3000)]
    return spark.createDataFrame([(i, t, "kept", len(t or "")) for i, t in rows], "doc_id long, text string, whole string, n_chars long").repartition(5)


def test_quotient_filters_merge_without_loss():
    r = np.random.default_rng(1)
    values = r.integers(0, 2**64, 500, dtype=np.uint64)
    draws = [r.choice(values, 400) for _ in range(4)]
    filters = [exact_dedup.QuotientFilter.from_bytes(exact_dedup.QuotientFilter.of(d).to_bytes()) for d in draws]
    merged = exact_dedup.QuotientFilter.merged(filters)
    want = collections.Counter(np.concatenate(draws).tolist())
    assert dict(zip(merged.fingerprints.tolist(), merged.counters.tolist())) == want
    assert merged.runs.sum() == len(want) and (np.diff(merged.quotients.astype(np.int64)) > 0).all()


def test_exact(docs):
    groups = collections.defaultdict(list)
    rows = [(r.doc_id, SPACE.sub(" ", r.text or "")) for r in docs.collect()]
    for i, t in rows:
        groups[t].append(i)
    want = sorted((i, min(groups[t]), len(groups[t]), i == min(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in rows)
    assert sorted(map(tuple, exact_dedup.exact_duplicates(docs).collect())) == want
    assert exact_dedup.exact_duplicates(docs.limit(0)).count() == 0


def test_exact_with_null_ids(spark):
    rows = spark.createDataFrame([(None, "a"), (1, "a"), (None, "b")], "doc_id long, text string")
    assert {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_duplicates(rows).collect()} == {(None, 1, 2, False), (1, 1, 2, True), (None, None, 1, True)}


def test_lines(docs):
    one = docs.where("doc_id != 5 or whole is null").union(docs.where("doc_id = 5").limit(1))  # of equal ids the order is the reader's
    got = sorted(line_dedup.dedup_lines(one, 12).collect(), key=lambda r: r.doc_id)
    rows = sorted((r.doc_id, r.text) for r in one.collect() if r.text is not None) + [(r.doc_id, None) for r in one.collect() if r.text is None]
    rows.sort(key=lambda x: x[0])
    removed = brute_runs([t or "" for _, t in rows], 12)
    assert [r.removed_lines for r in got] == removed and any(removed)
    for r, (_, t), gone in zip(got, rows, removed, strict=True):
        assert r.text == (t if not gone else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone))
        assert r.whole == "kept"


def test_lines_without_any(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert line_dedup.dedup_lines(empty).count() == 0
    rows = spark.createDataFrame([(None, None), (1, ""), (2, "a b\nc"), (2, "x")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.text, r.removed_lines) for r in line_dedup.dedup_lines(rows, 1).where("text is not null").collect()) == [(1, "", []), (2, "a b\nc", []), (2, "x", [])]


def brute_runs(texts, min_words):
    """Lines of every run of min_words words that stands earlier, over all pairs of places."""
    texts = [[(n, " ".join(x.split())) for n, x in enumerate(t.split("\n")) if x.split()] for t in texts]
    places = [(d, a) for d, lines in enumerate(texts) for a in range(len(lines))]
    out = [set() for _ in texts]
    for i, (d, a) in enumerate(places):
        for e, b in places[:i]:
            n = 0
            while a + n < len(texts[d]) and b + n < len(texts[e]) and texts[d][a + n][1] == texts[e][b + n][1]:
                n += 1
            if sum(len(x.split()) for _, x in texts[d][a : a + n]) >= min_words:
                out[d].update(x for x, _ in texts[d][a : a + n])
    return [sorted(x) for x in out]


def test_lines_take_the_longest_earlier_run(spark):
    r = random.Random(6)
    lines = [" ".join(r.choice("abcdefgh") for _ in range(n)) for n in (9, 9, 9, 1, 2, 3, 10, 10, 40, 5)]
    a, b, c, x = *lines[:3], "x"
    texts = [f"{a}\n{b}\n{x}", f"{a}\n{b}\n{c}", f"{a}\n \n{b}\n{c}"]
    texts += ["\n".join(r.choices([*lines, ""], k=r.randint(1, 14))) for _ in range(60)]
    texts += ["\n".join(lines[6:9]), "\n".join([lines[6], "y", *lines[6:9]])]
    want = brute_runs(texts, 25)
    assert want[2] == [0, 2, 3]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert [r.removed_lines for r in line_dedup.dedup_lines(rows, 25).orderBy("doc_id").collect()] == want


def brute_simhash(text, shingle):
    words = (text or "").encode().lower().split()
    hashes = [xxhash.xxh64(b" ".join(words[i : i + shingle]), seed=42).intdigest() for i in range(max(1, len(words) - shingle + 1))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def reach(fps, radius):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in fps:
        for b in fps:
            if (a ^ b).bit_count() <= radius:
                root[find(a)] = find(b)
    return {f: find(f) for f in fps}


def test_simhash(docs):
    rows = [(r.doc_id, brute_simhash(r.text, 4)) for r in docs.collect()]
    root = reach({f for _, f in rows}, 4)
    least = {}
    for i, f in rows:
        least[root[f]] = min(i, least.get(root[f], i))
    got = sorted(map(tuple, simhash_dedup.near_duplicates(docs, 4, 4).collect()))
    assert got == sorted((i, f"{f:016x}", least[root[f]]) for i, f in rows)
    assert simhash_dedup.near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("radius, most", [(2, 4096), (4, 3), (6, 4096)])
def test_covering_loses_no_link(spark, radius, most):
    r = random.Random(radius)
    fps = set()
    for _ in range(30):
        f = r.getrandbits(64)
        for _ in range(6):
            for b in r.sample(range(64), r.randint(1, radius + 2)):
                f ^= 1 << b
            fps.add(f)
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    links = simhash_dedup.links(spark.createDataFrame(signed, "fp long"), radius, most)
    roots = {r.node % 2**64: r.root % 2**64 for r in graph.components(links).collect()}
    want = reach(fps, radius)
    sizes = collections.Counter(want.values())
    assert set(roots) == {f for f in fps if sizes[want[f]] > 1}
    assert len(set(roots.values())) == sum(n > 1 for n in sizes.values())
    assert all((want[a] == want[b]) for a, b in roots.items())


def test_masks_cover():
    for radius in (1, 2, 3, 4, 6):
        masks = simhash_dedup.masks(radius)
        assert len(masks) == 2 ** (radius + 1) - 1 and all(m % 2**64 for m in masks)
        r = random.Random(radius)
        for _ in range(300):
            change = sum(1 << b for b in r.sample(range(64), radius))
            assert any(m % 2**64 & change == 0 for m in masks)


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (102, 100), (7, 7)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 102: 100}


def test_near_copies_keep_what_differs(spark):
    words = [f"w{i}" for i in range(300)]
    other = words[:299] + ["x"]
    rows = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(other)), (3, "something else"), (None, "n"), (4, None), (5, "")], "doc_id long, text string")
    assert [r.doc_id for r in simhash_dedup.near_copies(rows).orderBy("doc_id").collect()] == [2, 5]
    assert simhash_dedup.simhash_stage(spark, rows.withColumn("lang", F.lit("x")), "").count() == 4


def test_near_copies_are_verified_on_links(spark):
    words = [f"w{i}" for i in range(60)]
    links = [" ".join(words[i:] + [f"v{j}" for j in range(i)]) for i in (0, 4, 8, 12)]  # a chain: similar to the next only
    rows = spark.createDataFrame([(1, "quite another text of more than five words"), (2, "Two equal texts of more than five words"), (3, "two equal texts of  more than five words"), *enumerate(links, 4), (9, links[3])], "doc_id long, text string")
    sets = [{tuple(t.split()[i : i + 5]) for i in range(56)} for t in links]
    assert [len(a & b) / len(a | b) >= 0.8 for a, b in ((sets[0], sets[1]), (sets[1], sets[2]), (sets[0], sets[2]))] == [True, True, False]
    assert [r.doc_id for r in simhash_dedup.near_copies(rows).orderBy("doc_id").collect()] == [3, 5, 6, 7, 9]


@pytest.mark.parametrize("block", [2, 1000])
def test_similar_within_a_bucket_by_blocks(spark, block):
    r = np.random.default_rng(3)
    base = [r.integers(0, 2**63, 40).astype(np.uint64) for _ in range(5)]
    sets = [np.sort(np.r_[base[i % 5][: 40 - i % 3], r.integers(0, 2**63, i % 3).astype(np.uint64)]) for i in range(30)]
    rows = [(1, 30, bytes([i]), bytes([i]), x.tobytes()) for i, x in enumerate(sets)]
    members = spark.createDataFrame(rows, "key long, n long, node binary, label binary, hashes binary")
    links = simhash_dedup._similar_within(members, 0.8, block)
    roots = {bytes(x.node): bytes(x.root) for x in graph.components(links).collect()}
    assert [roots[bytes([i])] for i in range(30)] == [bytes([i % 5]) for i in range(30)]


def test_near_copies_beside_an_unlike_first(spark):
    r = random.Random(1)
    while True:  # fingerprints within the radius, texts less than 0.8 similar
        a = [f"w{r.random()}" for _ in range(60)]
        b = a[: 60 - 9] + [f"v{r.random()}" for _ in range(9)]
        if (simhash_dedup.simhash(" ".join(a), 5) ^ simhash_dedup.simhash(" ".join(b), 5)).bit_count() <= 6:
            break
    rows = spark.createDataFrame([(1, " ".join(a)), (2, " ".join(b)), (3, " ".join(b))], "doc_id long, text string")
    assert [r.doc_id for r in simhash_dedup.near_copies(rows).collect()] == [3]


def test_bands_reach_similar_texts():
    r = np.random.default_rng(9)
    met = 0
    for _ in range(500):
        n = int(r.integers(60, 300))
        shared, out = r.integers(0, 2**64, n, dtype=np.uint64), n // 9  # J of about 0.8
        a, b = (np.r_[shared[out:], r.integers(0, 2**64, out // 2 + 1, dtype=np.uint64)] for _ in range(2))
        assert 0.78 < (n - out) / (n - out + 2 * (out // 2 + 1)) < 0.92
        met += (simhash_dedup.bands(a) == simhash_dedup.bands(b)).any()
    assert met >= 490


def test_joined_sets_compare_all_pairs():
    r = np.random.default_rng(5)
    base = [np.sort(r.choice(10**6, 40, replace=False)).astype(np.uint64) for _ in range(6)]
    sets = [np.unique(np.r_[r.choice(base[i % 6], 38, replace=False), r.integers(10**6, 2 * 10**6, 2).astype(np.uint64)]) for i in range(60)]
    links = simhash_dedup.joined_sets(sets, np.arange(60), 0.8)
    root = list(range(60))
    for a in range(60):
        for b in range(60):
            if len(np.intersect1d(sets[a], sets[b])) / len(np.union1d(sets[a], sets[b])) >= 0.8:
                root = [root[a] if x == root[b] else x for x in root]
    got = list(range(60))
    for a, b in links:
        got = [got[a] if x == got[b] else x for x in got]
    assert len({*zip(root, got)}) == len(set(root)) == len(set(got)) < 60


def test_lines_over_many_ranges(spark):
    """Ties and common prefixes that span ranges, null ids, repeated ids and a hot run."""
    r = random.Random(11)
    lines = [" ".join(r.choice("abc") for _ in range(r.randint(1, 3))) for _ in range(7)]
    texts = ["\n".join(r.choices([*lines, ""], [5, 3, 2, 1, 1, 1, 1, 1], k=r.randint(0, 25))) for _ in range(50)] + ["\n".join(lines * 2)] * 40
    rows = list(zip([None, None, *range(len(texts) - 2)], texts))
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        frame = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).withColumn("removed_lines", F.lit("own"))
        got = line_dedup.dedup_lines(frame, 6).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got[0].asDict().keys() == {"doc_id", "text", "removed_lines"}
    want = dict(zip(enumerate(texts), brute_runs(texts, 6)))
    assert sorted((-1 if x.doc_id is None else x.doc_id, x.removed_lines) for x in got) == sorted((i - 2 if i > 1 else -1, gone) for (i, _), gone in want.items())


def test_suffixes_are_in_order(spark):
    r = random.Random(2)
    runs = [[r.choice("abc") for _ in range(r.randint(1, 12))] for _ in range(30)]
    rows = [(d, 0, i, ord(x), 0) for d, run in enumerate(runs) for i, x in enumerate(run)]
    ranked = line_dedup.suffix_ranks(spark.createDataFrame(rows, "row long, seg int, i int, h1 long, h2 long"), 8).collect()
    of = {(x.row, x.i): x.r for x in ranked}
    suffix = {(d, i): run[i : i + 8] for d, run in enumerate(runs) for i in range(len(run))}
    order = sorted(of, key=of.get)
    assert all((suffix[a] < suffix[b]) == (of[a] < of[b]) and (suffix[a] == suffix[b]) == (of[a] == of[b]) for a, b in zip(order, order[1:]))
