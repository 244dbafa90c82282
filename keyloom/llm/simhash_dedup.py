"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprints within the radius r are found without a miss: every bit position gets a vector of
r + 1 bits, and each non-zero vector v gives a table whose mask keeps the positions that have odd
parity with v. The at most r positions at which two fingerprints differ have vectors that leave
some v with even parity at all of them, and in that table the masked fingerprints are the same.
Only distinct fingerprints enter the tables, so copies cost nothing there.

Within a bucket a breadth-first search over the exact distances yields a star for each group of
linked members, never all pairs. A bucket with more than BUCKET fingerprints is dealt out again
under a second family of masks, crossed with the first; what is left there agrees on about three
quarters of the bits, which bounds how many distinct fingerprints there can be.

Null and empty texts have no words; their fingerprint is zero, and they link like any other. A text
may have any length. Rows with equal ids are one node each by their fingerprints; null ids are rows like
any other, and the smallest id of a component is null only if all are. The pipeline's stage keeps
rows with null ids. Only the id and the text of docs are read, so that its other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, graph

BITS = 64
SEED = 42
BUCKET = 4096
#: Bands of least shingles and values in each: a pair of similarity J shares a bucket with probability 1 - (1 - J ** ROWS) ** BANDS, 0.998 at 0.8.
BANDS, ROWS = 16, 5
#: Members of a bucket that are compared in one task, or twice as many.
BLOCK = 1000


def _shingles(text: str, shingle: int) -> tuple[bytes, np.ndarray]:
    """The words joined by single spaces, and a hash of each shingle in turn (none without words)."""
    words = text.encode().lower().split()  # of bytes: ASCII letters and white space only
    if not words:
        return b"", np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    stops = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, stops[:-1] + 1]
    last = max(0, len(words) - shingle)
    spans = zip(starts[: last + 1].tolist(), stops[min(shingle, len(words)) - 1 :].tolist(), strict=True)
    return joined, np.array([digest(joined[a:b], SEED) for a, b in spans], np.uint64)


def _majority(hashes: np.ndarray) -> int:
    counts = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 4096):
        counts += np.unpackbits(hashes[i : i + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def simhash(text: str, shingle: int) -> int:
    """The fingerprint of a whole text: the bits set in over half of its shingles' hashes."""
    return _majority(_shingles(text, shingle)[1])


def fingerprints(docs: DataFrame, shingle: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and fp, the fingerprint as a signed 64-bit integer."""

    @F.pandas_udf("long")
    def fp(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series(np.array([simhash(t, shingle) for t in texts], np.uint64).view(np.int64))
        common.release()

    return docs.select(F.col(doc_id).alias("doc_id"), fp(common.text_of(text)).alias("fp"))


def masks(radius: int, step: int = 1) -> list[int]:
    """The tables' masks as signed integers; step deals the vectors out to the positions in another order."""
    last = 2 ** (radius + 1) - 1
    # beyond 63 vectors, those with a fixed leading one: then every mask keeps half of the bits or all
    vectors = [(i * step) % BITS % last + 1 if last < BITS else (i * step) % BITS + BITS for i in range(BITS)]
    out = [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() & 1) for v in range(1, last + 1)]
    return np.array(out, np.uint64).view(np.int64).tolist()


def stars(members: np.ndarray, radius: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each group of linked members: its smallest one and the others."""
    out, rest = [], np.unique(members)
    while len(rest) > 1:
        found, queue, rest = [rest[:1]], [rest[0]], rest[1:]
        while queue and len(rest):
            near = np.bitwise_count((rest ^ queue.pop()).view(np.uint64)) <= radius
            if near.any():
                found.append(rest[near])
                queue.extend(rest[near])
                rest = rest[~near]
        if len(found) > 1:
            group = np.concatenate(found)
            out.append((np.full(len(group) - 1, group.min()), group[group != group.min()]))
    return out


def _linked(rows: DataFrame, keys: list[str], radius: int, most: int | None) -> DataFrame:
    """Links (a, b) among the rows of each key; of buckets above most, a and the key's first part with b null."""

    def task(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # columns of the bucket that is open, and of whole ones before it
        over = None  # the open bucket's key, once it has more than most

        def out(block: np.ndarray) -> Iterator[pa.RecordBatch]:
            new = (block[:-1, 1:] != block[:-1, :-1]).any(0)
            starts = np.flatnonzero(np.r_[True, new])
            sizes = np.diff(np.r_[starts, block.shape[1]])
            a, b, v = [], [], []
            for s, n in zip(starts[sizes > 1].tolist(), sizes[sizes > 1].tolist()):
                members = block[-1, s : s + n]
                if most and n > most:
                    a.append(members), b.append(np.zeros(n, np.int64)), v.append(np.full(n, block[0, s]))
                    continue
                for root, others in stars(members, radius):
                    a.append(others), b.append(root), v.append(np.full(len(root), -1))
            if a:
                a, b, v = map(np.concatenate, (a, b, v))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b, mask=v >= 0), pa.array(v, mask=v < 0)], ["a", "b", "v"])

        def passed(block: np.ndarray) -> pa.RecordBatch:
            n = block.shape[1]
            return pa.RecordBatch.from_arrays([pa.array(block[-1]), pa.nulls(n, pa.int64()), pa.array(block[0])], ["a", "b", "v"])

        for part in parts:
            block = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in part.columns])
            if not block.shape[1]:
                continue
            if over is not None:  # the rest of a bucket that is dealt out again is not held
                same = (block[:-1] == over).all(0)
                yield passed(block[:, same])
                if same.all():
                    continue
                block, over = block[:, ~same], None
            open_at = np.flatnonzero((block[:-1] != block[:-1, -1:]).any(0))
            cut = open_at[-1] + 1 if len(open_at) else 0
            if cut or held and (held[-1][:-1, -1] != block[:-1, 0]).any():
                yield from out(np.concatenate([*held, block[:, :cut]], axis=1))
                held = []
            held.append(block[:, cut:])
            if most and sum(x.shape[1] for x in held) > most:
                whole = np.concatenate(held, axis=1)
                over, held = whole[:-1, :1], []
                yield passed(whole)
        if held:
            yield from out(np.concatenate(held, axis=1))

    count = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.select(*keys, "fp").repartition(count, *keys).sortWithinPartitions(*keys).mapInArrow(common.lean(task), "a long, b long, v long")


def _tables(fps: DataFrame, radius: int, step: int, v: str, key: str) -> DataFrame:
    table = F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias(v), F.col("fp").bitwiseAND(F.lit(m)).alias(key)) for i, m in enumerate(masks(radius, step))]))
    return fps.withColumn("x", table).select(*fps.columns, "x.*")


def links(fps: DataFrame, radius: int, most: int = BUCKET) -> DataFrame:
    """Links a, b between distinct fingerprints (column fp) that connect whatever is within the radius."""
    first = common.stored(_linked(_tables(fps, radius, 1, "v", "key"), ["v", "key"], radius, most), "simhash-links")
    table = F.create_map(*[F.lit(x) for i, m in enumerate(masks(radius)) for x in (i, m)])
    over = first.where("b is null").select(F.col("a").alias("fp"), "v", F.col("a").bitwiseAND(table[F.col("v").cast("int")]).alias("key"))
    second = _linked(_tables(over, radius, 29, "w", "more"), ["v", "key", "w", "more"], radius, None)
    return first.where("b is not null").select("a", "b").union(second.select("a", "b")).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 5, radius: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the smallest id that links reach."""
    slim = common.stored(fingerprints(docs, shingle, doc_id, text), "simhash")
    nodes = common.stored(slim.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-nodes")
    roots = graph.components(links(nodes.select("fp"), radius))
    of_node = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = of_node.groupBy("root").agg(F.min("first_id").alias("component_id"))
    labels = common.stored(of_node.join(least, "root").select("fp", "component_id"), "simhash-labels")
    return slim.join(labels, "fp", "left").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


#: Multipliers that order the shingles' hashes anew, one for each value of a band.
_ORDERS = np.random.default_rng(SEED).integers(0, 2**63, (BANDS, ROWS), np.uint64) * np.uint64(2) + np.uint64(1)


def bands(hashes: np.ndarray) -> np.ndarray:
    """For each band, one hash of the least shingles under its orders; equal with probability J ** ROWS."""
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for i in range(0, len(hashes), 4096):
        block = hashes[i : i + 4096]
        np.minimum(least, [(block * m).min() for m in _ORDERS.ravel()], out=least)
    return np.array([xxhash.xxh64_intdigest(x.tobytes(), i) for i, x in enumerate(least.reshape(BANDS, ROWS))], np.uint64)


def _sketches(docs: DataFrame, shingle: int) -> DataFrame:
    """docs: doc_id, text. doc_id, node (128 bits of the words), fp and keys (of the bands)."""

    def task(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            nodes, fps, keys = [], [], []
            for text in part.column(1).to_pylist():
                joined, hashes = _shingles(text, shingle)
                nodes.append(xxhash.xxh3_128_digest(joined))
                fps.append(_majority(hashes))
                keys.append(bands(hashes).view(np.int64))
            yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(nodes, pa.binary()), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "node", "fp", "keys"])

    return docs.mapInArrow(common.lean(task), "doc_id long, node binary, fp long, keys array<long>")


def _sets(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """node and its distinct shingles' hashes in order. docs: doc_id, text; wanted: node, first_id (of a row with its words)."""

    def task(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            nodes, sets = [], []
            for node, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                joined, hashes = _shingles(text, shingle)
                if xxhash.xxh3_128_digest(joined) == node:  # rows with equal ids may differ
                    nodes.append(node)
                    sets.append(np.unique(hashes).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(sets, pa.binary())], ["node", "hashes"])

    rows = docs.join(wanted, F.col("doc_id") == F.col("first_id")).select("node", "text").mapInArrow(common.lean(task), "node binary, hashes binary")
    return rows.groupBy("node").agg(F.first("hashes").alias("hashes"))


def _similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs a, b whose sets' Jaccard similarity reaches similarity."""

    @F.pandas_udf("double")
    def jaccard(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b, strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            out.append(both / max(1, len(x) + len(y) - both))
        common.release()
        return pd.Series(out, dtype="float64")

    own, other = (sets.select(F.col("node").alias(c), F.col("hashes").alias(f"of_{c}")) for c in "ab")
    return pairs.join(own, "a").join(other, "b").where(jaccard("of_a", "of_b") >= similarity).select("a", "b")


def joined_sets(sets: list[np.ndarray], labels: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Pairs of similar sets that connect whatever such pairs do; sets with equal labels are connected already."""
    labels, sizes, out = np.unique(labels, return_inverse=True)[1], np.array([len(x) for x in sets]), []
    owner = np.repeat(np.arange(len(sets)), sizes)
    words, where = np.unique(np.concatenate(sets), return_inverse=True)
    owner = owner[np.argsort(where, kind="stable")]
    ends = np.cumsum(np.bincount(where, minlength=len(words)))
    starts = np.r_[0, ends[:-1]]
    at = np.split(where, np.cumsum(sizes)[:-1])
    for i in range(len(sets)):
        if (labels[i:] == labels[i]).all():  # of the pairs that are left, none has two labels
            break
        n = ends[at[i]] - starts[at[i]]
        upto = np.cumsum(n)
        both = np.bincount(owner[np.repeat(starts[at[i]] - (upto - n), n) + np.arange(upto[-1] if len(upto) else 0)], minlength=len(sets))
        near = np.flatnonzero((both / np.maximum(1, sizes + sizes[i] - both) >= similarity) & (labels != labels[i]))
        for label, j in {labels[j]: j for j in near.tolist()}.items():
            out.append((i, j))
            labels[labels == label] = labels[i]
    return out


def _similar_within(members: DataFrame, similarity: float, block: int = BLOCK) -> DataFrame:
    """members: key, n (how many the key has), node, label, hashes. Links a, b that connect what is similar within each key.

    A key's members are dealt into blocks; a task compares those of one block or of two, so that it holds twice block of them or so.
    """

    def task(group: pd.DataFrame) -> pd.DataFrame:
        nodes = group["node"].tolist()
        common.release()
        found = joined_sets([np.frombuffer(x, np.uint64) for x in group["hashes"]], group["label"].to_numpy(), similarity)
        return pd.DataFrame({"a": [nodes[i] for i, _ in found], "b": [nodes[j] for _, j in found]}, dtype=object)

    blocks = F.ceil(F.col("n") / block).cast("int")
    dealt = members.withColumn("_own", F.pmod(F.xxhash64("node"), blocks).cast("int"))
    both = dealt.select("key", "node", "label", "hashes", "_own", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("_other"))
    return both.groupBy("key", F.least("_own", "_other").alias("_a"), F.greatest("_own", "_other").alias("_b")).applyInPandas(task, "a binary, b binary")


def near_copies(docs: DataFrame, shingle: int = 5, radius: int = 6, similarity: float = 0.8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Ids of documents that similar pairs connect with a smaller id. A pair is similar if its shingles' Jaccard similarity reaches similarity.

    Equal texts are one node. Candidates are the nodes of one bucket: a component of fingerprints
    within the radius, or a band of least shingles. Within a bucket every pair is compared that
    others have not connected: first all with one member, then, in the buckets that this left
    in parts, block by block, which yields links, never all pairs.
    """
    rows = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc_id"), common.text_of(text).alias("text"))
    slim = common.stored(_sketches(rows, shingle), "near-sketches")
    nodes = common.stored(slim.groupBy("node").agg(F.min("doc_id").alias("first_id"), F.first("fp").alias("fp"), F.first("keys").alias("keys")), "near-nodes")
    close = graph.components(links(nodes.select("fp").distinct(), radius)).withColumnRenamed("node", "fp")
    # a component is named by its fingerprint; fingerprints that several nodes share are components, too
    of_fp = nodes.join(close, "fp", "left").select("node", F.xxhash64(F.lit("fp"), F.coalesce("root", "fp")).alias("key"))
    members = nodes.select("node", F.explode("keys").alias("key")).union(of_fp)
    buckets = members.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("leader"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("x"), F.bit_xor(F.xxhash64("node")).alias("y")).where("n > 1")
    buckets = buckets.groupBy("n", "leader", "x", "y").agg(F.min("key").alias("key")).select("key", "n", "leader")  # equal buckets once
    members = common.stored(members.join(buckets, "key"), "near-buckets")
    wanted = nodes.join(members.select("node").distinct(), "node", "left_semi").select("node", "first_id")
    sets = common.stored(_sets(rows, wanted, shingle), "near-sets")
    pairs = members.where("node != leader").select(F.col("node").alias("a"), F.col("leader").alias("b")).distinct()
    similar = common.stored(_similar(pairs, sets, similarity), "near-links")
    roots = graph.components(similar)
    labelled = members.where("n > 2").join(roots, "node", "left").select("key", "n", "node", F.coalesce("root", "node").alias("label"))
    labelled = common.stored(labelled, "near-labels")
    parted = labelled.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low != high").select("key")
    more = _similar_within(labelled.join(parted, "key").join(sets, "node"), similarity)
    roots = graph.components(similar.union(more))
    of_node = common.stored(nodes.select("node", "first_id").join(roots, "node", "left").select("node", "first_id", F.coalesce("root", "node").alias("root")), "near-roots")
    least = of_node.groupBy("root").agg(F.min("first_id").alias("keep_id"))
    return slim.select("doc_id", "node").join(of_node.join(least, "root").select("node", "keep_id"), "node").where("doc_id != keep_id").select("doc_id").distinct()


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of near copies the document with the smallest id stays."""
    copies = common.cut(near_copies(docs).select(F.col("doc_id").alias("copy_id")))
    return docs.join(copies, F.col("doc_id") == F.col("copy_id"), "left_anti")


def op10_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"), shingle=4, radius=4)


QUERIES = {"op10_simhash_dedup": op10_simhash_dedup}
