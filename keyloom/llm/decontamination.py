"""Benchmark decontamination by SimHash over windows as long as the benchmark's items.

A window of a document matches an item if both have as many words, their SimHash fingerprints
differ in at most `radius` bits, and the weighted Jaccard similarity of their shingles (five words,
weighted by how often each occurs) is `similarity` or more. Windows are paired with items by their
fingerprints alone, which meet through eight blocks of eight bits; if they differ in at most 8 r + 7
bits, some block differs in r bits at most, so an item's blocks with all changes of so few bits find
every window within the radius. Only windows of which a share of `similarity` of the shingles stands
in the benchmark's items of that length, whichever these are, are fingerprinted at all; no other can
be similar enough to any item. Windows of equal words are compared once, however many documents hold
them.

Everything runs as DataFrame expressions. Words are lower-cased and split at white space; an item
of fewer than five words is one shingle. Shingles are compared by 64-bit hashes, within one pair of a window and an item. Texts and items may be as long as Spark's strings. Null and
empty texts and items match nothing; null ids are ids like any other; rows with equal ids are searched
each, and items with equal ids are looked for each. A document with several windows that match an item gives the most similar one, the first of
those. Only the id and the text of docs and items are read, so that other columns may have any names.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BLOCKS, BLOCK_BITS = 8, 8
#: Rows of the benchmark (shingles, blocks) that are sent to all tasks at most, some 50 MB; more are joined by a shuffle.
BROADCAST = 1_000_000
#: Documents with windows to look at whose keys are sent to all tasks at most, some 20 MB; of more, the texts are shuffled.
KEYS = 200_000


def _words(text: str) -> F.Column:
    return F.array_remove(F.split(F.lower(common.text_of(text)), common.SPACE), "")


def _hashes(words: str, size: int) -> F.Column:
    """Hashes of all runs of size words, in order."""
    last = F.size(words) - size
    starts = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(size)]))


def _shingles(words: str, size: str, most: int) -> F.Column:
    """Hashes of all runs of as many words as the column size says, at most most."""
    out = F.lit(None).cast("array<bigint>")
    for k in range(1, most + 1):
        out = F.when(F.col(size) == k, _hashes(words, k)).otherwise(out)
    return out


def _fingerprints(rows: DataFrame, key: list[str]) -> DataFrame:
    """rows: key, h. The majority of each bit over the shingles' hashes, two bits to a sum: no text has 2 ** 31 shingles."""
    lanes, bits = 0x0000000100000001, 32
    sums = [F.sum(F.shiftrightunsigned("h", i).bitwiseAND(F.lit(lanes))).alias(f"s{i}") for i in range(bits)]
    summed = rows.groupBy(*key).agg(F.count("*").alias("n"), *sums)
    # one expression for all bits: a tree of 64 costs the driver tens of megabytes with every plan that holds it
    of_bit = f"shiftrightunsigned(sums[b % {bits}], IF(b < {bits}, 0, {bits})) & 2147483647L"
    fp = F.expr(f"aggregate(sequence(0, 63), 0L, (fp, b) -> fp | IF(2 * ({of_bit}) > n, shiftleft(1L, b), 0L))")
    return summed.select(*key, "n", F.array(*[f"s{i}" for i in range(bits)]).alias("sums")).select(*key, fp.alias("fp"))


def _changes(radius: int) -> list[int]:
    """All changes of a block that the pigeonhole principle asks for."""
    most = radius // BLOCKS
    return [sum(1 << b for b in c) for r in range(most + 1) for c in combinations(range(BLOCK_BITS), r)]


def _blocks(rows: DataFrame, changes: list[int], *keep: str) -> DataFrame:
    """keep, block and value: each row's fp by blocks, with all given changes."""
    codes = [k << BLOCK_BITS | c for k in range(BLOCKS) for c in changes]  # one literal, not an expression for each
    coded = rows.select(*keep, "fp", F.explode(F.lit(codes)).alias("code")).withColumn("block", F.shiftright("code", BLOCK_BITS))
    value = F.expr(f"shiftrightunsigned(fp, block * {BLOCK_BITS}) & 255L ^ (code & 255)")
    return coded.withColumn("value", value).drop("code")


def _sent(df: DataFrame, most: int) -> DataFrame:
    """df with a hint to send it to all tasks, if most, a bound of its rows, allows it. No job counts them."""
    return F.broadcast(df) if most <= BROADCAST else df


def _hits(docs: DataFrame, items: DataFrame, sizes: list[int], n_hashes: int) -> DataFrame:
    """Where documents have shingles of items, n_hashes in all: row, size, p (position) and lengths (of the items)."""
    known = items.select("size", "length", F.explode("hashes").alias("h"))
    spread = []
    for size in sizes:
        own = known.where(F.col("size") == size).groupBy("h").agg(F.collect_set("length").alias("lengths"))
        runs = docs.where(F.size("words") >= size).select("row", F.lit(size).alias("size"), F.posexplode(_hashes("words", size)).alias("p", "h"))
        spread.append(runs.join(_sent(own, n_hashes), "h").select("row", "size", "p", "lengths"))
    return reduce(DataFrame.union, spread)


def _places(hits: DataFrame, similarity: float) -> DataFrame:
    """row, length, size and starts: windows of which a share of similarity of the shingles are hits of items of their length."""
    places = hits.select("row", "size", "p", F.explode("lengths").alias("length")).groupBy("row", "size", "length").agg(F.array_sort(F.collect_list("p")).alias("ps"))
    n = F.col("length") - F.col("size") + 1
    places = places.withColumn("least", F.greatest(F.ceil(n * similarity - 1e-9).cast("int"), F.lit(1))).where("size(ps) >= least")
    spans = F.expr("filter(transform(sequence(0, size(ps) - least), i -> named_struct('low', greatest(ps[i + least - 1] - (length - size), 0), 'high', ps[i])), x -> x.low <= x.high)")
    starts = F.array_distinct(F.flatten(F.transform(spans, lambda x: F.sequence(x["low"], x["high"]))))
    return places.select("row", "length", "size", starts.alias("starts")).where("size(starts) > 0")


def contaminated(docs: DataFrame, benchmark: DataFrame, shingle: int = 5, similarity: float = 0.8, radius: int = 23, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id, start (of the window, in words), n_words, distance and similarity of each document and item that match."""
    whole = benchmark.select(F.col(item_id).alias("item_id"), _words(item_text).alias("item_words")).where(F.size("item_words") > 0)
    whole = whole.withColumns({"item": F.monotonically_increasing_id(), "size": F.least(F.size("item_words"), F.lit(shingle))})
    items = common.cut(whole.select("item", "item_id", "size", _shingles("item_words", "size", shingle).alias("hashes"), F.size("item_words").alias("length")))
    n_items, n_hashes, sizes = items.agg(F.count("*"), F.sum(F.size("hashes")), F.sort_array(F.collect_set("size"))).first()
    if not n_items:
        kinds = {c: docs.schema[doc_id].dataType.simpleString() if c == "doc_id" else items.schema[c].dataType.simpleString() for c in ("doc_id", "item_id")}
        return docs.sparkSession.createDataFrame([], f"doc_id {kinds['doc_id']}, item_id {kinds['item_id']}, start int, n_words int, distance int, similarity double")
    texts = docs.select(F.struct(F.col(doc_id).alias("id"), F.xxhash64(text).alias("text")).alias("row"), F.col(text).alias("text"))

    # windows worth a fingerprint
    places = common.stored(_places(_hits(texts.select("row", _words("text").alias("words")), items, sizes, n_hashes), similarity), "decontamination-places")
    named = common.small(places.select(F.col("row").alias("at")).distinct(), KEYS)
    listed = texts.join(named, F.col("row").eqNullSafe(F.col("at")), "left_semi").select("row", _words("text").alias("words"))
    found = listed.join(places.withColumnRenamed("row", "at"), F.col("row").eqNullSafe(F.col("at")))
    cut = F.transform(F.filter("starts", lambda s: s + F.col("length") <= F.size("words")), lambda s: F.struct(s.alias("start"), F.array_join(F.slice("words", s + 1, F.col("length")), " ").alias("window")))
    windows = found.select(F.col("row.id").alias("rid"), "length", "size", F.inline(cut))
    windows = common.stored(windows.withColumn("content", F.unhex(F.md5("window"))), "decontamination-windows")

    # fingerprints of different windows and items meet in blocks
    different = windows.groupBy("content").agg(F.first("length").alias("length"), F.first("size").alias("size"), F.first("window").alias("window"))
    shingles = different.select("content", "length", "size", F.split("window", " ").alias("words")).select("content", "length", F.explode(_shingles("words", "size", shingle)).alias("h"))
    shingles = common.stored(shingles, "decontamination-shingles")
    item_shingles = items.select("item", F.explode("hashes").alias("h"))
    fps = _fingerprints(shingles, ["content", "length"])
    item_fps = _fingerprints(item_shingles, ["item"]).join(items.select("item", "length"), "item")
    changes = _changes(radius)
    left, right = _blocks(fps, [0], "content", "length"), _blocks(item_fps, changes, "item", "length").withColumnRenamed("fp", "item_fp")
    pairs = left.join(_sent(right, n_items * BLOCKS * len(changes)), ["length", "block", "value"]).select("content", "item", "length", F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))).alias("distance")).where(F.col("distance") <= radius).distinct()
    pairs = common.stored(pairs, "decontamination-pairs")

    # exact similarity of the candidates: the weights of their own windows and items only
    weights = shingles.join(common.small(pairs.select("content").distinct(), KEYS), "content", "left_semi").groupBy("content", "h").agg(F.count("*").alias("w"))
    item_weights = item_shingles.groupBy("item", "h").agg(F.count("*").alias("iw"))
    both = pairs.join(weights, "content").join(_sent(item_weights, n_hashes), ["item", "h"]).groupBy("content", "item", "length", "distance").agg(F.sum(F.least("w", "iw")).alias("both"))
    n = F.col("length") - F.col("size") + 1
    of_pair = both.join(items.select("item", "item_id", "size"), "item")
    alike = of_pair.withColumn("similarity", F.col("both") / (2 * n - F.col("both"))).where(F.col("similarity") >= similarity - 1e-9)
    alike = common.cut(alike.select("content", "item_id", "distance", "similarity"))
    matches = windows.select("rid", "length", "start", "content").join(alike, "content")
    best = F.min(F.struct((-F.col("similarity")).alias("order"), "start", "distance", "similarity", "length"))
    return matches.groupBy(F.col("rid").alias("doc_id"), "item_id").agg(best.alias("x")).select("doc_id", "item_id", "x.start", F.col("x.length").alias("n_words"), "x.distance", "x.similarity")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that hold a benchmark item go."""
    found = contaminated(docs, common.table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("found_id")).distinct()
    return docs.join(found, F.col("doc_id").eqNullSafe(F.col("found_id")), "left_anti")


QUERIES = {"op6_decontamination": op6_decontamination}
