"""Line deduplication by a suffix array over the documents' sequences of lines.

A line goes if it lies in a run of lines with at least min_words words of which an equal run stands
earlier, within its own or another document; the earlier one is any, not only the first. Lines without
words take no part. Only runs of lines that each occur more than once can repeat, so the suffix array
holds the places in such runs with enough words.

Ranks come by prefix doubling: the suffixes' first lines are ranked, then their first two by the
ranks of both, four, eight, and so on up to the least power of two that is min_words or more. Longer
prefixes change nothing: every line has a word, so that a line in a repeated run either begins min_words
words of it, or lies within min_words lines of a place that does. Each ranking is a sort by ranges, ties
included, so that no group of equal suffixes meets in one task; what a tie or a common prefix owes to
other ranges is carried over by one small row for each range.

Along the sorted suffixes, neighbours' common prefixes span intervals, each a repeated run. A pass
in either direction keeps the intervals that are open with the earliest place in each, and finds for
every suffix the deepest interval that has an earlier place: its longest earlier match.

Lines are compared with each run of white space as one space, trimmed; lines are told apart by 128-bit
hashes. Null texts stay null, empty ones empty; a text may have any length. Rows with equal ids count
as different documents, in the order in which they are read; null ids come first. A text whose lines
all go becomes empty. A column of docs named removed_lines is replaced; any other name does no harm.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import common

#: Documents with lines to delete that are sent to all tasks at most; more are joined by a shuffle.
KEYS = 200_000
#: Repeated lines whose hashes are sent to all tasks at most, some 50 MB; more are joined by a shuffle.
LINES = 1_000_000
#: Bits of a rank for the place in its range.
PLACE_BITS = 40


def _lines(docs: DataFrame) -> DataFrame:
    """docs: id, row, text. Lines with words: id, row, i (number among them), h1 and h2 (128 bits of the line), words."""
    schema = T.StructType([docs.schema["id"], *[T.StructField(c, t) for c, t in (("row", T.LongType()), ("i", T.IntegerType()), ("h1", T.LongType()), ("h2", T.LongType()), ("words", T.IntegerType()))]])

    def task(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for part in parts:
            hashes, words, sizes = [], [], []
            for text in part.column(2).to_pylist():
                split = [x for x in map(bytes.split, text.encode().split(b"\n")) if x]  # of bytes: ASCII white space only
                hashes += [digest(b" ".join(x)) for x in split]
                words += map(len, split)
                sizes.append(len(split))
            h = np.frombuffer(b"".join(hashes), np.int64).reshape(-1, 2)
            of = pa.array(np.repeat(np.arange(len(sizes)), sizes))
            upto = np.cumsum(sizes, dtype=np.int64)
            i = np.arange(len(words)) - np.repeat(upto - sizes, sizes)
            yield pa.RecordBatch.from_arrays([part.column(0).take(of), part.column(1).take(of), pa.array(i, pa.int32()), pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(words, pa.int32())], schema.names)

    return docs.select("id", "row", "text").mapInArrow(common.lean(task), schema)


def _candidates(lines: DataFrame, min_words: int) -> DataFrame:
    """Lines that occur more than once, in runs with enough words: with seg, which of its document's runs it is in."""
    repeated = common.stored(lines.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").select("h1", "h2"), "line-repeated")
    rows = lines.join(common.small(repeated, LINES), ["h1", "h2"], "left_semi")
    rows = rows.withColumn("seg", F.col("i") - F.row_number().over(Window.partitionBy("row").orderBy("i")))
    return rows.withColumn("_sum", F.sum("words").over(Window.partitionBy("row", "seg"))).where(F.col("_sum") >= min_words).drop("_sum")


def _by_range(rows: DataFrame, *keys: str) -> DataFrame:
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionByRange(n, *keys, "row", "i").sortWithinPartitions(*keys, "row", "i")


def _ranked(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Adds r: rises with (a, b), equal where both are; of ranges of the sorted rows and the places in them."""
    schema = T.StructType([*rows.schema.fields, T.StructField("part", T.LongType()), T.StructField("tie", T.LongType())])
    at = rows.columns.index(a), rows.columns.index(b)

    def task(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, last, start, before = TaskContext.get().partitionId(), None, 0, 0
        for part in parts:
            if part.num_rows:
                x, y = (part.column(k).to_numpy() for k in at)
                new = np.r_[(x[0], y[0]) != last, (x[1:] != x[:-1]) | (y[1:] != y[:-1])]
                first = np.where(new, before + np.arange(len(x)), start)
                tie = np.maximum.accumulate(first)
                last, start, before = (x[-1], y[-1]), int(tie[-1]), before + len(x)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.full(len(x), own)), pa.array(tie)], schema.names)

    found = common.stored(_by_range(rows, a, b).mapInArrow(common.lean(task), schema), "line-ranks")
    key = F.struct(a, b)
    ends = found.groupBy("part").agg(F.min_by(key, "tie").alias("low"), F.max_by(key, "tie").alias("high"), F.max("tie").alias("tie")).orderBy("part").collect()
    carried, last, rank = [], None, 0  # one row for each range whose first tie began in an earlier one
    for r in ends:
        if r["low"] == last:
            carried.append({"part": r["part"], "tied": rank})
        if not (r["low"] == last and r["tie"] == 0):
            rank = (r["part"] << PLACE_BITS) + r["tie"]
        last = r["high"]
    carry = common.frame(rows.sparkSession, carried, T.StructType([T.StructField("part", T.LongType()), T.StructField("tied", T.LongType())]))
    out = found.join(F.broadcast(carry), "part", "left")
    own = F.shiftleft("part", PLACE_BITS) + F.col("tie")
    return out.withColumn("r", F.when(F.col("tie") == 0, F.coalesce("tied", own)).otherwise(own)).select(*rows.columns, "r")


def suffix_ranks(rows: DataFrame, width: int) -> DataFrame:
    """rows: row, seg, i, h1, h2 and others. Adds line (a rank of the line) and r (of the width lines from there on, or as many as the run has)."""
    out = _ranked(rows, "h1", "h2").drop("h1", "h2").withColumn("line", F.col("r"))
    run = Window.partitionBy("row", "seg").orderBy("i")
    size = 1
    while size < width:
        pairs = out.withColumns({"a": F.col("r"), "b": F.coalesce(F.lead("r", size).over(run), F.lit(-1))}).drop("r")
        out = _ranked(pairs, "a", "b").drop("a", "b")
        size *= 2
    return out


def common_prefix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many first places rows of a and of b agree; negative numbers agree with nothing."""
    differ = (a != b) | (a < 0)
    return np.where(differ.any(1), differ.argmax(1), a.shape[1])


def earlier_matches(places: list, lcp: list[int], width: int) -> list[int]:
    """For each suffix in order, the depth of the deepest interval that an earlier place before it in the order opens.

    lcp: common prefix of each suffix with the one before it in the order.
    """
    out: list = []
    open_: list = []
    for place, depth in zip(places, lcp, strict=True):
        low = None
        while open_ and open_[-1][0] > depth:
            other = open_.pop()[1]
            low = other if low is None or other < low else low
        if low is not None and depth:
            if open_ and open_[-1][0] == depth:
                open_[-1][1] = min(open_[-1][1], low)
            else:
                open_.append([depth, low])
        out.append(next((d for d, least in reversed(open_) if least < place), 0))
        if open_ and open_[-1][0] == width:
            open_[-1][1] = min(open_[-1][1], place)
        else:
            open_.append([width, place])
    return out


def _least_by_depth(places: list, reach: np.ndarray, width: int) -> list:
    """For each depth from 1, the earliest of the places whose reach (which never rises) is so deep."""
    out: list = [None] * width
    low = None
    for j, place in enumerate(places):
        depth = int(reach[j])
        if not depth:
            break
        low = place if low is None or place < low else low
        if j + 1 == len(places) or reach[j + 1] < depth:
            for d in range(int(reach[j + 1]) if j + 1 < len(places) else 0, depth):
                out[d] = low
    return out


def _plain(place: tuple) -> tuple:
    """A place without the mark that puts null ids first."""
    return place[1:]


def _marked(place) -> tuple | None:
    return None if place is None else (place[0] is not None, *place)


def longest_earlier_matches(suffixes: DataFrame, width: int) -> DataFrame:
    """suffixes: id, row, i, r, lines (ranks of the lines from there on, width at most). Adds depth: lines of the longest match with an earlier place.

    Places are earlier by (id, row, i).
    """
    place_type = T.StructType([suffixes.schema["id"], T.StructField("row", T.LongType()), T.StructField("i", T.IntegerType())])
    own = [T.StructField(c, T.IntegerType()) for c in ("need", "depth", "left", "right")]
    kept = T.StructType([*place_type.fields, *own, T.StructField("part", T.LongType())])
    ends = [("low", T.ArrayType(place_type)), ("high", T.ArrayType(place_type)), ("first", T.ArrayType(T.LongType())), ("last", T.ArrayType(T.LongType())), ("through", T.IntegerType())]
    schema = T.StructType([*kept.fields, *[T.StructField(c, t) for c, t in ends]])

    def task(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow, part = to_arrow_schema(schema), TaskContext.get().partitionId()
        batches = [x for x in parts if x.num_rows]  # one range of the sorted suffixes
        if not batches:
            return
        lcps, last, first = [], None, None
        for x in batches:
            lists = x.column("lines")
            sizes = np.diff(lists.offsets.to_numpy())
            lines = np.full((len(sizes), width), -1)
            lines[np.arange(width) < sizes[:, None]] = lists.flatten().to_numpy()
            first = lines[0] if first is None else first
            lcps.append(common_prefix(np.vstack([lines[:1] if last is None else last[None], lines[:-1]]), lines))
            last = lines[-1]
        lcp = np.concatenate(lcps)
        lcp[0] = 0
        places = [(a is not None, a, b, c) for x in batches for a, b, c in zip(*(x.column(k).to_pylist() for k in ("id", "row", "i")), strict=True)]
        after = np.r_[lcp[1:], 0]
        ahead = earlier_matches(places, lcp.tolist(), width)
        back = earlier_matches(places[::-1], after[::-1].tolist(), width)[::-1]
        left = np.minimum.accumulate(np.r_[width, lcp[1:]])
        right = np.minimum.accumulate(np.r_[width, after[:-1][::-1]])[::-1]
        low, high = _least_by_depth(places, left, width), _least_by_depth(places[::-1], right[::-1], width)
        table = pa.Table.from_batches(batches)
        columns = [table["id"], table["row"], table["i"], table["need"], pa.array(np.maximum(ahead, back), pa.int32()), pa.array(left, pa.int32()), pa.array(right, pa.int32()), pa.array(np.full(len(lcp), part))]
        columns += [pa.nulls(len(lcp), arrow.field(c).type) for c, _ in ends]
        yield from pa.Table.from_arrays(columns, schema=arrow).to_batches(50_000)
        structs = [[None if p is None else dict(zip(("id", "row", "i"), _plain(p))) for p in x] for x in (low, high)]
        ids = [[x for x in v.tolist() if x >= 0] for v in (first, last)]
        yield pa.RecordBatch.from_pylist([{"part": part, "low": structs[0], "high": structs[1], "first": ids[0], "last": ids[1], "through": int(left[-1])}], schema=arrow)

    found = common.stored(_by_range(suffixes, "r").mapInArrow(common.lean(task), schema), "line-matches")
    ranges = found.where("through IS NOT NULL").select("part", *[c for c, _ in ends]).orderBy("part").collect()  # one row for each range
    padded = [[np.array([[*r[c], *[-1] * (width - len(r[c]))]]) for c in ("first", "last")] for r in ranges]
    meet = [int(common_prefix(a[1], b[0])[0]) for a, b in zip(padded, padded[1:])]  # between each range and the next
    lists = [[[_marked(p) for p in r[c]] for c in ("low", "high")] for r in ranges]
    carried = [[None, None] for _ in ranges]
    for side, order in ((0, range(1, len(ranges))), (1, range(len(ranges) - 2, -1, -1))):
        out: list = lists[0 if side == 0 else -1][1 - side] if ranges else []
        for t in order:
            depth = meet[t - 1] if side == 0 else meet[t]
            into = [p if d < depth else None for d, p in enumerate(out)]
            carried[t][side] = into
            through = ranges[t]["through"]
            out = [min(x for x in (p, q) if x is not None) if p is not None and d < through else q for d, (p, q) in enumerate(zip(into, lists[t][1 - side], strict=True))]
    plain = lambda c: None if c is None else [None if p is None else dict(zip(place_type.names, _plain(p))) for p in c]
    rows = [{"part": r["part"], "before": plain(a), "after": plain(b)} for r, (a, b) in zip(ranges, carried, strict=True)]
    carry_type = T.StructType([T.StructField("part", T.LongType()), T.StructField("before", T.ArrayType(place_type)), T.StructField("after", T.ArrayType(place_type))])
    out = found.where("through IS NULL").select(*kept.names).join(F.broadcast(common.frame(suffixes.sparkSession, rows, carry_type)), "part", "left")
    place = F.struct("id", "row", "i")

    def beyond(carry: str, reach: str) -> F.Column:
        """The deepest interval that reaches the range's end and has an earlier place beyond it."""
        deep = F.array_max(F.filter(F.sequence(F.lit(1), F.col(reach)), lambda d: F.get(carry, d - 1) < place))
        return F.coalesce(F.when(F.col(carry).isNotNull() & (F.col(reach) > 0), deep), F.lit(0))

    return out.select("id", "row", "i", "need", F.greatest("depth", beyond("before", "left"), beyond("after", "right")).alias("depth"))


def repeated_runs(docs: DataFrame, min_words: int) -> DataFrame:
    """docs: id, row (unique), text. For documents with lines to delete: row and runs, an array of i (the first line, among those with words) and depth (how many)."""
    lines = common.stored(_lines(docs.where("text IS NOT NULL")), "line-lines")
    width = 1 << (min_words - 1).bit_length()
    ranked = suffix_ranks(_candidates(lines, min_words), width)
    ahead = Window.partitionBy("row", "seg").orderBy("i").rowsBetween(0, width - 1)
    suffixes = ranked.select("id", "row", "i", "r", F.collect_list("line").over(ahead).alias("lines"), F.collect_list("words").over(ahead).alias("sizes"))
    # the least number of lines with enough words; places without that many can't begin a match
    sums = F.expr("aggregate(sizes, named_struct('n', 0, 'sum', 0), (a, x) -> IF(a.sum >= %d, a, named_struct('n', a.n + 1, 'sum', a.sum + x)))" % min_words)
    suffixes = suffixes.withColumn("sums", sums).where(F.col("sums.sum") >= min_words).select("id", "row", "i", "r", "lines", F.col("sums.n").alias("need"))
    matches = longest_earlier_matches(suffixes, width).where("depth >= need")
    return matches.groupBy("row").agg(F.collect_list(F.struct("i", "depth")).alias("runs"))


def _without(texts: pd.Series, runs: pd.Series) -> pd.DataFrame:
    """Texts without the lines of the runs, and these lines' numbers in the text; null without runs."""
    kept, removed = [], []
    for text, found in zip(texts, runs, strict=True):
        if text is None:
            kept.append(None), removed.append(None)
            continue
        lines = text.split("\n")
        numbers = [n for n, x in enumerate(lines) if x.encode().split()]
        gone = sorted({n for run in found for n in numbers[run["i"] : run["i"] + run["depth"]]})
        out = set(gone)
        kept.append("\n".join(x for n, x in enumerate(lines) if n not in out))
        removed.append(gone)
    common.release()
    return pd.DataFrame({"text": kept, "removed": removed})


def dedup_lines(docs: DataFrame, min_words: int = 25, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with later copies of repeated runs of lines deleted from the text; adds removed_lines (their numbers, from 0)."""
    columns = [c for c in docs.columns if c != "removed_lines"]
    held = docs.select(F.monotonically_increasing_id().alias("_at"), F.struct(*columns).alias("_row"))  # fixed once it is stored
    held = common.stored(held, "line-dedup")
    found = common.stored(repeated_runs(held.select(F.col(f"_row.{doc_id}").alias("id"), F.col("_at").alias("row"), F.col(f"_row.{text}").alias("text")), min_words), "line-runs")
    joined = held.join(common.small(found.select(F.col("row").alias("_id"), "runs"), KEYS), F.col("_at") == F.col("_id"), "left")
    # a filter on its result shall not run it a second time
    without = F.pandas_udf(_without, "struct<text: string, removed: array<int>>").asNondeterministic()
    joined = joined.select("_row", "runs", without(F.when(F.col("runs").isNotNull(), F.col(f"_row.{text}")), "runs").alias("_new"))
    values = [F.when(F.col("runs").isNull(), F.col(f"_row.{text}")).otherwise(F.col("_new.text")).alias(text) if c == text else F.col(f"_row.{c}").alias(c) for c in columns]
    return joined.select(*values, F.coalesce("_new.removed", F.array().cast("array<int>")).alias("removed_lines"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(common.table(spark, sf_dir, "documents")).select("doc_id", F.size("removed_lines").cast("long").alias("n_removed"), "removed_lines", "text")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: repeated passages go from the texts, and documents of which nothing is left. n_chars, where docs has it, follows the text."""
    found = dedup_lines(docs)
    left = found.where((F.size("removed_lines") == 0) | (F.trim(F.regexp_replace("text", common.SPACE, " ")) != ""))
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.when(F.size("removed_lines") == 0, F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return left.select(docs.columns)


QUERIES = {"op3_line_dedup": op3_line_dedup}
