"""Exact deduplication over counting quotient filters.

Each task turns the 64-bit fingerprints of its partition into counting quotient filters, one for
each block of quotients: the occupied quotients, how long each one's run is, the runs' sorted
remainders, and a counter for each remainder. Quotient and remainder together are the fingerprint,
so filters of the same block merge without loss, by their sorted remainders. Fingerprints whose
merged count is above one route their documents to byte verification, which groups by the
normalised text itself; equal fingerprints of different texts part there.

Only documents whose fingerprint repeats are read again and shuffled, as long as the repeated
fingerprints are few enough to be sent to all tasks; beyond, a shuffle finds them.

Null and empty texts count as the empty text; a text may have any length. Only the id and the text of
docs are read, so that its other columns may have any names. Every run of white space (space, tab to carriage
return) counts as one space. Of rows with equal texts, the one with the smallest id stays; should
several rows carry that id, all of them do. A null id is larger than any other: such a row stays
only where its text has no row with an id.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Repeated fingerprints that are sent to all tasks at most, some 100 MB; of groups, which are larger, a tenth.
KEYS = 2_000_000
REMAINDER_BITS = 40
REMAINDER = np.uint64((1 << REMAINDER_BITS) - 1)


class QuotientFilter:
    """Fingerprints with counts, in order: their quotients, run lengths, remainders and counters."""

    def __init__(self, quotients: np.ndarray, runs: np.ndarray, remainders: np.ndarray, counters: np.ndarray):
        self.quotients, self.runs, self.remainders, self.counters = quotients, runs, remainders, counters

    @classmethod
    def of(cls, fingerprints: np.ndarray, counters: np.ndarray | None = None) -> QuotientFilter:
        """From unsigned 64-bit fingerprints in any order, repeated or not."""
        counters = np.ones(len(fingerprints), np.int64) if counters is None else counters
        order = np.argsort(fingerprints, kind="stable")
        f = fingerprints[order]
        starts = np.flatnonzero(np.r_[True, f[1:] != f[:-1]]) if len(f) else np.zeros(0, np.int64)
        f, counters = f[starts], np.add.reduceat(counters[order], starts) if len(starts) else counters
        quotients, runs = np.unique(f >> np.uint64(REMAINDER_BITS), return_counts=True)
        return cls(quotients.astype(np.uint32), runs.astype(np.uint32), f & REMAINDER, counters)

    @property
    def fingerprints(self) -> np.ndarray:
        return np.repeat(self.quotients.astype(np.uint64) << np.uint64(REMAINDER_BITS), self.runs) | self.remainders

    @classmethod
    def merged(cls, filters: list[QuotientFilter]) -> QuotientFilter:
        return cls.of(np.concatenate([f.fingerprints for f in filters]), np.concatenate([f.counters for f in filters]))

    def to_bytes(self) -> bytes:
        """Remainders take their five bytes only."""
        low = self.remainders.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : REMAINDER_BITS // 8]
        return struct.pack("<II", len(self.quotients), len(self.remainders)) + self.quotients.astype("<u4").tobytes() + self.runs.astype("<u4").tobytes() + low.tobytes() + self.counters.astype("<i8").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> QuotientFilter:
        q, n = struct.unpack_from("<II", data)
        width, at = REMAINDER_BITS // 8, 8 + 8 * q
        low = np.zeros((n, 8), np.uint8)
        low[:, :width] = np.frombuffer(data, np.uint8, n * width, at).reshape(n, width)
        return cls(np.frombuffer(data, "<u4", q, 8), np.frombuffer(data, "<u4", q, 8 + 4 * q), low.view("<u8").ravel().astype(np.uint64), np.frombuffer(data, "<i8", n, at + n * width))


def repeated_fingerprints(fingerprints: DataFrame, column: str = "fp") -> DataFrame:
    """The fingerprints (64-bit, spread evenly) that occur more than once, with their count."""
    spark = fingerprints.sparkSession
    blocks_log2 = min(24, max(1, (4 * int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length()))
    block_shift = np.uint64(64 - blocks_log2)

    def build(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def filters(found: np.ndarray, counters: np.ndarray) -> pa.RecordBatch:
            blocks = (found >> block_shift).astype(np.int64)
            edges = np.r_[np.flatnonzero(np.r_[True, blocks[1:] != blocks[:-1]]), len(blocks)]
            return pa.RecordBatch.from_arrays([pa.array(blocks[edges[:-1]]), pa.array([QuotientFilter.of(found[a:b], counters[a:b]).to_bytes() for a, b in zip(edges[:-1], edges[1:])], pa.binary())], ["block", "filter"])

        held: list[np.ndarray] = []
        for part in parts:
            held.append(part.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
            if sum(map(len, held)) >= 4_000_000:
                yield filters(*np.unique(np.concatenate(held), return_counts=True))
                held.clear()
        if sum(map(len, held)):
            yield filters(*np.unique(np.concatenate(held), return_counts=True))

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        whole = QuotientFilter.merged([QuotientFilter.from_bytes(x) for x in group["filter"]])
        more = whole.counters > 1
        return pd.DataFrame({column: whole.fingerprints[more].view(np.int64), "n": whole.counters[more]})

    return fingerprints.select(F.col(column).cast("long")).mapInArrow(build, "block long, filter binary").groupBy("block").applyInPandas(merge, f"{column} long, n long")


def exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    whole = docs.select(F.col(doc_id).alias("doc_id"), F.regexp_replace(common.text_of(text), common.SPACE, " ").alias("whole"))
    whole = whole.withColumn("fp", F.xxhash64("whole"))
    slim = common.stored(whole.select("doc_id", "fp", F.sha2("whole", 256).alias("text_sha256")), "exact-dedup")
    repeated = common.cut(repeated_fingerprints(slim.select("fp")))
    copies = whole.join(common.small(repeated.select("fp"), KEYS), "fp", "left_semi")
    groups = copies.groupBy("whole").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")).where("group_size > 1")
    groups = common.cut(groups.select(F.sha2("whole", 256).alias("text_sha256"), "keep_id", "group_size"))
    found = slim.join(common.small(groups, KEYS // 10), "text_sha256", "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return found.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(common.table(spark, sf_dir, "documents"))


QUERIES = {"op2_exact_dedup": op2_exact_dedup}
ORACLE_SQL = {
    "op2_exact_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
        FROM d WINDOW w AS (PARTITION BY t)
    """
}
