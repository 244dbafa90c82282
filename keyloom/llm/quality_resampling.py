"""Quality selection by importance resampling.

Two generative models over hashed n-grams, one of the target texts (labelled of good quality) and
one of all raw texts, give each document the logarithm of its importance weight: the sum over its
n-grams of the difference in log probability. Adding Gumbel noise to it and keeping the k largest
sums draws k documents without replacement in proportion to their weights. The noise comes from a
hash of the id and a seed, so a repeated task draws alike.

The raw model counts every document. The target model may use a bounded number of labelled
documents (max_labels); which ones is decided by a hash of the id.

Null and empty texts have weight one (logarithm zero); a text may have any length. Null ids have noise
like any other. Rows with equal ids draw the same noise. Rows that tie at the k-th place all stay, so that
a few more than k may. Only the id and the text of docs are read, so that its other columns may have
any names; without labels all documents stay.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

TOKEN = re.compile(r"\w+|[^\w\s]+")


class _Hashes(dict):
    """Hashes of words; forgets all when full."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 500_000:
            self.clear()
        h = self[word] = zlib.crc32(word.encode())
        return h


_hashes = _Hashes()


def _forget() -> None:
    """Gives memory back at the end of a task: the worker may go on to another stage."""
    _hashes.clear()
    common.release()


def ngrams(text: str, buckets: int) -> np.ndarray:
    """Buckets of a text's words and pairs of adjacent words."""
    words = TOKEN.findall(text)
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    pairs = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
    return np.concatenate([h % np.uint64(buckets), (pairs >> np.uint64(32)) % np.uint64(buckets)]).astype(np.int64)


def models(docs: DataFrame, target: DataFrame, buckets: int, doc_id: str, text: str) -> np.ndarray:
    """Log probability ratios by bucket. target: ids, few enough to broadcast."""

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, buckets), np.int64)
        for part in parts:
            for t, good in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                found = np.bincount(ngrams(t, buckets), minlength=buckets)
                sums[0] += found
                if good:
                    sums[1] += found
        _forget()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(buckets)), pa.array(sums[0]), pa.array(sums[1])], ["bucket", "raw", "target"])

    flagged = docs.select(F.col(doc_id).alias("id"), common.text_of(text).alias("text")).join(F.broadcast(target.select(F.col(doc_id).alias("id"), F.lit(True).alias("good"))), "id", "left").select("text", F.coalesce("good", F.lit(False)).alias("good"))
    rows = flagged.mapInArrow(count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas().sort_values("bucket")
    if not len(rows):
        return np.zeros(buckets)
    logs = [np.log((x + 1) / (x.sum() + buckets)) for x in (rows["raw"].to_numpy(float), rows["target"].to_numpy(float))]
    return logs[1] - logs[0]


def kth_largest(df: DataFrame, key: str, k: int) -> float:
    """A value with at least k rows at or above it, as large as possible: by histograms, each within one bin of the last."""
    low, high, n = df.agg(F.min(key), F.max(key), F.count(key)).first()
    if n <= k or low == high:
        return low if n else -math.inf
    above = 0
    for _ in range(12):
        bins = 1000
        width = (high - low) / bins
        if not width or low + width == low:
            break
        within = df.where(F.col(key).between(low, high))
        counts = dict(within.groupBy(F.least(F.floor((F.col(key) - low) / width), F.lit(bins - 1)).cast("int").alias("bin")).count().collect())
        for b in range(bins - 1, -1, -1):
            if above + counts.get(b, 0) >= k:
                break
            above += counts.get(b, 0)
        edges = df.where(F.col(key).between(low, high) & (F.least(F.floor((F.col(key) - low) / width), F.lit(bins - 1)).cast("int") == b)).agg(F.min(key), F.max(key)).first()
        low, high = edges
        if low == high:
            break
        if counts[b] <= 10_000:
            return df.where(F.col(key).between(low, high)).orderBy(F.desc(key)).limit(k - above).agg(F.min(key)).first()[0]
    return low


def resample(docs: DataFrame, labels: DataFrame, buckets: int = 10_000, seed: int = 42, max_labels: int = 200_000, share: float | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The chosen documents' rows: id, log_weight and key (with noise).

    labels: id and quality, 1 for target documents. share: of documents to choose; by default the
    labelled documents' share of quality 1, and three standard errors more, lest good ones go.
    """
    known = labels.where(F.col(doc_id).isNotNull() & F.col("quality").isNotNull()).select(doc_id, "quality")
    target = known.where("quality = 1").select(doc_id).distinct().orderBy(F.xxhash64(doc_id)).limit(max_labels)
    if share is None:
        good, n = known.agg(F.avg("quality"), F.count("*")).first()
        share = 1.0 if not n else min(1.0, good + 3 * math.sqrt(max(good * (1 - good), 1 / n) / n))
    ratio = models(docs, target, buckets, doc_id, text)

    @F.pandas_udf("double")
    def log_weight(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series([float(ratio[ngrams(t, buckets)].sum()) for t in texts], dtype="float64")
        _forget()

    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(doc_id)), 11) + 0.5) / F.lit(2.0**53)
    scored = docs.select(F.col(doc_id).alias("doc_id"), log_weight(common.text_of(text)).alias("log_weight"), (-F.log(-F.log(uniform))).alias("noise"))
    scored = common.stored(scored.select("doc_id", "log_weight", (F.col("log_weight") + F.col("noise")).alias("key")), "resampled")
    n = scored.count()
    return scored.where(F.col("key") >= kth_largest(scored, "key", math.ceil(share * n))) if n else scored


def op9_quality_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the sample leaves out go."""
    chosen = resample(docs, common.table(spark, sf_dir, "labels")).select(F.col("doc_id").alias("chosen_id")).distinct()
    return docs.join(chosen, F.col("doc_id").eqNullSafe(F.col("chosen_id")), "left_semi")


QUERIES = {"op9_quality_resampling": op9_quality_resampling}
