"""Toxicity by weak supervision.

Voters are words of a lexicon (found by their association with the label in training rows),
patterns (beginnings of words, found alike) and a few fixed patterns of shouting, tables and
symbol noise. A generative model of the votes, fitted by expectation-maximisation without looking
at labels, estimates how often each voter speaks on either class; correlations that remain
between voters within a class lower the weight of voters that repeat each other. Its posterior
labels train a linear classifier over presence of words and beginnings, which scores every text.

Voters, model and classifier are fitted on at most max_labels labelled rows (chosen by a hash of
the id); every row is scored on its whole text. Neither labels, language, source nor id enter a
score. Null and empty texts get the classifier's score of a text without features; a text may
have any length. Null ids are scored like any other and never learnt from; of an id that is labelled
twice the higher label counts, and rows with equal ids are learnt from and scored each. A column score of
docs is replaced; other names do no harm. Without labelled rows of both classes every score is close
to the class that is known, or to zero.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WORD = re.compile(r"[^\W\d_]+")
#: Voters that correlate more than this within a class count as repeating each other.
REPEATS = 0.6
LETTERS = (4, 5, 6, 7)
#: Fixed patterns: name, expression, how many places make it speak.
PATTERNS = [("shouting", re.compile(r"!!(?=\s)"), 5), ("table", re.compile(r" \| "), 5), ("symbols", re.compile(r"(?:###|%%%|\$\$\$|&&&|\*\*\*)(?=\s)"), 5)]


def features(word: str) -> list[str]:
    """Names of a lower-case word and its beginnings."""
    return [f"={word}", *(f"{word[:n]}-" for n in LETTERS if len(word) > n)]


class Lookup(dict):
    """Word to the numbers of its known features; forgets all when full."""

    def __init__(self, names: list[str]):
        super().__init__()
        self.names = {x: i for i, x in enumerate(names)}

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > 500_000:
            self.clear()
        found = self[word] = tuple(self.names[x] for x in features(word.lower()) if x in self.names)
        return found

    def of(self, text: str) -> np.ndarray:
        """Which features a text has."""
        out = np.zeros(len(self.names), bool)
        out[list(set().union(*map(self.__getitem__, set(WORD.findall(text)))))] = True
        return out


def _count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        counts: dict[str, list[int]] = {}
        for text, toxic in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
            for x in {f for w in set(WORD.findall(text)) for f in features(w.lower())}:
                counts.setdefault(x, [0, 0])[toxic] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array([c[0] for c in counts.values()], pa.int64()), pa.array([c[1] for c in counts.values()], pa.int64())], ["feature", "clean", "toxic"])


def _votes(names: list[str], parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    lookup = Lookup(names)
    for part in parts:
        rows = [np.packbits(np.r_[lookup.of(t), [len(p.findall(t)) >= n for _, p, n in PATTERNS]]).tobytes() for t in part.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], ["votes"])


def label_model(votes: np.ndarray, share: float, rounds: int = 20) -> np.ndarray:
    """Posterior probability of the toxic class for rows of votes (1: the voter speaks, 0: it abstains).

    share: of toxic rows. A voter's accuracy is the mean posterior of the rows on which it speaks,
    by what the other voters say of them where any does; correlations between voters within a
    class divide their weight. Rows without a word's vote share what the class balance leaves. The
    last voters, the fixed patterns, start undecided.
    """
    x = votes.astype(np.float64)
    spoken = x[:, : -len(PATTERNS)].any(1)
    prior = np.log(share / (1 - share))
    posterior = np.where(spoken, 0.9, 0.0)
    accuracy, weight = np.full(x.shape[1], 0.9), np.ones(x.shape[1])
    accuracy[-len(PATTERNS) :] = share
    for i in range(rounds):
        silent = np.clip((share * len(x) - posterior[spoken].sum()) / max(1, (~spoken).sum()), 1e-3, share)
        evidence = weight * (np.log(accuracy / (1 - accuracy)) - prior)
        logit = np.where(spoken, prior, np.log(silent / (1 - silent))) + x @ evidence
        posterior = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        others = 1 / (1 + np.exp(-np.clip(logit[:, None] - evidence, -30, 30)))
        alone = x.sum(1) == 1
        others[alone] = np.where(x[alone] > 0, accuracy, others[alone])
        accuracy = np.clip((x * others).sum(0) / np.maximum(x.sum(0), 1), 0.01, 0.99)
        if i in (3, 10):  # what correlates beyond the class
            mass = np.stack([1 - posterior, posterior])
            rest = x - mass.T @ ((mass @ x) / np.maximum(mass.sum(1, keepdims=True), 1))
            scale = np.sqrt((rest**2).mean(0)) + 1e-9
            correlation = (rest / scale).T @ (rest / scale) / len(x)
            weight = 1 / np.maximum(np.where(correlation > REPEATS, correlation, 0).sum(0), 1)
    return posterior


def fit_linear(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, rounds: int = 500) -> np.ndarray:
    """Logistic regression on soft labels; the last weight is the intercept, which is not shrunk.

    Newton steps under the curvature's upper bound, which never overshoot.
    """
    x = np.c_[x.astype(np.float64), np.ones(len(x))]
    w = np.zeros(x.shape[1])
    w[-1] = np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))
    shrink = np.r_[np.full(len(w) - 1, ridge), 1e-6]
    inverse = np.linalg.inv(x.T @ x / 4 + np.diag(shrink))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= inverse @ (x.T @ (p - y) + shrink * w)
    return w


def fit(docs: DataFrame, labels: DataFrame, max_labels: int, voters: int, inputs: int, doc_id: str, text: str) -> tuple[list[str], np.ndarray]:
    """Names of the classifier's features, and its weights with the intercept."""
    known = labels.where(F.col(doc_id).isNotNull() & F.col("toxic").isin(0, 1)).groupBy(F.col(doc_id).alias("id")).agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(max_labels)
    rows = docs.select(F.col(doc_id).alias("id"), common.text_of(text).alias("text")).join(F.broadcast(chosen), "id").select("text", "toxic")
    rows = common.stored(rows, "toxicity-rows")
    totals = dict(rows.groupBy("toxic").count().collect())
    clean, toxic = totals.get(0, 0), totals.get(1, 0)
    if not (clean and toxic):
        return [], np.array([30.0 if toxic else -30.0])
    share = toxic / (clean + toxic)
    counts = rows.mapInArrow(_count, "feature string, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).where(f"clean + toxic >= {max(3, (clean + toxic) // 5000)}")
    # the likelihood ratio of presence on the two classes; unlike a z-score it stands words that one class never has
    n = clean + toxic
    a, b = F.col("toxic"), F.col("clean")
    cells = ((a, toxic), (b, clean), (toxic - a, toxic), (clean - b, clean))
    shares = (a + b, a + b, n - a - b, n - a - b)
    ratio = sum((F.when(x > 0, x * F.log(x * n / (m * s))).otherwise(0.0) for (x, m), s in zip(cells, shares, strict=True)), F.lit(0.0))
    odds = F.log((a + 0.5) / (toxic - a + 0.5)) - F.log((b + 0.5) / (clean - b + 0.5))
    table = counts.where("clean + toxic < " + str(n)).withColumns({"odds": odds, "ratio": ratio}).orderBy(F.desc("ratio"), "feature").limit(inputs).toPandas()
    names = table["feature"].tolist()
    packed = rows.mapInArrow(partial(_votes, names), "votes binary").toPandas()["votes"]
    bits = np.unpackbits(np.frombuffer(b"".join(packed), np.uint8).reshape(len(packed), -1), axis=1)[:, : len(names) + len(PATTERNS)]
    lexicon = [i for i in table.index if table["toxic"][i] > 9 * table["clean"][i] and table["ratio"][i] > 8][:voters]
    posterior = label_model(np.c_[bits[:, lexicon], bits[:, len(names) :]], share)
    return names, fit_linear(bits[:, : len(names)], posterior)


def toxicity(docs: DataFrame, labels: DataFrame, max_labels: int = 30_000, voters: int = 96, inputs: int = 300, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Adds score to docs. labels: id and toxic (0 or 1) of the rows to learn from."""
    names, weights = fit(docs, labels, max_labels, voters, inputs, doc_id, text)

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        lookup = Lookup(names)
        for texts in parts:
            logits = np.array([weights[:-1] @ lookup.of(t) + weights[-1] for t in texts], float)
            yield pd.Series(1 / (1 + np.exp(-np.clip(logits, -30, 30))))

    return docs.withColumn("score", score(common.text_of(text)))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    fold = common.fold_of("doc_id", 4)
    scored = toxicity(docs, common.table(spark, sf_dir, "labels").where(fold != 2))
    return scored.select("doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).cast("int").alias("predicted"))


QUERIES = {"op5_toxicity": op5_toxicity}
