"""Token counts by rank-synchronous array merging.

The distinct pre-tokens of a batch lie one after another in one array of symbols. In each round
every sequence finds the lowest rank among its adjacent pairs and merges all places of that pair,
all sequences at once; a sequence without a known pair is finished and counts its symbols. A
merge's result only takes part in pairs of higher rank, so that merging all places of a pair
together gives what one merge at a time gives.

Null and empty texts have no tokens. The vocabulary's own end string inside a text is one token,
as the library has it by default. Texts of any length are counted whole. Null ids and repeated rows
are counted each like any other. Columns n_bytes, n_tokens and over_limit of docs are replaced.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .pieces import END, PRETOKEN, Pieces, batches

NONE = np.iinfo(np.int64).max


def byte_letters() -> list[str]:
    """Printable stand-ins of bytes in byte-level vocabularies: Latin-1's printable bytes are themselves, the rest follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    odd = [b for b in range(256) if b not in plain]
    return [chr(b if b in plain else 256 + odd.index(b)) for b in range(256)]


class Merges:
    """A vocabulary's merges: keys of pairs in order, with the rank and the resulting symbol."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        pairs = [p if isinstance(p, list) else p.split(" ") for p in model["merges"]]
        left, right, made = (np.array([vocab[x] for x in xs], np.int64) for xs in (*zip(*pairs, strict=True), (a + b for a, b in pairs)))
        self.size = len(vocab)
        keys = left * self.size + right
        order = np.argsort(keys)
        self.keys, self.rank, self.made = keys[order], order.astype(np.int64), made[order]
        self.byte = np.array([vocab[x] for x in byte_letters()], np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NONE if not a known pair) and result of pairs."""
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        known = self.keys[at] == key
        return np.where(known, self.rank[at], NONE), self.made[at]

    def counts(self, tokens: list[bytes]) -> np.ndarray:
        """Symbols that are left of each byte string."""
        out = np.array([len(t) for t in tokens], np.int64)
        symbols = self.byte[np.frombuffer(b"".join(tokens), np.uint8)]
        who = np.repeat(np.arange(len(tokens)), out)
        rank, made = self._pairs(symbols, who)
        while len(symbols):
            starts = np.flatnonzero(np.r_[True, who[1:] != who[:-1]])
            lowest = np.minimum.reduceat(rank, starts)
            live = np.repeat(lowest < NONE, np.diff(np.r_[starts, len(who)]))
            if not live.all():
                symbols, who, rank, made = symbols[live], who[live], rank[live], made[live]
                continue
            hit = rank == np.repeat(lowest, np.diff(np.r_[starts, len(who)]))
            # in a run of overlapping places (aaa) every second one counts, from the left
            at = np.flatnonzero(hit)
            begin = np.r_[True, np.diff(at) != 1]
            offset = np.arange(len(at)) - np.maximum.accumulate(np.where(begin, np.arange(len(at)), 0))
            at = at[offset % 2 == 0]
            out -= np.bincount(who[at], minlength=len(out))
            symbols[at] = made[at]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            # only pairs beside a merged symbol are new
            stale = np.zeros(len(symbols), bool)
            stale[at] = True
            stale[at[at > 0] - 1] = True
            before = at - 2
            stale[before[(before >= 0)]] |= ~keep[at[before >= 0] - 1]
            symbols, who, rank, made, stale = symbols[keep], who[keep], rank[keep], made[keep], stale[keep]
            redo = np.flatnonzero(stale)
            nxt = np.minimum(redo + 1, len(symbols) - 1)
            rank[redo], made[redo] = self.find(symbols[redo], symbols[nxt])
            rank[redo[(nxt == redo) | (who[nxt] != who[redo])]] = NONE
        return out

    def _pairs(self, symbols: np.ndarray, who: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rank, made = np.full(len(symbols), NONE), np.zeros(len(symbols), np.int64)
        if len(symbols) > 1:
            rank[:-1], made[:-1] = self.find(symbols[:-1], symbols[1:])
            rank[:-1][who[1:] != who[:-1]] = NONE
        return rank, made


class Counter:
    """Counts of whole texts; keeps counts of pieces and of pre-tokens in bounded caches."""

    def __init__(self, path: str, bound: int = 400_000):
        self.merges, self.bound = Merges(path), bound
        self.known: dict[str, int] = {}
        self.pieces = Pieces(self._learn, lambda new: self._learn([" " + x for x in new]), bound)

    def _learn(self, new: list[str]) -> list[int]:
        split = [[x] if x.removeprefix(" ").isalpha() else PRETOKEN.findall(x) for x in new]
        if len(self.known) > self.bound:
            self.known.clear()
        fresh = list(set().union(*split).difference(self.known)) if split else []
        for i in range(0, len(fresh), 20_000):
            part = fresh[i : i + 20_000]
            self.known.update(zip(part, self.merges.counts([x.encode() for x in part]).tolist(), strict=True))
        return [sum(map(self.known.__getitem__, x)) for x in split]

    def count(self, texts: list[str]) -> list[int]:
        return [sum(x) for x in self.pieces.look_up(texts)]


@cache
def _counter(path: str) -> Counter:
    """One for each Python worker."""
    return Counter(path)


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 512, text: str = "text") -> DataFrame:
    """Adds n_bytes, n_tokens and over_limit (n_tokens above limit) to docs.

    vocabulary: path of a byte-level BPE file that every worker has.
    """

    @F.pandas_udf("long")
    def n_tokens(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = _counter(vocabulary)
        for series in parts:
            out = np.zeros(len(series), np.int64)
            texts = series.tolist()
            for a, b in batches(texts):
                split = [t.split(END) for t in texts[a:b]]
                got = iter(counter.count([x for s in split for x in s]))
                for i, s in enumerate(split, a):
                    out[i] = len(s) - 1 + sum(next(got) for _ in s)
            yield pd.Series(out)
        counter.known.clear()
        counter.pieces.forget()
        common.release()

    whole = common.text_of(text)
    return docs.withColumns({"n_bytes": F.octet_length(whole).cast("long"), "n_tokens": n_tokens(whole)}).withColumn("over_limit", F.col("n_tokens") > limit)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts(docs, public_tokenizers.path("byte_bpe_50k.json")).select("doc_id", "n_bytes", "n_tokens", "over_limit")


QUERIES = {"op4_token_counts": op4_token_counts}
