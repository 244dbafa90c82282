"""Packing of token sequences: best-fit decreasing with a segment tree.

A document's ids are first cut into full windows; each fills a sequence of its own. What is left
of each document is dealt out in order of decreasing length, each piece into the tightest open
sequence that holds it: a segment tree over the remaining capacities finds it in a logarithm of
the window's length. Each task packs all documents of its own partition together, so nothing is
shuffled and no task sees more than its input, of which it holds five numbers for each piece; a
sequence's id names the partition and its place there, and a repeated task gives the same ids.

Null and empty texts hold only the closing id; a text may have any length. A document that fills its
windows exactly leaves no piece. Null ids are kept as they are; repeated rows are packed as often as
they stand there. Pieces of equal length are dealt out in the order in which they are read. Only the
id and the text of docs are read, so that its other columns may have any names.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .pieces import END, PATTERN, Pieces, batches

#: Pieces that each worker holds against the library at most.
CHECKED = 5_000
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Capacities:
    """Open sequences by remaining capacity, under a segment tree of how many there are."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.tree = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def _add(self, capacity: int, by: int) -> None:
        node = capacity + self.leaves
        while node:
            self.tree[node] += by
            node >>= 1

    def put(self, capacity: int, sequence: int) -> None:
        self.open[capacity].append(sequence)
        self._add(capacity, 1)

    def take(self, length: int) -> tuple[int, int] | None:
        """The open sequence of the least capacity that is length or more: (capacity, sequence)."""
        node = length + self.leaves
        if not self.tree[node]:
            while node > 1 and (node & 1 or not self.tree[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.tree[2 * node] else 2 * node + 1
        capacity = node - self.leaves
        self._add(capacity, -1)
        return capacity, self.open[capacity].pop()


def best_fit_decreasing(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(sequence, offset) of each piece, and how many sequences there are."""
    sequence, offset, made, capacities = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0, Capacities(window)
    for i in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[i])
        capacity, at = capacities.take(length) or (window, made)
        made += at == made
        sequence[i], offset[i] = at, window - capacity
        if capacity > length:
            capacities.put(capacity - length, at)
    return sequence, offset, made


class Encoder:
    """Whole texts to little-endian unsigned 32-bit ids, as bytes: those of the tokenizers library for a byte-level BPE file.

    New pieces are merged by tiktoken, which takes a fifth of the time, over the file's own vocabulary; the
    first pieces of every worker are held against the library itself, and any difference is an error.
    """

    def __init__(self, vocabulary: str):
        import tiktoken
        from tokenizers import Tokenizer

        from .token_counts import byte_letters

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.end = np.uint32(self.tokenizer.token_to_id(END)).tobytes()
        byte = {c: b for b, c in enumerate(byte_letters())}
        ranks = {bytes(map(byte.__getitem__, x)): i for x, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if x != END}
        # single white-space characters need no look-ahead, which makes the pattern much faster
        single = PATTERN.split("|[")[0] + r"|\s"
        self.encode, self.encode_single = (tiktoken.Encoding("pieces", pat_str=x, mergeable_ranks=ranks, special_tokens={}).encode_ordinary for x in (PATTERN, single))
        self.sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        self.sizes[list(ranks.values())] = [len(x) for x in ranks]
        self.unchecked = CHECKED
        self.pieces = Pieces(self._learn, self._learn_spaced, 200_000)

    def _check(self, texts: list[str], ids: list[bytes]) -> None:
        n = min(self.unchecked, len(texts))
        self.unchecked -= n
        for text, own, of in zip(texts, ids, self.tokenizer.encode_batch_fast(texts[:n], add_special_tokens=False)):
            if np.frombuffer(own, np.uint32).tolist() != of.ids:
                raise ValueError(f"{text!r} has other ids in the tokenizers library")

    def _learn(self, new: list[str]) -> list[bytes]:
        out = [np.array(self.encode(x), np.uint32).tobytes() for x in new]
        self._check(new, out)
        return out

    def _learn_spaced(self, new: list[str]) -> list[bytes]:
        """Encodes all at once; a token never spans two of them, so that lengths in bytes find each one's ids."""
        joined = "".join([" " + x for x in new])
        ids = np.array(self.encode_single(joined), np.uint32)
        stops = 4 + 4 * np.searchsorted(np.cumsum(self.sizes[ids]), np.cumsum([len(x) + 1 for x in joined.encode().split(b" ")[1:]], dtype=np.int64))
        whole, stops = ids.tobytes(), stops.tolist()
        out = [whole[a:b] for a, b in zip([0, *stops], stops)]
        self._check([" " + x for x in new[: self.unchecked]], out)
        return out

    def ids(self, texts: list[str]) -> list[bytes]:
        split = [t.split(END) for t in texts]
        got = iter(self.pieces.look_up([x for s in split for x in s]))
        return [self.end.join(b"".join(next(got)) for _ in s) for s in split]


@cache
def _encoder(vocabulary: str) -> Encoder:
    """One for each Python worker."""
    return Encoder(vocabulary)


def pack(docs: DataFrame, vocabulary: str, window: int = 2048, close: int = 1, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of all documents with their sequence and the place there.

    vocabulary: path of a byte-level BPE file that every worker has; close: id that ends each document.
    """

    def task(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, context = _encoder(vocabulary), TaskContext.get()
        base, closing = (context.partitionId() if context else 0) << 36, np.uint32(close).tobytes()
        ids: list[pa.Array] = []
        rows = array("q")  # number of the document, start, length, ids_crc32, doc_tokens
        number = 0
        for part in parts:
            ids.append(part.column(0))
            texts = part.column(1).to_pylist()
            for a, b in batches(texts):
                for got in encoder.ids(texts[a:b]):
                    got = memoryview(got + closing)
                    n = len(got) // 4
                    for s in range(0, n, window):
                        rows.extend((number, s, min(window, n - s), zlib.crc32(got[4 * s : 4 * (s + window)]), n))
                    number += 1
        encoder.pieces.forget()
        if number:
            of, *columns = np.frombuffer(rows, np.int64).reshape(-1, 5).T
            sequence, offset, _ = best_fit_decreasing(columns[1], window)
            whole = pa.chunked_array(ids).take(pa.array(of))
            yield from pa.Table.from_arrays([whole, *map(pa.array, columns), pa.array(base + sequence), pa.array(offset)], [c.split()[0] for c in SCHEMA.split(", ")]).to_batches(50_000)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), common.text_of(text).alias("text")).mapInArrow(common.lean(task), SCHEMA)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the pieces of the documents that are left."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {"op7_packing": op7_packing}
