"""Language-model scores from causal self-attention over subword ids.

The corpus is first rewritten as bundles: some thousand documents with their distinct words in
order of their hashes, each document as numbers of words, and each distinct word's subword ids.
Arrays are stored squeezed. Word counts of the training
documents travel between bundles by hash: each bundle deals its words into ranges of hashes, each
range sums what all bundles have of it and sends every bundle the sums of its own words, so that
neither texts nor the vocabulary pass through one place. Counts of pairs of adjacent ids travel the
same way. Every subword id is read and predicted by attention, inside words too; within its class it follows
counts of pairs. The attention model starts from a bounded
number of windows, is trained on by every partition on all its training windows,
and the partitions' weights are averaged by their number of windows.

Where score is asked for words only, which is quicker and sees less, attention goes over words: a word's first subword id is predicted from
the words before it, each read by the id that ends it. Whether the word then goes on, and with which id, follows from how often that came after
its last two ids in the corpus, smoothed by pairs; this is one number for each distinct word of a bundle. All ids that can come have probability one
together: ids that begin with a space begin a word, others go on with one.

Null and empty texts have the closing token only. A null id counts as a training row. Rows with
equal ids are scored each. Words are told apart by 64-bit hashes when counts are summed.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import attention, common
from .pieces import PATTERN, batches

BUNDLE = 8_000_000
VOCABULARY = 50_257  # ids of the rank file, and the end
#: Windows to a step of training, and partitions whose weights one task adds up.
BATCH, FAN = 1024, 64
#: Marks keys of what follows two ids inside a word: the id before (or NONE), the id, and what follows (or STOP, where the word ends), of 16 bits each.
INSIDE, NONE, STOP = 1 << 50, 65_535, 65_534


@cache
def _encoder(ranks: str):
    """encode, and each id's length in bytes; one for each Python worker."""
    import tiktoken

    with open(ranks, "rb") as f:
        by_bytes = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    sizes = np.zeros(max(by_bytes.values()) + 1, np.int64)
    sizes[list(by_bytes.values())] = [len(x) for x in by_bytes]
    # the text is joined by single spaces, and any cut at white space does for a word's ids
    single = PATTERN.split("|[")[0] + r"|\s"
    return tiktoken.Encoding("words", pat_str=single, mergeable_ranks=by_bytes, special_tokens={}).encode_ordinary, sizes


def subwords(words: list[str], ranks: str) -> tuple[np.ndarray, np.ndarray]:
    """Subword ids of words with a space before each, one after another, and how many each has."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    encode, sizes = _encoder(ranks)
    ids = np.array(encode(" " + " ".join(words)), np.int64)
    stops = np.searchsorted(np.cumsum(sizes[ids]), np.cumsum([len(w.encode()) + 1 for w in words])) + 1
    return ids, np.diff(np.r_[0, stops])


def begins(ranks: str) -> np.ndarray:
    """Which ids begin a word or end a text."""
    out = np.zeros(VOCABULARY, bool)
    with open(ranks, "rb") as f:
        for a, b in map(bytes.split, f):
            out[int(b)] = base64.b64decode(a)[:1] == b" "
    out[-1] = True
    return out


def _squeeze(a: np.ndarray) -> bytes:
    """An array's bytes, first all low ones, compressed."""
    return zstandard.compress(a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes(), 1)


def _whole(data: bytes, kind: type) -> np.ndarray:
    """The array that _squeeze took."""
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(data), np.uint8).reshape(size, -1).T).view(kind).ravel()


class _Numbers(dict):
    def __missing__(self, word):
        n = self[word] = len(self)
        return n


def bundles(docs: DataFrame, ranks: str) -> DataFrame:
    """docs: doc_id long, held_out boolean, text. One row per bundle."""
    schema = "bundle long, ids array<long>, held array<boolean>, lengths array<int>, numbers binary, hashes binary, counts binary, pieces binary, sizes binary"

    def task(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        bundle = (context.partitionId() if context else 0) << 32
        for part in parts:
            ids, held, texts = (c.to_pylist() for c in part.columns)
            for a, b in batches(texts, BUNDLE):
                known, numbers, lengths = _Numbers(), [], []
                for t in texts[a:b]:
                    words = t.encode().lower().split()  # of bytes: ASCII letters and white space only
                    numbers.append(np.fromiter(map(known.__getitem__, words), np.uint32, len(words)))
                    lengths.append(len(words))
                training = [n for n, h in zip(numbers, held[a:b], strict=True) if not h]
                counts = np.bincount(np.concatenate(training), minlength=len(known)) if training else np.zeros(len(known))
                words, hashes = list(known), np.array([xxhash.xxh3_64_intdigest(w) for w in known], np.uint64)
                order = np.argsort(hashes)
                place = np.empty(len(order), np.uint32)
                place[order] = np.arange(len(order), dtype=np.uint32)
                pieces, sizes = subwords([words[i].decode() for i in order.tolist()], ranks)
                arrays = (place[np.concatenate(numbers)], counts[order].astype(np.uint32), pieces.astype(np.uint16), sizes.astype(np.uint32))
                whole, counted, pieces, sizes = map(_squeeze, arrays)
                row = [[bundle], [ids[a:b]], [held[a:b]], [lengths], [whole], [hashes[order].tobytes()], [counted], [pieces], [sizes]]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), *[pa.binary()] * 5), strict=True)], [c.split()[0] for c in schema.split(", ")])
                bundle += 1

    return docs.select("doc_id", "held_out", "text").mapInArrow(task, schema)


def word_counts(corpus: DataFrame) -> DataFrame:
    """bundle, bucket (a range of hashes), sums (of the bundle's words in that bucket, in order), n_new (distinct words with a count, where bundle is null)."""
    buckets = _buckets(corpus.sparkSession)

    def deal(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for bundle, hashes, counts in zip(*(c.to_pylist() for c in part.columns), strict=True):
                h, n = np.frombuffer(hashes, np.uint64), _whole(counts, np.uint32)
                bucket = ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)  # rises with the hash
                starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, np.int64)
                spans = list(zip(starts.tolist(), [*starts[1:].tolist(), len(h)]))
                yield pa.RecordBatch.from_arrays([pa.array(bucket[starts]), pa.array([bundle] * len(spans), pa.int64()), pa.array([h[i:j].tobytes() for i, j in spans], pa.binary()), pa.array([_squeeze(n[i:j]) for i, j in spans], pa.binary())], ["bucket", "bundle", "hashes", "counts"])

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        h = np.frombuffer(b"".join(group["hashes"]), np.uint64)
        words, where = np.unique(h, return_inverse=True)
        sums = np.bincount(where, weights=np.concatenate([_whole(x, np.uint32) for x in group["counts"]]), minlength=len(words)).astype(np.int64)
        mine = np.split(sums[where], np.cumsum([len(x) // 8 for x in group["hashes"]])[:-1])
        rows = pd.DataFrame({"bundle": group["bundle"], "bucket": group["bucket"], "sums": [_squeeze(x) for x in mine], "n_new": 0})
        return pd.concat([rows.astype({"bundle": "Int64"}), pd.DataFrame({"bundle": pd.array([None], "Int64"), "bucket": group["bucket"].iloc[:1].tolist(), "sums": [b""], "n_new": [int((sums > 0).sum())]})])

    dealt = corpus.select("bundle", "hashes", "counts").mapInArrow(deal, "bucket int, bundle long, hashes binary, counts binary")
    return dealt.groupBy("bucket").applyInPandas(merge, "bundle long, bucket int, sums binary, n_new long")


def _ids(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A bundle's word numbers with each text's end (the number after the last word), where texts end, and the subwords by word."""
    numbers, lengths = _whole(row["numbers"], np.uint32).astype(np.int64), np.array(row["lengths"], np.int64)
    sizes = np.r_[_whole(row["sizes"], np.uint32).astype(np.int64), 1]
    whole = np.insert(numbers, np.cumsum(lengths), len(sizes) - 1)
    return whole, np.cumsum(lengths + 1), sizes


def _pieces(row: dict, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Subword ids of a bundle's distinct words and of the end, and where each word's begin."""
    return np.r_[_whole(row["pieces"], np.uint16).astype(np.int64), VOCABULARY - 1], np.cumsum(sizes) - sizes


def _expanded(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which piece each place of a bundle's texts has, where texts end, and where words begin."""
    whole, ends, sizes = _ids(row)
    first, n = np.cumsum(sizes) - sizes, sizes[whole]
    upto = np.cumsum(n)
    return np.repeat(first[whole] - (upto - n), n) + np.arange(upto[-1] if len(upto) else 0), upto[ends - 1], upto - n


def _tokens(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """A bundle's subword ids, an end after each text, and where texts end."""
    at, ends, _ = _expanded(row)
    return _pieces(row, _ids(row)[2])[0][at], ends


def _subwords(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A bundle's subword ids, an end after each text, and the id before each; where texts end."""
    ids, ends = _tokens(row)
    return ids, attention.before(ids, ends, VOCABULARY - 1), ends


def _words(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each word of a bundle, and of the ends, its first subword id and the id before it; where texts end."""
    whole, ends, sizes = _ids(row)
    pieces, first = _pieces(row, sizes)
    return pieces[first][whole], attention.before(pieces[first + sizes - 1][whole], ends, VOCABULARY - 1), ends


def _training_windows(row: dict, classes: attention.Classes, every: int, places: Callable = _words) -> tuple[np.ndarray, np.ndarray]:
    """Input and output classes of one in every windows of a bundle's training texts. places: _words or _subwords."""
    ids, last, ends = places(row)
    c = attention.in_windows(classes.into.astype(np.int16)[last], ends, classes.inputs)
    y = attention.in_windows(classes.out.astype(np.int16)[ids], ends, -1)[:, attention.STRIDE :]
    held = np.repeat(np.array(row["held"], bool), -(-np.diff(np.r_[0, ends]) // attention.STRIDE))
    chosen = np.flatnonzero(~held & (np.arange(len(c)) % every == row["bundle"] % every))
    return c[chosen], y[chosen]


def _rows(part: pa.RecordBatch) -> Iterator[dict]:
    for i in range(part.num_rows):
        yield {k: v[0] for k, v in part.slice(i, 1).to_pydict().items()}


def subword_counts(corpus: DataFrame) -> np.ndarray:
    """Counts of all ids in the training texts, and of their ends."""

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(VOCABULARY, np.int64)
        for part in parts:
            for row in _rows(part):
                n = np.repeat(_whole(row["counts"], np.uint32), _whole(row["sizes"], np.uint32))
                sums[:-1] += np.bincount(_whole(row["pieces"], np.uint16), weights=n, minlength=VOCABULARY - 1).astype(np.int64)
                sums[-1] += len(row["held"]) - sum(row["held"])
        found = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(sums[found])], ["id", "n"])

    found = corpus.select("counts", "sizes", "pieces", "held").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(VOCABULARY, np.int64)
    counts[found["id"].to_numpy(np.int64)] = found["n"]
    return counts


class _Keys:
    """A bundle's keys in order: pairs of adjacent ids (first the id before, times VOCABULARY), then, if asked for, what follows ids inside words.

    n_pairs: how many are pairs; of_words: the pair of each word of its texts with the id before; rest: pieces of its distinct words that go on with one, of_rest: their pairs; of_pieces: the key of what follows each piece; pair_of: of each key after the pairs its pair, or -1 where the word stops.
    """

    def __init__(self, row: dict, inside: bool = True):
        whole, ends, sizes = _ids(row)
        self.pieces, self.first = _pieces(row, sizes)
        stops = self.first + sizes - 1
        last = attention.before(self.pieces[stops][whole], ends, VOCABULARY - 1)
        between, of_words = _distinct(last, self.pieces[self.first][whole])
        self.rest = np.flatnonzero(np.bincount(self.first, minlength=len(self.pieces)) == 0)
        self.keys, where = np.unique(np.r_[between, self.pieces[self.rest - 1] * VOCABULARY + self.pieces[self.rest]], return_inverse=True)
        self.n_pairs, self.of_words, self.of_rest = len(self.keys), where[: len(between)][of_words], where[len(between) :]
        self.whole, self.ends, self.sizes, self.of_pieces, self.pair_of = whole, ends, sizes, np.zeros(0, np.int64), np.zeros(0, np.int64)
        if inside:
            back, ahead = np.r_[NONE, self.pieces[:-1]], np.r_[self.pieces[1:], STOP]
            back[self.first], ahead[stops] = NONE, STOP
            found, of_pieces = np.unique((INSIDE | back << 32 | self.pieces << 16 | ahead)[:-1], return_inverse=True)  # nothing follows the end
            self.keys, self.of_pieces, self.pair_of = np.r_[self.keys, found], of_pieces + self.n_pairs, np.full(len(found), -1)
            self.pair_of[of_pieces[self.rest - 1]] = self.of_rest

    def counts(self, held: np.ndarray) -> np.ndarray:
        """How often each key comes in texts that are not held out."""
        learnt = np.repeat(~held, np.diff(np.r_[0, self.ends]))
        words = np.bincount(self.whole, weights=learnt, minlength=len(self.sizes))
        of_pieces = np.repeat(words, self.sizes)
        n = np.bincount(self.of_words, weights=learnt, minlength=len(self.keys))
        n += np.bincount(self.of_rest, weights=of_pieces[self.rest], minlength=len(self.keys))
        if len(self.of_pieces):
            n += np.bincount(self.of_pieces, weights=of_pieces[:-1], minlength=len(self.keys))
        return n.astype(np.int64)


def _distinct(before: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs in order, and which of them each place has; sorted digit by digit."""
    order = np.argsort(ids.astype(np.uint16), kind="stable")
    order = order[np.argsort(before[order].astype(np.uint16), kind="stable")]
    pairs = before[order] * VOCABULARY + ids[order]
    new = np.r_[True, pairs[1:] != pairs[:-1]][: len(pairs)]
    where = np.empty(len(pairs), np.int64)
    where[order] = np.cumsum(new) - 1
    return pairs[new], where


def _group(keys: np.ndarray, classes: attention.Classes) -> np.ndarray:
    """What a key's count is a share of: of a pair the id before and the class, else all that follows the ids."""
    return np.where(keys < INSIDE, classes.group(keys), keys >> 16)


def _buckets(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) * 2)


def pair_counts(corpus: DataFrame, classes: attention.Classes) -> DataFrame:
    """bundle, bucket (of groups), times and totals: how often the bundle's keys in that bucket, in order, and their groups came in all training texts; where bundle is null, the bucket's cells and how often they came."""
    buckets = _buckets(corpus.sparkSession)

    def deal(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for row in _rows(part):
                own = _Keys(row, classes.predicted < classes.outputs)
                keys, n = own.keys, own.counts(np.array(row["held"], bool))
                bucket = _group(keys, classes) % buckets
                order = np.argsort(bucket, kind="stable")
                keys, n, bucket = keys[order], n[order], bucket[order]
                starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, np.int64)
                spans = list(zip(starts.tolist(), [*starts[1:].tolist(), len(keys)]))
                yield pa.RecordBatch.from_arrays([pa.array(bucket[starts].astype(np.int32)), pa.array([row["bundle"]] * len(spans), pa.int64()), pa.array([_squeeze(keys[i:j]) for i, j in spans], pa.binary()), pa.array([_squeeze(n[i:j].astype(np.uint32)) for i, j in spans], pa.binary())], ["bucket", "bundle", "keys", "counts"])

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        own = [_whole(x, np.int64) for x in group["keys"]]
        keys, where = np.unique(np.concatenate(own), return_inverse=True)
        times = np.bincount(where, weights=np.concatenate([_whole(x, np.uint32) for x in group["counts"]]), minlength=len(keys)).astype(np.int64)
        of = np.unique(_group(keys, classes), return_inverse=True)[1]
        totals = np.bincount(of, weights=times).astype(np.int64)[of]
        n_pairs = np.searchsorted(keys, INSIDE)
        cells, at = np.unique(classes.cell(keys[:n_pairs]), return_inverse=True)
        ends = np.cumsum([len(x) for x in own])[:-1]
        out = [(b, _squeeze(times[i]), _squeeze(totals[i])) for b, i in zip(group["bundle"].tolist(), np.split(where, ends), strict=True)]
        out.append((None, _squeeze(cells.astype(np.int64)), _squeeze(np.bincount(at, weights=times[:n_pairs]).astype(np.int64))))
        rows = pd.DataFrame(out, columns=["bundle", "times", "totals"]).astype({"bundle": "Int64"})
        return rows.assign(bucket=group["bucket"].iloc[0])[["bundle", "bucket", "times", "totals"]]

    columns = ["bundle", "held", "lengths", "numbers", "pieces", "sizes"]
    dealt = corpus.select(*columns).mapInArrow(deal, "bucket int, bundle long, keys binary, counts binary")
    return dealt.groupBy("bucket").applyInPandas(merge, "bundle long, bucket int, times binary, totals binary")


def _cells(pairs: DataFrame, size: int) -> np.ndarray:
    """How often each cell came."""

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(size, np.int64)
        for part in parts:
            for cells, n in zip(*(c.to_pylist() for c in part.columns), strict=True):
                sums[_whole(cells, np.int64)] += _whole(n, np.int64)
        found = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(sums[found])], ["cell", "n"])

    found = pairs.where("bundle IS NULL").select("times", "totals").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(size)
    out[found["cell"].to_numpy(np.int64)] = found["n"]
    return out


def _counted(row: dict, own: _Keys, classes: attention.Classes, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a bundle's pairs the log probability of the id within its class, from corpus-wide counts; how often its keys and their groups came."""
    order = np.argsort(_group(own.keys, classes) % buckets, kind="stable")
    found = sorted(row["pairs"] or (), key=lambda x: x["bucket"])
    times, totals = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
    if found:
        times[order] = np.concatenate([_whole(x["times"], np.int64) for x in found])
        totals[order] = np.concatenate([_whole(x["totals"], np.int64) for x in found])
    n = own.n_pairs
    return classes.within_class_of(own.keys[:n], times[:n], totals[:n]), times, totals


def _within(row: dict, classes: attention.Classes, buckets: int) -> np.ndarray:
    """Of each of a bundle's ids the log probability within its class, from the corpus-wide counts of the bundle's pairs."""
    own = _Keys(row, classes.predicted < classes.outputs)
    logs = _counted(row, own, classes, buckets)[0]
    of_pieces = np.zeros(len(own.pieces), logs.dtype)  # of each piece after the one before it
    of_pieces[own.rest] = logs[own.of_rest]
    at, _, starts = _expanded(row)
    out = of_pieces[at]
    out[starts] = logs[own.of_words]
    return out


def _inside(own: _Keys, logs: np.ndarray, times: np.ndarray, totals: np.ndarray, classes: attention.Classes) -> np.ndarray:
    """Of a bundle's distinct words, and of the end, the log probability of all that follows the first id, that the word stops included. logs, times, totals: see _counted."""
    inside, n = own.keys[own.n_pairs :], own.n_pairs
    last, ahead = inside >> 16 & 0xFFFF, inside & 0xFFFF
    prior = classes.left[classes.into[last]].astype(np.float64)
    on = np.flatnonzero(own.pair_of >= 0)
    prior[on] = classes.follow[classes.into[last[on]], classes.out[ahead[on]]] + logs[own.pair_of[on]]
    each = np.log((times[n:] + attention.PRIOR * np.exp(prior)) / (totals[n:] + attention.PRIOR))
    return np.add.reduceat(np.r_[each[own.of_pieces - n], 0.0], own.first)


def fit(corpus: DataFrame, starts: np.ndarray | None = None, n_in: int = 512, n_out: int = 96, d: int = 24, warm: int = 16_384, every: int = 1, seed: int = 42) -> tuple[attention.Classes, dict[str, np.ndarray], DataFrame]:
    """Classes, weights and the counts of pairs (and inside words). starts: which ids begin a word, for attention over words only; warm: windows to start from at most; every: one window in so many trains on."""
    none, places = np.zeros(0, np.int64), _subwords if starts is None else _words
    classes = attention.Classes(subword_counts(corpus), none, none, n_in, n_out, starts)
    pairs = common.stored(pair_counts(corpus, classes), "lm-pairs")
    classes.follow_by(_cells(pairs, (n_in + 1) * classes.outputs))
    columns = ["bundle", "held", "lengths", "numbers", "pieces", "sizes"]

    def sample(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for row in _rows(part):
                c, y = _training_windows(row, classes, every, places)
                keep = np.random.default_rng(row["bundle"]).permutation(len(c))[:1024]
                yield pa.RecordBatch.from_arrays([pa.array([row["bundle"]]), pa.array([c[keep].astype(np.int16).tobytes()], pa.binary()), pa.array([y[keep].astype(np.int16).tobytes()], pa.binary())], ["bundle", "c", "y"])

    first = corpus.select(*columns).orderBy(F.xxhash64("bundle")).limit(max(1, warm // 1024)).mapInArrow(sample, "bundle long, c binary, y binary").toPandas().sort_values("bundle")
    c = np.frombuffer(b"".join(first["c"]), np.int16).reshape(-1, attention.WIDTH).astype(np.int64)
    y = np.frombuffer(b"".join(first["y"]), np.int16).reshape(-1, attention.STRIDE).astype(np.int64)
    p = attention.start(classes, d, seed)
    if not len(c):
        return classes, p, pairs
    p = attention.train(p, c, y, 0.01, 2, seed)

    def train_on(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [_training_windows(row, classes, every, places) for part in parts for row in _rows(part)]
        c, y = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros((0, 1)), None)
        if len(c):
            own = attention.train(p, c, y, 0.004, 1, seed, BATCH)
            flat = np.concatenate([own[k].ravel() for k in sorted(own)]).astype(np.float64) * len(c)
            part = TaskContext.get().partitionId() if TaskContext.get() else 0
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([len(c)], pa.int64()), pa.array([flat.tobytes()], pa.binary())], ["part", "n", "weights"])

    def add(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"part": group["part"].iloc[:1], "n": [group["n"].sum()], "weights": [sum(np.frombuffer(w) for w in group["weights"]).tobytes()]})

    schema = "part long, n long, weights binary"
    sums = corpus.select(*columns).mapInArrow(train_on, schema)
    for fan in (FAN, FAN**2):  # a tree, so that no task adds up more than FAN rows
        sums = sums.groupBy(F.floor(F.col("part") / fan).alias("of")).applyInPandas(add, schema)
    parts = sums.collect()  # one row for FAN ** 2 partitions
    n = sum(r["n"] for r in parts)
    if n:
        mean, at = sum(np.frombuffer(r["weights"]) for r in parts) / n, 0
        for k in sorted(p):
            p[k] = mean[at : at + p[k].size].reshape(p[k].shape).astype(np.float32)
            at += p[k].size
    return classes, p, pairs


def score(docs: DataFrame, ranks: str, doc_id: str = "doc_id", text: str = "text", held_out: str = "held_out", words_only: bool = False) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and n_subwords of each document.

    ranks: path of a byte-level BPE rank file that every worker has. Rows with held_out are not learnt from.
    words_only: attention over words, and counts inside them, in place of attention over all subword ids.
    """
    spark = docs.sparkSession
    corpus = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(held_out).alias("held_out"), common.text_of(text).alias("text"))
    corpus = common.stored(bundles(corpus, ranks), "lm-bundles")
    sums = common.stored(word_counts(corpus), "lm-word-counts")
    classes, weights, pairs = fit(corpus, begins(ranks) if words_only else None)
    buckets = _buckets(spark)
    words = "aggregate(held, 0L, (n, h) -> n + IF(h, 0, 1))"
    training = corpus.agg(F.sum(F.expr(words))).first()[0] or 0
    count = F.expr("aggregate(zip_with(held, lengths, (h, n) -> IF(h, 0, n)), 0L, (a, n) -> a + n)")
    train_tokens = (corpus.agg(F.sum(count)).first()[0] or 0) + training
    distinct = (sums.where("bundle IS NULL").agg(F.sum("n_new")).first()[0] or 0) + (training > 0)
    shared = spark.sparkContext.broadcast((classes, weights))
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_subwords long"

    def task(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = attention.Scorer(shared.value[1], shared.value[0])
        total = np.log10(train_tokens + 0.1 * (distinct + 1))
        for part in parts:
            for row in _rows(part):
                whole, ends, sizes = _ids(row)
                c = np.concatenate([*(_whole(x["sums"], np.int64) for x in sorted(row["sums"] or (), key=lambda x: x["bucket"])), np.zeros(1, np.int64)])
                c[-1] = training
                starts = np.r_[0, ends[:-1]]
                base = np.add.reduceat((np.log10(c + 0.1) - total)[whole], starts)
                known = np.add.reduceat((c > 0)[whole].astype(np.int64), starts)
                if words_only:
                    own = _Keys(row)
                    counted = _counted(row, own, shared.value[0], buckets)
                    ids, last, _ = _words(row)
                    logs = scorer.log_probabilities(ids, ends, counted[0][own.of_words], last=last) + _inside(own, *counted, shared.value[0])[whole]
                    logs[starts] += scorer.classes.left[scorer.classes.into[-1]]  # a text begins with a word or ends
                    logs = np.add.reduceat(logs, starts)
                else:
                    ids, last, stops = _subwords(row)
                    logs = scorer.log_probabilities(ids, stops, _within(row, shared.value[0], buckets), last=last).astype(np.float64)
                    logs = np.add.reduceat(logs, np.r_[0, stops[:-1]])
                logs /= np.log(10)
                subwords = np.add.reduceat(sizes[whole], starts)
                n = len(ends)
                columns = [pa.array(row["ids"], pa.int64()), pa.array(row["held"], pa.bool_()), pa.array(ends - starts), pa.array(known), pa.array(np.full(n, train_tokens, np.int64)), pa.array(base), pa.array(logs), pa.array(subwords)]
                yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in schema.split(", ")])

    mine = sums.where("bundle IS NOT NULL").groupBy("bundle").agg(F.collect_list(F.struct("bucket", "sums")).alias("sums"))
    of_pairs = pairs.where("bundle IS NOT NULL").groupBy("bundle").agg(F.collect_list(F.struct("bucket", "times", "totals")).alias("pairs"))
    return corpus.drop("hashes", "counts").join(mine, "bundle", "left").join(of_pairs, "bundle", "left").mapInArrow(task, schema)


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = common.table(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(common.fold_of("doc_id", 10) == 0, F.lit(False)))
    return score(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


QUERIES = {"op1_lm_scoring": op1_lm_scoring}
