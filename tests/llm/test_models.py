"""Language model, toxicity, quality, decontamination and the pipeline on small tables."""

import collections
import math
import pickle
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from keyloom.llm import attention, decontamination, lm_scoring, quality_resampling, toxicity

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(5)
    words = [a + b for a in ("th", "er", "on", "in", "st") for b in ("e", "an", "ing", "ed", "ly")]
    weights = [1 / (i + 1) for i in range(len(words))]
    rows = [(i, " ".join(r.choices(words, weights)[0] for _ in range(r.randint(1, 120)))) for i in range(300)]
    rows += [(300, None), (301, ""), (302, "\n "), (303, "Once ONCE once"), (None, "a null id"), (7, rows[7][1])]
    return spark.createDataFrame([(i, t, 0.5) for i, t in rows], "doc_id long, text string, score double").repartition(3)


def test_base_scores_and_counts(docs):
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0, F.lit(False))
    got = lm_scoring.score(docs.withColumn("held_out", held), RANKS).collect()
    rows = [(r.doc_id, (r.text or "").encode().lower().split()) for r in docs.collect()]
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    counts, ends = collections.Counter(), 0
    for i, words in rows:
        if not out(i):
            counts.update(words)
            ends += 1
    n, v = sum(counts.values()) + ends, len(counts) + 1
    want = sorted((-1 if i is None else i, out(i), len(w) + 1, sum(counts[x] > 0 for x in w) + 1, n, round(sum(math.log10((c + 0.1) / (n + 0.1 * (v + 1))) for c in [*(counts[x] for x in w), ends]), 6)) for i, w in rows)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    held_out = [r for r in got if r.held_out]
    # words of these texts come independently, so that their own frequencies are the best there is
    assert all(r.score < 0 for r in got) and sum(r.score for r in held_out) > 1.3 * sum(r.base_score for r in held_out)
    assert lm_scoring.score(docs.limit(0).withColumn("held_out", F.lit(False)), RANKS).count() == 0


def test_a_word_of_many_subwords(spark):
    word = "".join(random.Random(1).choice("qxzjkv0123456789") for _ in range(150_000))
    rows = spark.createDataFrame([(1, "a few words", False), (2, f"with {word} inside", False)], "doc_id long, text string, held_out boolean")
    n = len(lm_scoring.subwords(["with", word, "inside"], RANKS)[0]) + 1
    assert n > 65_535 + 3
    assert {r.doc_id: r.n_subwords for r in lm_scoring.score(rows, RANKS).collect()} == {1: 4, 2: n}


def test_all_pairs_are_counted(docs):
    rows = docs.select("doc_id", (F.col("doc_id") % 7 == 0).alias("held_out"), F.coalesce("text", F.lit("")).alias("text")).where("doc_id is not null")
    corpus = lm_scoring.bundles(rows, RANKS).cache()
    none = np.zeros(0, np.int64)
    classes = attention.Classes(lm_scoring.subword_counts(corpus), none, none, 512, 96)
    table = lm_scoring.pair_counts(corpus, classes).collect()
    bundles = [r.asDict(recursive=True) for r in corpus.collect()]
    want = collections.Counter()
    for row in bundles:
        ids, ends = lm_scoring._tokens(row)
        for held, a, b in zip(row["held"], [0, *ends.tolist()], ends.tolist()):
            if not held:
                want.update(zip([lm_scoring.VOCABULARY - 1, *ids[a : b - 1].tolist()], ids[a:b].tolist()))
    pairs = np.array(sorted(a * lm_scoring.VOCABULARY + b for a, b in want))
    whole = attention.Classes(lm_scoring.subword_counts(corpus), pairs, np.array([want[divmod(int(x), lm_scoring.VOCABULARY)] for x in pairs]), 512, 96)
    assert len(bundles) > 1 and min(want.values()) == 1
    for row in bundles:
        row["pairs"] = [r.asDict() for r in table if r.bundle == row["bundle"]]
        own = lm_scoring._within(row, classes, lm_scoring._buckets(docs.sparkSession))
        ids, ends = lm_scoring._tokens(row)
        last = attention.before(ids, ends, lm_scoring.VOCABULARY - 1)
        assert np.allclose(own, whole.within_class(last, ids))
    classes.follow_by(lm_scoring._cells(docs.sparkSession.createDataFrame(table), 513 * 96))
    assert np.allclose(classes.follow, whole.follow)


def test_words_go_on_and_stop_as_counted(docs):
    """Log probabilities inside words against plain counts, over all bundles; what can follow has probability one together."""
    rows = docs.select("doc_id", (F.col("doc_id") % 7 == 0).alias("held_out"), F.coalesce("text", F.lit("")).alias("text")).where("doc_id is not null")
    corpus = lm_scoring.bundles(rows, RANKS).cache()
    none, starts = np.zeros(0, np.int64), lm_scoring.begins(RANKS)
    classes = attention.Classes(lm_scoring.subword_counts(corpus), none, none, 512, 96, starts)
    table = lm_scoring.pair_counts(corpus, classes).collect()
    classes.follow_by(lm_scoring._cells(docs.sparkSession.createDataFrame(table), 513 * classes.outputs))
    bundles = [r.asDict(recursive=True) for r in corpus.collect()]
    pairs, inside, words = collections.Counter(), collections.Counter(), {}
    for i, row in enumerate(bundles):
        whole, ends, sizes = lm_scoring._ids(row)
        pieces, first = lm_scoring._pieces(row, sizes)
        words[i] = [tuple(pieces[a : a + n].tolist()) for a, n in zip(first, sizes)]
        assert all(starts[w[0]] and not starts[list(w[1:])].any() for w in words[i])
        for held, a, b in zip(row["held"], [0, *ends.tolist()], ends.tolist()):
            last = lm_scoring.VOCABULARY - 1
            for w in () if held else [words[i][x] for x in whole[a:b]]:
                pairs.update(zip((last, *w[:-1]), w))
                last = w[-1]
                inside.update(zip((None, *w[:-1]), w, (*w[1:], None)))
    pairs = {k: n for k, n in pairs.items()}
    follows, of_class, contexts = collections.defaultdict(list), collections.Counter(), collections.Counter()
    for (a, b), n in pairs.items():
        follows[a].append(b)
        of_class[a, classes.out[b]] += n
    for (a, b, c), n in inside.items():
        contexts[a, b] += 0 if b == lm_scoring.VOCABULARY - 1 else n

    def after(b, c):  # probability by pairs
        if c is None:
            return np.exp(classes.left[classes.into[b]])
        share, own = classes.within[c], classes.out[c]
        within = (pairs.get((b, c), 0) + attention.PRIOR * share) / (of_class[b, own] + attention.PRIOR) if share < 1 else 1
        return np.exp(classes.follow[classes.into[b], own]) * within

    seen = 0
    for i, row in enumerate(bundles):
        row["pairs"] = [r.asDict() for r in table if r.bundle == row["bundle"]]
        own = lm_scoring._Keys(row)
        got = lm_scoring._inside(own, *lm_scoring._counted(row, own, classes, lm_scoring._buckets(docs.sparkSession)), classes)
        for w, x in zip(words[i][:-1], got[:-1]):
            steps = zip((None, *w[:-1]), w, (*w[1:], None))
            assert math.isclose(x, sum(math.log((inside[a, b, c] + attention.PRIOR * after(b, c)) / (contexts[a, b] + attention.PRIOR)) for a, b, c in steps), rel_tol=1e-4, abs_tol=1e-4)
            seen += len(w) > 1
        assert got[-1] == 0
    assert len(bundles) > 1 and seen > 10
    b = words[0][0][0]
    assert abs(sum(after(b, c) for c in [None, *np.flatnonzero(~starts).tolist()]) - 1) < 1e-3


def test_windows_are_of_words(docs):
    """Attention costs by word, of however many subwords; all windows of training texts train."""
    r = random.Random(9)
    texts = [(i, i % 5 == 0, " ".join("".join(r.choices("qxzjkv0123", k=30)) for _ in range(n))) for i, n in enumerate(r.choices(range(120), k=40))]
    row = lm_scoring.bundles(docs.sparkSession.createDataFrame(texts, "doc_id long, held_out boolean, text string").coalesce(1), RANKS).first().asDict(recursive=True)
    classes = attention.Classes(np.ones(lm_scoring.VOCABULARY, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), 512, 96)
    c, y = lm_scoring._training_windows(row, classes, 1)
    assert len(c) == len(y) == sum(-(-(len(t.split()) + 1) // attention.STRIDE) for _, held, t in texts if not held)
    assert (y >= 0).sum() == sum(len(t.split()) + 1 for _, held, t in texts if not held)


def test_attention_reaches_inside_words(spark):
    """A word's last subword follows the word before it, which the two subwords before do not tell; attention over every subword does."""
    r = random.Random(3)
    tails = {"red": "ka", "blue": "mi"}
    ids = [lm_scoring.subwords([f"qzx{t}"], RANKS)[0].tolist() for t in tails.values()]
    assert ids[0][:-1] == ids[1][:-1] and len(ids[0]) >= 3 and ids[0][-1] != ids[1][-1]

    def text(swapped):
        colours = r.choices(list(tails), k=40)
        return " ".join(f"{c} qzx{tails[c] if not swapped else tails['red' if c == 'blue' else 'blue']}" for c in colours)

    rows = [(i, text(False), False) for i in range(600)] + [(1000 + i, text(i % 2 == 1), True) for i in range(20)]
    got = lm_scoring.score(spark.createDataFrame(rows, "doc_id long, text string, held_out boolean").repartition(2), RANKS).where("held_out").collect()
    mean = [np.mean([x.score for x in got if x.doc_id % 2 == k]) / 40 for k in (0, 1)]
    assert mean[0] > mean[1] + 0.5  # to the base of 10, for each pair of words


def test_every_subword_is_predicted(docs):
    """Windows that train hold each subword id of the training texts, and each text's end, once."""
    r = random.Random(9)
    texts = [(i, i % 5 == 0, " ".join("".join(r.choices("qxzjkv0123", k=30)) for _ in range(n))) for i, n in enumerate(r.choices(range(120), k=40))]
    row = lm_scoring.bundles(docs.sparkSession.createDataFrame(texts, "doc_id long, held_out boolean, text string").coalesce(1), RANKS).first().asDict(recursive=True)
    none = np.zeros(0, np.int64)
    classes = attention.Classes(np.ones(lm_scoring.VOCABULARY, np.int64), none, none, 512, 96)
    _, y = lm_scoring._training_windows(row, classes, 1, lm_scoring._subwords)
    want = [[*lm_scoring.subwords(t.split(), RANKS)[0].tolist(), lm_scoring.VOCABULARY - 1] for _, held, t in texts if not held]
    assert y[y >= 0].tolist() == classes.out[np.concatenate(want)].tolist()


def small_model():
    r = np.random.default_rng(0)
    n = 12
    counts = r.integers(1, 50, n)
    pairs = np.arange(n * n)[r.random(n * n) < 0.7]
    classes = attention.Classes(counts, pairs, r.integers(1, 9, len(pairs)), 6, 4)
    p = {k: x + r.standard_normal(x.shape).astype(np.float32) * 0.3 for k, x in attention.start(classes, 5, 1).items()}
    return classes, p, n


def test_attention_is_a_distribution_and_causal():
    classes, p, n = small_model()
    scorer = attention.Scorer(p, classes)
    r = np.random.default_rng(2)
    ids = r.integers(0, n - 1, 50)
    ends = np.array([10, 50])
    logs = scorer.log_probabilities(ids, ends, batch=2)
    for at in (0, 5, 10, 41, 49):
        total = 0
        for x in range(n):
            other = ids.copy()
            other[at] = x
            found = scorer.log_probabilities(other, ends)
            total += math.exp(found[at])
            assert np.allclose(found[:at], logs[:at], atol=1e-4)
        assert abs(total - 1) < 1e-3
    # a text's scores don't depend on its neighbours
    assert np.allclose(scorer.log_probabilities(ids[10:], np.array([40])), logs[10:], atol=1e-4)


def test_scores_against_a_plain_loop():
    """Attention over each place's own context, one at a time, without tables or windows' batches."""
    classes, p, n = small_model()
    p["q"] *= 40  # attention far from even
    ids = np.random.default_rng(4).integers(0, n - 1, 45)
    got = attention.Scorer(p, classes).log_probabilities(ids, np.array([20, 45]), batch=3)
    for start, end in ((0, 20), (20, 45)):
        into = [classes.into[classes.end if t == start else ids[t - 1]] for t in range(start, end)]
        for t in range(end - start):
            first = max(0, t // attention.STRIDE * attention.STRIDE - attention.STRIDE)
            x = p["e"][into[t]]
            heed = np.array([x @ p["q"] @ (p["e"][into[s]] @ p["k"]) / math.sqrt(5) + p["near"][t - s] for s in range(first, t + 1)])
            share = np.exp(heed - heed.max()) / np.exp(heed - heed.max()).sum()
            z = sum(w * (p["e"][into[s]] @ p["v"]) for w, s in zip(share, range(first, t + 1))) + x @ p["r"] + p["h"]
            logits = np.maximum(z, 0) @ p["o"] + p["b"][into[t]]
            y = ids[start + t]
            before = classes.end if t == 0 else ids[start + t - 1]
            times = dict(zip(classes.pairs.tolist(), classes.times.tolist()))
            total = sum(m for k, m in times.items() if k // n == before and classes.out[k % n] == classes.out[y])
            alone = classes.within[y] >= 1
            within = 0 if alone else math.log((times.get(before * n + y, 0) + attention.PRIOR * classes.within[y]) / (total + attention.PRIOR))
            assert abs(got[start + t] - (logits[classes.out[y]] - np.log(np.exp(logits - logits.max()).sum()) - logits.max() + within)) < 1e-3


def test_gradients_against_differences():
    classes, p, n = small_model()
    r = np.random.default_rng(8)
    p = {k: x.astype(np.float64) for k, x in p.items()}
    c, y = r.integers(0, 7, (6, attention.WIDTH)), r.integers(-1, 4, (6, attention.STRIDE))
    c[:, -attention.STRIDE :] = np.minimum(c[:, -attention.STRIDE :], 5)
    _, grad = attention.gradients(p, c, y)
    for name, g in grad.items():
        for at in r.integers(0, g.size, 5):
            both = []
            for step in (1e-4, -1e-4):
                other = {k: x.copy() for k, x in p.items()}
                other[name].ravel()[at] += step
                both.append(attention.gradients(other, c, y)[0])
            want = (both[0] - both[1]) / 2e-4
            assert abs(g.ravel()[at] - want) < 1e-4 + 1e-2 * abs(want), name


def test_windows_score_every_place_once():
    ends = np.array([1, 17, 17 + 16, 90])
    at, inside = attention.windows(ends)
    assert at[:, attention.STRIDE :][inside[:, attention.STRIDE :]].tolist() == list(range(90))


def test_windows_laid_out_at_once():
    ends = np.array([1, 17, 17 + 16, 90])
    ids = np.random.default_rng(6).integers(0, 50, 90)
    at, inside = attention.windows(ends)
    assert (attention.in_windows(ids, ends, -1) == np.where(inside, ids[np.clip(at, 0, 89)], -1)).all()
    assert attention.in_windows(ids[:0], ends[:0], -1).shape == (0, attention.WIDTH)


def test_logits_out_of_range():
    """Exponentials beyond the type's range are taken again from each row's largest."""
    classes, p, n = small_model()
    p["o"] *= 3000
    ids = np.random.default_rng(4).integers(0, n - 1, 45)
    logs = attention.Scorer(p, classes).log_probabilities(ids, np.array([20, 45]))
    assert np.isfinite(logs).all() and (logs <= 1e-3).all()
    c, y = np.random.default_rng(1).integers(0, 6, (3, attention.WIDTH)), np.random.default_rng(2).integers(0, 4, (3, attention.STRIDE))
    loss, grad = attention.gradients(p, c, y)
    assert np.isfinite(loss) and all(np.isfinite(g).all() for g in grad.values())


def test_training_follows_the_gradient():
    classes, p, n = small_model()
    r = np.random.default_rng(3)
    ids = np.tile(np.arange(8), 100)
    ends = np.array([len(ids)])
    at, inside = attention.windows(ends)
    at = np.clip(at, 0, len(ids) - 1)
    c = np.where(inside, classes.into[attention.before(ids, ends, classes.end)][at], classes.inputs)
    y = np.where(inside, classes.out[ids[at]], -1)[:, attention.STRIDE :]
    before = attention.Scorer(p, classes).log_probabilities(ids, ends).sum()
    after = attention.Scorer(attention.train(p, c, y, 0.02, 30, 1, 16), classes).log_probabilities(ids, ends).sum()
    assert after > before + 50


def test_training_leaves_types_of_pickles():
    """With them add.at would take many times as long in tasks."""
    classes, p, n = small_model()
    p = pickle.loads(pickle.dumps(p))
    c, y = np.random.default_rng(1).integers(0, 6, (3, attention.WIDTH)), np.random.default_rng(2).integers(0, 4, (3, attention.STRIDE))
    got = attention.train(p, c, y, 0.01, 1, 1)
    assert all(x.dtype is np.dtype(np.float32) for x in got.values())


def test_label_model_recovers_the_truth():
    """Voters of known accuracy, some of which repeat each other: posteriors rank the truth and beat the vote."""
    r = np.random.default_rng(6)
    truth = r.random(4000) < 0.2
    speak = [np.where(truth, r.random(4000) < hit, r.random(4000) < miss) for hit, miss in ((0.6, 0.01), (0.5, 0.03), (0.4, 0.1), (0.3, 0.02))]
    copies = [speak[2] & (r.random(4000) < 0.97) for _ in range(3)]
    fixed = [r.random(4000) < 0.1 for _ in range(len(toxicity.PATTERNS))]
    votes = np.stack([*speak, *copies, *fixed], axis=1)
    got = toxicity.label_model(votes, truth.mean())
    auc = lambda score: np.mean([np.mean((score[truth] > x) + 0.5 * (score[truth] == x)) for x in score[~truth][:400]])
    assert auc(got) > auc(votes[:, : -len(fixed)].sum(1).astype(float)) > 0.5 and abs(got.mean() - truth.mean()) < 0.15
    alone = [got[(votes[:, :4].sum(1) == 1) & votes[:, k]].mean() for k in (0, 2)]
    assert alone[0] > alone[1]  # the more accurate voter counts for more


def test_logistic_regression_against_plain_gradients():
    r = np.random.default_rng(1)
    x, y = r.random((200, 5)) < 0.4, r.random(200)
    w = toxicity.fit_linear(x, y, 0.5)
    p = 1 / (1 + np.exp(-(np.c_[x, np.ones(200)] @ w)))
    for k in range(5):
        assert abs(sum((p[i] - y[i]) * x[i, k] for i in range(200)) + 0.5 * w[k]) < 1e-6


def test_toxicity_held_out(spark):
    r = random.Random(2)
    words = [f"{a}{b}" for a in ("lorem", "ipsu", "dolo", "ame") for b in ("", "ra", "ti", "mon", "lex", "qui")]
    bad = ["idiotic", "moronic", "trashy", "scummy"]
    rows, labels = [], []
    for i in range(1200):
        text = [r.choice(words) for _ in range(r.randint(5, 60))]
        toxic = int(r.random() < 0.15)
        if toxic:
            for _ in range(r.randint(1, 4)):
                text.insert(r.randrange(len(text)), r.choice(bad))
        rows.append((i, " ".join(text)))
        labels.append((i, toxic, 1))
    rows += [(5000, None), (5001, ""), (None, "idiotic"), (3, rows[3][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("toxic", F.lit("own"))
    known = spark.createDataFrame(labels, "doc_id long, toxic int, quality int")
    got = toxicity.toxicity(docs, known.where("doc_id % 4 != 2")).collect()
    truth = {i: t for i, t, _ in labels}
    held = [(r.score >= 0.3) == bool(truth[r.doc_id]) for r in got if r.doc_id is not None and r.doc_id < 5000 and r.doc_id % 4 == 2]
    assert sum(held) / len(held) > 0.97
    score = {r.doc_id: r.score for r in got}
    assert score[5000] == score[5001] < 0.3 < score[None] and all(0 <= s <= 1 for s in score.values())
    assert {r.score for r in toxicity.toxicity(docs, known.where("toxic = 0")).collect()} == {1 / (1 + math.exp(30))}
    assert toxicity.toxicity(docs.limit(0), known.limit(0)).count() == 0


def test_quality_keeps_the_target(spark):
    r = random.Random(4)
    rows = [(i, " ".join(r.choice(["plain", "words", "of", "prose"]) if i % 5 else r.choice(["BUY!!", "NOW!!", "$$$"]) for _ in range(r.randint(5, 50)))) for i in range(800)]
    rows += [(None, "plain words"), (801, None), (802, ""), (1, rows[1][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit("own"))
    labels = spark.createDataFrame([(i, int(i % 5 > 0)) for i in range(0, 800, 3)], "doc_id long, quality int")
    kept = quality_resampling.resample(docs, labels, buckets=256)
    ids = {r.doc_id for r in kept.collect()}
    good = {i for i in range(800) if i % 5}
    assert len(good - ids) <= 2 and len(ids & set(range(0, 800, 5))) < 60
    share = quality_resampling.resample(docs, labels, buckets=256, share=0.1).count()
    assert share == math.ceil(0.1 * 804)
    assert quality_resampling.resample(docs.limit(0), labels).count() == 0
    assert quality_resampling.resample(docs, labels.limit(0)).count() == 804


def test_quality_weights_and_draw_by_brute_force(spark):
    r = random.Random(14)
    rows = [(i, " ".join(r.choice(["Plain", "words,", "of", "prose!"]) for _ in range(r.randint(0, 30)))) for i in range(200)] + [(None, "of prose"), (7, "prose"), (300, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(0, 100)], "doc_id long, quality int")
    whole = quality_resampling.resample(docs, labels, buckets=64, share=1.0).collect()
    raw, target = collections.Counter(), collections.Counter()
    grams = []
    for i, t in rows:
        words = re.findall(r"\w+|[^\w\s]+", t or "")
        h = [zlib.crc32(w.encode()) for w in words]
        own = [x % 64 for x in h] + [((a * 0x9E3779B97F4A7C15 + b * 0xC2B2AE3D27D4EB4F) % 2**64 >> 32) % 64 for a, b in zip(h, h[1:])]
        grams.append(own)
        raw.update(own)
        if i is not None and i < 100 and i % 3 == 0:
            target.update(own)
    ratio = [math.log((target[b] + 1) / (target.total() + 64)) - math.log((raw[b] + 1) / (raw.total() + 64)) for b in range(64)]
    want = sorted((-1 if i is None else i, round(sum(ratio[b] for b in g), 9)) for (i, _), g in zip(rows, grams, strict=True))
    assert sorted((-1 if x.doc_id is None else x.doc_id, round(x.log_weight, 9)) for x in whole) == want
    noise = [x.key - x.log_weight for x in whole]
    assert abs(sum(noise) / len(noise) - 0.5772) < 0.3 and len({round(x, 9) for x in noise}) == len(rows) - 1  # of equal ids it is equal
    drawn = quality_resampling.resample(docs, labels, buckets=64, share=0.25).collect()
    assert sorted(x.key for x in drawn) == sorted((x.key for x in whole), reverse=True)[: math.ceil(0.25 * len(rows))][::-1]


@pytest.mark.parametrize("k", [1, 7, 500, 1000])
def test_kth_largest(spark, k):
    r = random.Random(k)
    values = [r.gauss(0, 10) for _ in range(998)] + [3.0, 3.0]
    got = quality_resampling.kth_largest(spark.createDataFrame([(v,) for v in values], "key double"), "key", k)
    assert got == sorted(values, reverse=True)[k - 1]


def brute_contaminated(docs, items, similarity):
    split = lambda t: [w for w in re.split(r"[\x20\x09-\x0D]+", (t or "").lower()) if w]
    out = {}
    for d, t in docs:
        words = split(t)
        for i, x in items:
            item = split(x)
            k = min(5, len(item))
            own = collections.Counter(" ".join(item[a : a + k]) for a in range(len(item) - k + 1))
            for a in range(len(words) - len(item) + 1 if item else 0):
                w = collections.Counter(" ".join(words[b : b + k]) for b in range(a, a + len(item) - k + 1))
                both = sum((w & own).values())
                s = both / (2 * own.total() - both)
                if s >= similarity - 1e-9 and s > out.get((d, i), (0, 0))[0]:
                    out[d, i] = (s, a)
    return {k: (a, round(s, 9)) for k, (s, a) in out.items()}


def test_decontamination(spark):
    r = random.Random(9)
    words = [f"w{i}" for i in range(200)]
    text = lambda n: [r.choice(words) for _ in range(n)]
    items = [(i, " ".join(text(r.randint(8, 45)))) for i in range(12)] + [(12, "one two three"), (13, None), (14, " "), (15, "same " * 9), (16, "Odd\tONE out of five words")]
    docs = []
    for i in range(60):
        own = text(r.randint(20, 90))
        if i % 3 == 0:
            x = items[r.randrange(12)][1].split()
            for _ in range(i % 2):
                x[r.choice([0, len(x) - 1])] = "edit"
            own[10:10] = x
        docs.append((i, " ".join(own).replace(" ", "\n", 2)))
    docs += [(60, None), (61, ""), (62, "a one TWO three b"), (63, "same " * 40), (64, "x odd one out of five words"), (3, docs[3][1]), (65, items[0][1])]
    got = decontamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string").withColumn("length", F.lit(1)), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = brute_contaminated(docs, items, 0.8)
    assert {(x.doc_id, x.item_id): (x.start, round(x.similarity, 9)) for x in got} == want and len(got) == len(want) > 20
    assert all(x.distance <= 23 for x in got)
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), none).count() == 0
    assert decontamination.contaminated(spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).count() == 0


def brute_near_copies(rows):
    """Ids that similar pairs (sets of five words, 0.8 or more) connect with a smaller id, over all pairs."""
    sets = []
    for _, t in rows:
        words = (t or "").encode().lower().split()
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            both = len(a & b)
            if a == b or both and both / (len(a) + len(b) - both) >= 0.8:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return {d for i, (d, _) in enumerate(rows) if least[find(i)] != d}


def test_pipeline(spark):
    """Every stage of the pipeline against brute force, on what the stage before it kept."""
    from .test_dedup import brute_runs

    data = "/root/testdata/sf0.001"
    documents = spark.read.parquet(f"{data}/documents.parquet")
    docs, held = documents, {}
    names = [n for n, _ in corpus_pipeline.STAGES]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, data)
        assert after.columns == documents.columns
        before, docs = docs, corpus_pipeline.common.stored(after, f"test-{name}")
        held[name] = [sorted((r.doc_id, r.text) for r in x.collect()) for x in (before, docs)]
    assert names == ["quality", "lines", "near-copies", "benchmark", "packing"]
    chosen = {r.doc_id for r in quality_resampling.resample(documents, spark.read.parquet(f"{data}/labels.parquet")).collect()}
    assert held["quality"][1] == [r for r in held["quality"][0] if r[0] in chosen] and len(chosen) < documents.count()
    before, after = held["lines"]
    want = []
    for (i, t), gone in zip(before, brute_runs([t or "" for _, t in before], 25), strict=True):
        left = "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone)
        want += [(i, left)] if not gone or left.split() else []
    assert after == want and after != before
    before, after = held["near-copies"]
    gone = brute_near_copies(before)
    assert after == [r for r in before if r[0] not in gone]
    before, after = held["benchmark"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    leaks = {d for d, _ in brute_contaminated(before, items, 0.8)}
    assert after == [r for r in before if r[0] not in leaks]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, data).toPandas()
    assert set(packed.doc_id) == {d for d, _ in after} and len(after) > 0
    assert packed.groupby("sequence_id").length.sum().max() <= 2048


def test_a_run_leaves_its_last_table_only(spark, monkeypatch):
    monkeypatch.setattr(corpus_pipeline, "STAGES", [("a", lambda s, docs, d: corpus_pipeline.common.stored(docs, "own")), ("b", lambda s, docs, d: docs.limit(3))])
    start = corpus_pipeline.common.count_stored()
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() == 3
    assert corpus_pipeline.common.count_stored() == start + 1


def test_line_stage_without_n_chars(spark):
    from keyloom.llm import line_dedup

    lines = "\n".join(["a line of seven words, no more"] * 2 + ["and another one of eight words, not less"] * 2)
    docs = spark.createDataFrame([(1, lines), (2, lines), (3, None), (4, "own words")], "doc_id long, text string")
    out = line_dedup.line_stage(spark, docs, "")
    assert out.columns == ["doc_id", "text"] and sorted(r.doc_id for r in out.collect()) == [1, 3, 4]


def test_fingerprints_and_blocks_of_small_plans(spark):
    """Every bit's majority, the sign's too, and every change of every block; the plan, which the driver holds and sends, has no expression for each."""
    r = random.Random(3)
    rows = [(k, r.getrandbits(64) - (1 << 63)) for k in range(40) for _ in range(1 + k % 7)]
    fps = decontamination._fingerprints(spark.createDataFrame(rows, "key long, h long"), ["key"])
    of = lambda k, b: [h >> b & 1 for i, h in rows if i == k]
    want = {k: sum(1 << b for b in range(64) if 2 * sum(of(k, b)) > len(of(k, b))) for k in range(40)}
    assert {x.key: x.fp % (1 << 64) for x in fps.collect()} == want and max(want.values()) >> 63
    assert len(fps._jdf.queryExecution().analyzed().toString()) < 5_000
    changes = decontamination._changes(23)
    blocks = decontamination._blocks(fps, changes, "key")
    assert sorted((x.key, x.block, x.value) for x in blocks.collect()) == sorted((k, i, (v >> 8 * i & 255) ^ c) for k, v in want.items() for i in range(8) for c in changes)
    assert blocks.count() == 40 * 8 * 37 and "struct" not in blocks._jdf.queryExecution().optimizedPlan().toString()
