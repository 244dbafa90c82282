"""A small causal self-attention model in numpy.

The model reads subword ids by input class and predicts the next id's class; the id within its
class has a smoothed frequency, so that all ids together have probability one. Classes follow the
ids' frequencies: frequent ids have one of their own. Within its class an id's probability follows
how often it came after the id before it, smoothed by how often it came at all. A window holds two strides of positions; the
second stride is scored, with at least one stride of context before it where the text has as much.

Positions can be ids, or words, of which the first ids are predicted. Then ids that go on with a word have
classes of their own, and attention deals out among the other classes what is left for them.
"""

from __future__ import annotations

import numpy as np

STRIDE = 16
WIDTH = 2 * STRIDE
FAR = np.float32(-1e4)
#: Weight of an id's own frequency beside its frequency after another.
PRIOR = 10


class Classes:
    """Input and output classes of ids, and each id's log probability within its output class.

    counts: of every id, the last of which ends a text and is a class of its own.
    """

    def __init__(self, counts: np.ndarray, pairs: np.ndarray, times: np.ndarray, inputs: int, outputs: int, begins: np.ndarray | None = None):
        """pairs: in order, id before times the number of ids plus id; times: how often each came. begins: which ids can begin a word, the end among them (none: all); the others have as many classes again."""
        self.inputs, self.predicted, self.size = inputs, outputs, len(counts)
        self.into, self.out = self._deal(counts, inputs), self._deal(counts, outputs)
        if begins is not None:
            self.out[begins] = self._deal(counts[begins], outputs)
            self.out[~begins] = self._deal(np.r_[counts[~begins], 0], outputs + 1)[:-1] + outputs - 1
            outputs *= 2
        self.outputs = outputs
        size, mass = np.bincount(self.out, minlength=outputs), np.bincount(self.out, weights=counts, minlength=outputs)
        self.within = ((counts + 0.5) / (mass + 0.5 * size)[self.out]).astype(np.float32)
        self.end = len(counts) - 1
        self.pairs, self.times = pairs, times
        self.groups, where = np.unique(self.group(pairs), return_inverse=True)
        self.totals = np.bincount(where, weights=times, minlength=len(self.groups))
        self.follow_by(np.bincount(self.cell(pairs), weights=times, minlength=(inputs + 1) * outputs))

    def group(self, pairs: np.ndarray) -> np.ndarray:
        """Of each pair the id before and the output class."""
        return pairs // self.size * self.outputs + self.out[pairs % self.size]

    def cell(self, pairs: np.ndarray) -> np.ndarray:
        """Of each pair the input class and the output class."""
        return self.into[pairs // self.size] * self.outputs + self.out[pairs % self.size]

    def follow_by(self, times: np.ndarray) -> None:
        """times: how often each cell came."""
        follow, outputs = times.reshape(-1, self.outputs), self.outputs
        share = (follow.sum(0) + 1) / (follow.sum() + outputs)
        share = (follow + 20 * share) / (follow.sum(1, keepdims=True) + 20)
        self.follow = np.log(share).astype(np.float32)
        #: Of each input class, log probability that a class follows which attention predicts.
        self.left = np.log(share[:, : self.predicted].sum(1)).astype(np.float32)

    def within_class_of(self, pairs: np.ndarray, times: np.ndarray, totals: np.ndarray) -> np.ndarray:
        """Log probabilities of pairs' ids within their classes after the ids before them: how often each pair and its group came."""
        share = self.within[pairs % self.size]
        return np.where(share < 1, np.log((times + PRIOR * share) / (totals + PRIOR)), 0).astype(np.float32)  # ids with a class of their own are certain in it

    def within_class(self, before: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Log probabilities of ids within their classes after the ids before them."""
        def look_up(keys: np.ndarray, values: np.ndarray, of: np.ndarray) -> np.ndarray:
            if not len(keys):
                return np.zeros(len(of))
            at = np.minimum(np.searchsorted(keys, of), len(keys) - 1)
            return np.where(keys[at] == of, values[at], 0)

        keys, where = np.unique(before * self.size + ids, return_inverse=True)  # each pair once, and in order
        return self.within_class_of(keys, look_up(self.pairs, self.times, keys), look_up(self.groups, self.totals, self.group(keys)))[where]

    @staticmethod
    def _deal(counts: np.ndarray, classes: int) -> np.ndarray:
        """The most frequent three quarters alone, the others in classes of about equal mass; class 0 is the end's."""
        alone = classes * 3 // 4
        order = np.argsort(-counts[:-1], kind="stable")
        out = np.zeros(len(counts), np.int64)
        out[order[: alone - 1]] = np.arange(1, alone)
        rest = order[alone - 1 :]
        mass = np.cumsum(counts[rest] + 0.5)
        if len(rest):
            out[rest] = alone + np.minimum(mass * (classes - alone) // mass[-1], classes - alone - 1).astype(np.int64)
        return out


def start(classes: Classes, d: int, seed: int) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    n = lambda *shape, s=1.0: (rng.standard_normal(shape) * s / np.sqrt(shape[0])).astype(np.float32)
    zero = lambda *shape: np.zeros(shape, np.float32)
    return {"e": rng.standard_normal((classes.inputs + 1, d)).astype(np.float32) * 0.3, "q": n(d, d), "k": n(d, d), "v": n(d, d), "r": n(d, d), "h": zero(d), "o": n(d, classes.predicted, s=0.1), "b": classes.follow[:, : classes.predicted].copy(), "near": zero(WIDTH)}


def windows(ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For texts that end before the given places: the windows' places, and which of them lie in their text."""
    starts = np.r_[0, ends[:-1]]
    n = -(-(ends - starts) // STRIDE)
    number = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    first = np.repeat(starts, n)
    at = (first + STRIDE * number)[:, None] + np.arange(-STRIDE, STRIDE)
    return at, (at >= first[:, None]) & (at < np.repeat(ends, n)[:, None])


def in_windows(values: np.ndarray, ends: np.ndarray, outside: int) -> np.ndarray:
    """values, one for each id, as windows() places them; outside stands where a window leaves its text.

    Each text is laid out once, in whole strides after an empty one, so that a window is two strides that follow each other.
    """
    sizes = np.diff(np.r_[0, ends])
    n = -(-sizes // STRIDE)
    upto = np.cumsum(n + 1)
    shift = (upto - n) * STRIDE - (ends - sizes)
    laid = np.full((upto[-1] if len(upto) else 0, STRIDE), outside, values.dtype)
    laid.reshape(-1)[np.repeat(shift, sizes) + np.arange(len(values))] = values
    first = np.arange(n.sum()) + np.repeat(np.arange(len(n)), n)  # a text has one stride more than windows
    return np.concatenate([laid[first], laid[first + 1]], 1)


def before(ids: np.ndarray, ends: np.ndarray, end: int) -> np.ndarray:
    """At each place the id before it; a text starts after an end."""
    out = np.empty_like(ids)
    out[1:] = ids[:-1]
    out[np.r_[0, ends[:-1]]] = end
    return out


#: Distance from a query to each key, and whether the key is not after it.
_BACK = (np.arange(STRIDE)[:, None] + STRIDE) - np.arange(WIDTH)[None, :]
_SEEN = _BACK >= 0


def _tables(p: dict[str, np.ndarray]) -> tuple[np.ndarray, ...]:
    """What follows from one input class or from two: values, what a place adds for itself, and attention before it is normalised: of a class to a class (none to what is outside), times that of places.

    Each class's largest is taken off first, which changes no share and keeps sums in range.
    """
    kind, outside = p["e"].dtype.type, len(p["e"]) - 1
    heed = p["e"] @ p["q"] / kind(np.sqrt(p["e"].shape[1])) @ (p["e"] @ p["k"]).T
    heed -= heed[:, :outside].max(1, keepdims=True)
    np.exp(heed, out=heed)
    heed[:, outside] = 0
    near = np.where(_SEEN, p["near"][np.clip(_BACK, 0, None)], FAR)
    return p["e"] @ p["v"], p["e"] @ p["r"] + p["h"], heed, np.exp(near - near.max()).astype(kind)


def _mix(c: np.ndarray, value: np.ndarray, heed: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of windows' classes: the places of pairs in heed, attention before it is normalised, by what to normalise it, values, and their sums by attention."""
    pairs = (c[:, STRIDE:] * len(heed))[:, :, None] + c[:, None, :]
    w = np.empty(pairs.shape, heed.dtype)
    np.take(heed, pairs, out=w, mode="clip")
    w *= near
    share = 1 / (w.reshape(-1, WIDTH) @ np.ones(WIDTH, w.dtype) + w.dtype.type(1e-30))  # sums by BLAS
    v = np.take(value, c, axis=0)
    z = (w @ v).reshape(-1, value.shape[1])
    z *= share[:, None]
    return pairs, w, share, v, z


def _exp_logits(h: np.ndarray, cq: np.ndarray, p: dict[str, np.ndarray], at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of places: exp of the output classes' logits, their sums, and the logits at the given places of the whole array; for each place up to a factor."""
    logits = h @ p["o"]
    logits += np.take(p["b"], cq, axis=0)
    if len(logits) and max(logits.max(), -logits.min()) > 60:  # else no sum leaves the range of its type
        logits -= logits.max(1, keepdims=True)
    picked = logits.ravel()[at]
    np.exp(logits, out=logits)
    return logits, logits @ np.ones(logits.shape[1], logits.dtype), picked


class Scorer:
    """Scores batches of windows; what follows from one input class or from two is in tables."""

    def __init__(self, p: dict[str, np.ndarray], classes: Classes):
        self.classes, self.p = classes, p
        self.v, self.r, self.heed, self.near = _tables(p)

    def log_probabilities(self, ids: np.ndarray, ends: np.ndarray, within: np.ndarray | None = None, batch: int = 128, last: np.ndarray | None = None) -> np.ndarray:
        """Natural logarithms for every id, each scored once. within: of each id in its class, if known.

        last: the id before each, where that is not the one before it in ids; it is given that an id of a predicted class follows.
        """
        last = before(ids, ends, self.classes.end) if last is None else last
        windowed = in_windows(self.classes.into[last].astype(np.int16), ends, self.classes.inputs)
        wanted = in_windows(self.classes.out[ids].astype(np.int16), ends, -1)[:, STRIDE:]
        out = np.empty(wanted.shape, np.float32)
        for i in range(0, len(windowed), batch):
            c, y = windowed[i : i + batch].astype(np.int64), wanted[i : i + batch].ravel()
            cq = c[:, STRIDE:].ravel()
            z = _mix(c, self.v, self.heed, self.near)[-1]
            z += np.take(self.r, cq, axis=0)
            at = np.arange(len(y)) * self.p["o"].shape[1] + np.maximum(y, 0)
            _, total, picked = _exp_logits(np.maximum(z, 0, out=z), cq, self.p, at)
            out[i : i + batch] = (picked - np.log(total)).reshape(-1, STRIDE)
        return out[wanted >= 0] + (self.classes.within_class(last, ids) if within is None else within)


def _add(sums: np.ndarray, rows: np.ndarray, into: np.ndarray) -> None:
    """Adds rows to those of sums that they go to. Two numbers are added at once, as the parts of a complex one, where the width is even."""
    if rows.shape[1] % 2 == 0:
        sums, rows = (x.view(np.result_type(x.dtype, np.complex64)) for x in (sums, rows))
    width = rows.shape[1]
    np.add.at(sums.reshape(-1), ((into * width)[:, None] + np.arange(width)).ravel(), rows.reshape(-1))


def gradients(p: dict[str, np.ndarray], c: np.ndarray, y: np.ndarray, part: int = 128) -> tuple[float, dict[str, np.ndarray]]:
    """Mean loss (natural logarithms) of a batch of windows, and its gradient by every weight that is trained.

    Like scores, attention comes from a table of classes against classes; so does its gradient. part: windows at a time, so that what they need stays in the processor's cache.
    """
    size, d = p["e"].shape
    kind, outputs = p["e"].dtype.type, p["o"].shape[1]
    scale = kind(1 / np.sqrt(d))
    value, own, heed, near = _tables(p)
    n, loss, back_o = max(1, np.count_nonzero(y >= 0)), 0.0, np.ascontiguousarray(p["o"].T)
    of_heed, of_value, of_own = np.zeros(size * size, kind), np.zeros((size, d), kind), np.zeros((size, d), kind)
    of_near, of_o = np.zeros((STRIDE, WIDTH), kind), np.zeros_like(p["o"])
    for i in range(0, len(c), part):
        inputs, wanted = c[i : i + part], y[i : i + part].ravel()
        cq, valid = inputs[:, STRIDE:].ravel(), (wanted >= 0).astype(kind)
        pairs, w, share, v, z = _mix(inputs, value, heed, near)
        h = np.take(own, cq, axis=0)
        h += z
        np.maximum(h, 0, out=h)
        at = np.arange(len(wanted)) * outputs + np.maximum(wanted, 0)
        prob, total, picked = _exp_logits(h, cq, p, at)
        loss += float(valid @ (np.log(total) - picked)) / n
        valid /= n
        prob *= (valid / total)[:, None]
        prob.reshape(-1)[at] -= valid
        of_o += h.T @ prob
        gz = prob @ back_o
        gz *= h > 0
        _add(of_own, gz, cq)
        gz *= share[:, None]  # w is not normalised
        z *= gz
        by_window = gz.reshape(len(inputs), STRIDE, d)
        gs = by_window @ v.transpose(0, 2, 1)
        gs -= (z @ np.ones(d, kind)).reshape(len(inputs), STRIDE, 1)
        gs *= w
        of_near += gs.sum(0)
        np.add.at(of_heed, pairs.ravel(), gs.ravel())
        _add(of_value, (w.transpose(0, 2, 1) @ by_window).reshape(-1, d), inputs.ravel())
    near = np.bincount(_BACK[_SEEN], weights=of_near[_SEEN], minlength=WIDTH).astype(kind)
    of_heed = of_heed.reshape(size, size)
    of_heed[:, size - 1] = 0
    of_query, of_key = of_heed @ (p["e"] @ p["k"]) * scale, of_heed.T @ (p["e"] @ p["q"]) * scale
    e = p["e"].T
    out = {"o": of_o, "q": e @ of_query, "k": e @ of_key, "v": e @ of_value, "r": e @ of_own, "h": of_own.sum(0), "near": near}
    out["e"] = of_query @ p["q"].T + of_key @ p["k"].T + of_value @ p["v"].T + of_own @ p["r"].T
    return loss, out


def train(p: dict[str, np.ndarray], c: np.ndarray, y: np.ndarray, rate: float, rounds: int, seed: int, batch: int = 64) -> dict[str, np.ndarray]:
    """Adam on windows: c, input classes (windows x places, the last class where outside), y, output classes of the second stride (-1: outside).

    What follows a class whatever stands before it (b) is counted over the whole corpus, not trained.
    """
    # copies of numpy's own types: an unpickled array, as tasks get it, has another instance of its type, for which add.at has no fast way
    p = {k: np.add(v, 0, out=np.empty(v.shape, v.dtype.type)) for k, v in p.items()}
    names = [k for k in p if k != "b"]
    m, u, step, rng = {k: np.zeros_like(p[k]) for k in names}, {k: np.zeros_like(p[k]) for k in names}, 0, np.random.default_rng(seed)
    total = rounds * -(-len(c) // batch)
    for _ in range(rounds):
        order = rng.permutation(len(c))
        for i in range(0, len(c), batch):
            chosen = order[i : i + batch]
            _, grad = gradients(p, c[chosen].astype(np.int64), y[chosen].astype(np.int64))
            step += 1
            now = np.float32(rate * (1 - 0.9 * step / total))
            for name in names:
                m[name] = 0.9 * m[name] + 0.1 * grad[name]
                u[name] = 0.99 * u[name] + 0.01 * grad[name] ** 2
                p[name] -= now * (m[name] / np.float32(1 - 0.9**step)) / (np.sqrt(u[name] / np.float32(1 - 0.99**step)) + np.float32(1e-6))
    return p
