"""Language-model scoring by a log-bilinear model, trained with noise-contrastive estimation in numpy.

The vocabulary is every word whose share of the corpus is at least SHARE (and that occurs LEAST times); counts are of all texts.  Each other word
has the outcome of its last byte, and the rest of its spelling, from the end backwards, the probability of a byte-bigram model counted on all of
them, so that each word, seen or not, has a probability of its own and all add up to 1 at most.  A word is predicted from the CONTEXT words
before it: their vectors, weighted elementwise by position, add up to a predicted vector, whose products with the target vectors plus a
bias are the scores.  The HEAD most frequent outcomes are scored together with classes of all others (in order of frequency), then the
subclasses of a class among themselves, then the outcomes of a subclass, each level about as wide.  Training tells true outcomes from noise drawn
from the corpus's unigram distribution, at each level.  In each of `rounds` rounds, which share out the texts by hash, every partition trains on its
texts from the same start, and the changes of each row of parameters are averaged over the partitions by its uses; each text trains once.  The
result depends on how the table is split into partitions, as any averaged training does.  For scoring, batched matrix products give every
context its normaliser over the first level, and over the siblings of a word's subclass and outcome, so probabilities are exactly normalised.

The corpus's memory: after every triple of words, the outcomes that follow it in *other* documents are counted, in all of the corpus, and the
model is the prior of that count: P = (count + MU p) / (all + MU), which is normalised too.  (A caller may ask for one in `every` triples only, chosen
by hash.)  What is gathered for it grows with the corpus, and documents that occur elsewhere are scored apart.  Triples are sent in packed blocks to
buckets, ranges of their hashes of about _HELD triples, where all uses of a triple meet: some 60 bytes for each document that holds it.

Words are lower-cased runs of letters, digits and non-ASCII characters.

Defined cases: null, empty and wordless texts have 0 tokens, a null mean, perplexity and unknown share, and train nothing; texts without a triple that a word
follows have a null memory gain; repeated rows train and score each, and are each other's memory; ties in the vocabulary go to the smaller hash; a
corpus without words gives the start parameters; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import gc
import pickle

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import cut, written
from .textvec import NORM, Powers, grams, inside, slices, words

SHARE = 5e-7
LEAST = 2
HEAD = 96
WIDTH = 16
CONTEXT = 2
NOISE = 128
NEAR = 4  # noise outcomes of a group of siblings
BATCH = 2048
RATE = 0.15
BIAS = 0.1  # of the rate: biases start at the unigram distribution
START = 1e-8  # of Adagrad's sums
ROUNDS = 2
SEED = 3
EVERY = 1  # all triples
MU = 1.0
_SPELT = 256  # outcomes of words outside the vocabulary
_ROWS, _FAN = 4096, 128
_GRID = 1 << 20  # so that sums are exact, wherever in a column a text stands
_FINE = 1 << 12  # of log-probabilities that are sent
_HELD = 1 << 21  # words of a chunk of texts, and about those of a bucket of triples


class Model:
    """Parameters: context vectors (one more for the text's start), position weights, target vectors and biases, spelling counts.

    Outcomes are the words of the vocabulary in order of frequency, then the last bytes of others.  Target rows are those of the first level
    (`head` outcomes, then classes), then those of subclasses, then those of the outcomes in them.
    """

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, width: int, seed: int, head: int = HEAD) -> None:
        """counts: of the words, then of the _SPELT last bytes."""
        self.order = np.argsort(hashes).astype(np.int32)
        self.sorted = hashes[self.order]
        self.table = None
        self.words = len(hashes)
        self.uses = int(counts.sum())
        self.size = self.words + _SPELT
        self.head = min(head, self.size)
        tail = self.size - self.head
        self.each = max(2, int(np.ceil(max(1, tail) ** (1 / 3))))
        self.subs = -(-tail // self.each)
        self.top = self.head - (-self.subs // self.each)
        rng = np.random.default_rng(seed)
        noise = np.maximum(counts.astype(float), 0.5)
        self.noise = noise / noise.sum()
        deep = self.noise[self.head :]
        sub = np.bincount(np.arange(tail) // self.each, deep, self.subs)
        self.first = np.concatenate([self.noise[: self.head], np.bincount(np.arange(self.subs) // self.each, sub, self.top - self.head)])
        self.inner = [sub / self.first[self.head + np.arange(self.subs) // self.each], deep / sub[np.arange(tail) // self.each]]  # of siblings, by level
        self.r = rng.normal(0, 0.1, (self.size + 1, width)).astype(np.float32)
        self.q = rng.normal(0, 0.1, (self.top + self.subs + tail, width)).astype(np.float32)
        self.c = np.full((CONTEXT, width), 1.0, np.float32)
        self.b = np.log(np.concatenate([self.first, *self.inner])).astype(np.float32)
        self.spelt = np.zeros(1 << 16)

    def outcomes(self, ids: np.ndarray) -> np.ndarray:
        """The first level's outcome of each id: itself, or its class."""
        return np.where(ids < self.head, ids, self.head + (ids - self.head) // (self.each * self.each))

    def levels(self, ids: np.ndarray):
        """For each level below the first: (place of its rows, the item of each id beyond the head, number of items)."""
        w = ids - self.head
        return (self.top, w // self.each, self.subs), (self.top + self.subs, w, self.size - self.head)

    def spelling(self) -> np.ndarray:
        """Log-probability of the byte before another in a word outside the vocabulary; 0 stands for the word's start."""
        n = self.spelt.reshape(256, 256) + 0.1
        return np.log(n / n.sum(1, keepdims=True)).ravel()

    def ids(self, h: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Outcomes of words by their hash and last byte."""
        out = self.words + last.astype(np.int32)
        if not len(self.sorted):
            return out
        bits = max(1, self.words.bit_length())
        if self.table is None:  # where hashes with each value of their leading bits begin: a search in few places, without a miss of the cache a step
            begin = np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
            self.table = np.append(np.searchsorted(self.sorted, begin), self.words).astype(np.int32)
        key = (h >> np.uint64(64 - bits)).astype(np.int64)
        at, end = self.table.take(key), self.table.take(key + 1)
        left = np.flatnonzero(at < end)
        while len(left):
            here = at[left]
            hit = self.sorted.take(here) == h[left]
            out[left[hit]] = self.order.take(here[hit])
            left = left[~hit]
            at[left] += 1
            left = left[at[left] < end[left]]
        return out

    def stream(self, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(all texts one after the other, each behind CONTEXT starts; the place of each word in it)."""
        n = np.diff(first)
        place = np.arange(len(ids)) + CONTEXT * (1 + np.repeat(np.arange(len(n)), n))
        out = np.full(len(ids) + CONTEXT * len(n), self.size, np.int32)
        out[place] = ids
        return out, place


class Trainer:
    """Adagrad on the noise-contrastive objective; noise is shared by a batch's words, and below the first level by those of a group of siblings."""

    def __init__(self, model: Model, seed: int) -> None:
        self.m, self.rng = model, np.random.default_rng(seed)
        self.sum = {k: np.full(getattr(model, k).shape, START, np.float32) for k in "rqcb"}
        self.used = {k: np.zeros(len(getattr(model, k))) for k in "rq"}
        self.log_noise = np.log(np.concatenate([NOISE * model.first, *(NEAR * x for x in model.inner)])).astype(np.float32)
        self.edges = np.cumsum(model.first)
        self.near = [np.cumsum(x) for x in (np.bincount(np.arange(model.size - model.head) // model.each, model.noise[model.head :], model.subs), model.noise[model.head :])]

    def _step(self, name: str, row, grad: np.ndarray) -> None:
        p, s = getattr(self.m, name), self.sum[name]
        new = grad * grad
        new += s.take(row, axis=0)  # several times faster than s[row]
        s[row] = new
        np.sqrt(new, out=new)
        np.divide(grad, new, out=new)
        new *= -RATE * (BIAS if name == "b" else 1)
        new += p.take(row, axis=0)
        p[row] = new

    def _rows(self, at: np.ndarray, weights: np.ndarray, grad: np.ndarray) -> None:
        """A step of target rows, with the gradients (of vectors, last of biases) of equal rows summed."""
        order = np.argsort(at, kind="stable")
        at = at[order]
        begin = np.flatnonzero(_new(at))
        row = at[begin]
        self.used["q"][row] += np.add.reduceat(weights[order], begin)
        grad = _sums(grad.take(order, axis=0), begin)
        self._step("q", row, grad[:, :-1])
        self._step("b", row, grad[:, -1])

    def _level(self, base: int, x: np.ndarray, size: int, near: np.ndarray, one: np.ndarray, n: int, noise=None):
        """Items x, in order, after predicted vectors (and a 1 behind each), against noise from their siblings (or the given noise): (rows, their weights, gradients, what goes
        back to the vectors)."""
        m, hat = self.m, one[:, :-1]
        begin = np.flatnonzero(_new(x))
        at = base + x
        qt = m.q.take(at, axis=0)
        gp = _pull(np.einsum("ij,ij->i", hat, qt) + (m.b.take(at) - self.log_noise.take(at)), n)[:, None]
        qt *= gp
        pulled = _sums(gp * one, begin)
        if noise is not None:
            other, qn = noise, m.q.take(noise, axis=0)
            gn = hat @ qn.T
            gn += m.b[noise] - self.log_noise[noise]
            gn = _push(gn, n)
            qt += gn @ qn
            pushed = gn.T @ one
        else:
            group = x // m.each
            start = np.flatnonzero(_new(group))
            g = group[start]
            lo, hi = g * m.each, np.minimum((g + 1) * m.each, size) - 1
            low = np.where(lo > 0, near[lo - 1], 0)
            u = low[:, None] + np.sort(self.rng.random((len(g), NEAR)), axis=1) * (near[hi] - low)[:, None]  # neighbours in memory one after the other
            other = np.clip(np.searchsorted(near, u), lo[:, None], hi[:, None])
            at = base + other
            run = np.repeat(np.arange(len(g)), _lengths(start, len(x)))
            qn = m.q.take(at, axis=0).take(run, axis=0)
            gn = np.einsum("ij,ikj->ik", hat, qn)
            gn += (m.b.take(at) - self.log_noise.take(at)).take(run, axis=0)
            gn = _push(gn, n)[:, :, None]
            qn *= gn
            for k in range(NEAR):
                qt += qn[:, k]
            pushed = _sums((gn * one[:, None]).reshape(len(x), -1), start).reshape(-1, one.shape[1])
            other = other.ravel()
        weights = np.ones(len(begin) + len(other))
        weights[: len(begin)] = _lengths(begin, len(x))
        return base + np.concatenate([x[begin], other]), weights, np.concatenate([pulled, pushed]), qt

    def batch(self, s: np.ndarray) -> None:
        """A stretch of the stream: words from place CONTEXT on are targets, starts excepted."""
        m = self.m
        order = np.argsort(s, kind="stable")
        sorted_ = s[order]
        vec = m.r.take(s, axis=0)
        one = np.ones((len(s) - CONTEXT, vec.shape[1] + 1), vec.dtype)
        one[:, :-1] = sum(vec[CONTEXT - 1 - j : len(s) - 1 - j] * m.c[j] for j in range(CONTEXT))
        mine = order[(sorted_ < m.size) & (order >= CONTEXT)]
        n = len(mine)
        if not n:
            return
        target, h = s[mine], one.take(mine - CONTEXT, axis=0)
        drawn = np.minimum(np.searchsorted(self.edges, self.rng.random(NOISE)), m.top - 1)
        parts = [self._level(0, m.outcomes(target), m.top, self.edges, h, n, drawn)]
        dh = parts[0][3]
        deep = int(np.searchsorted(target, m.head))
        if deep < n:
            for (base, x, size), near in zip(m.levels(target[deep:]), self.near):
                parts.append(self._level(base, x, size, near, h[deep:], n))
                dh[deep:] += parts[-1][3]
        at, weights, grad = (np.concatenate([p[i] for p in parts]) for i in range(3))
        back = np.zeros((len(one), vec.shape[1]), vec.dtype)
        back[mine - CONTEXT] = dh
        dvec = np.zeros_like(vec)
        for j in range(CONTEXT):
            dvec[CONTEXT - 1 - j : len(s) - 1 - j] += back * m.c[j]
        dc = np.stack([np.einsum("ij,ij->j", back, vec[CONTEXT - 1 - j : len(s) - 1 - j]) for j in range(CONTEXT)])
        self._rows(at, weights, grad)
        begin = np.flatnonzero(_new(sorted_))
        row = sorted_[begin]
        self.used["r"][row] += _lengths(begin, len(s))
        self._step("r", row, _sums(dvec.take(order, axis=0), begin))
        self._step("c", np.arange(CONTEXT), dc)

    def texts(self, ids: np.ndarray, first: np.ndarray, batch_words: int) -> None:
        """One pass over texts, in batches of `batch_words` words, in random order."""
        s, _ = self.m.stream(ids, first)
        with np.errstate(over="ignore"):
            for i in self.rng.permutation(-(-max(0, len(s) - CONTEXT) // batch_words)) * batch_words:
                self.batch(s[i : i + batch_words + CONTEXT])


def _new(*sorted_: np.ndarray) -> np.ndarray:
    """Whether a tuple of values differs from the one before."""
    out = np.ones(len(sorted_[0]), bool)
    out[1:] = sorted_[0][1:] != sorted_[0][:-1]
    for x in sorted_[1:]:
        out[1:] |= x[1:] != x[:-1]
    return out


def _lengths(begin: np.ndarray, n: int) -> np.ndarray:
    """Of the runs of n values that begin there."""
    out = np.empty(len(begin), np.int64)
    out[:-1] = begin[1:] - begin[:-1]
    out[-1:] = n - begin[-1:]
    return out


def _sums(x: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """add.reduceat along the first axis.  That takes its time for each column of each run, so runs of one row, if they are many, are taken as they are."""
    n = _lengths(begin, len(x))
    more = np.flatnonzero(n > 1)
    if 2 * len(more) > len(begin):
        return np.add.reduceat(x, begin, axis=0)
    out, n = x.take(begin, axis=0), n[more]
    if len(more):
        first = np.cumsum(n) - n
        out[more] = np.add.reduceat(x.take(np.arange(n.sum()) + np.repeat(begin[more] - first, n), axis=0), first, axis=0)
    return out


def _pull(score: np.ndarray, n: int) -> np.ndarray:
    """d loss / d score of true words."""
    np.exp(score, out=score)
    score += 1
    return np.divide(-1 / n, score, out=score)


def _push(score: np.ndarray, n: int) -> np.ndarray:
    """d loss / d score of noise words."""
    np.negative(score, out=score)
    np.exp(score, out=score)
    score += 1
    return np.divide(1 / n, score, out=score)


def _runs(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(an order that brings equal indices together, where each distinct one begins in it)."""
    order = np.argsort(at, kind="stable")
    return order, np.flatnonzero(np.diff(at[order], prepend=-1))


def _spelt(v: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes of each byte of words in text v with the one before it, 0 before the first; each word's first place in them)."""
    n = ends - starts
    begin = np.cumsum(n) - n
    at = np.arange(n.sum()) + np.repeat(starts - begin, n)
    before = v[at - 1].astype(np.int64)
    before[begin] = 0
    return v[at].astype(np.int64) * 256 + before, begin


def _lse(s: np.ndarray) -> np.ndarray:
    """log(sum(exp)) of each row; s is overwritten.  Rows are brought to their largest first only if single precision may not hold the sum."""
    top = np.float32(0) if not s.size or s.max() < 60 else s.max(1, keepdims=True)
    if top.ndim:
        s -= top
    else:
        low = np.flatnonzero(s[:, 0] < -40)
        low = low[s[low].max(1) < -40]
        if len(low):
            top = np.zeros((len(s), 1), np.float32)
            top[low] = s[low].max(1, keepdims=True)
            s -= top
    np.exp(s, out=s)
    return np.log(s @ np.ones(s.shape[1], np.float32)) + (top[:, 0] if top.ndim else top)


def log_probs(m: Model, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Of the outcome of every word of texts; row r has ids[first[r]:first[r + 1]]."""
    s, place = m.stream(ids, first)
    ctx = [s[place - 1 - j] for j in range(CONTEXT)]
    code = ctx[0].astype(np.int64)
    for x in ctx[1:]:
        code = code * (m.size + 1) + x
    order = _order(code.view(np.uint64))
    new = _new(code[order])
    one, inv = order[new], np.empty(len(ids), np.int64)
    inv[order] = np.cumsum(new) - 1
    hat = np.ones((len(one), m.r.shape[1] + 1), m.r.dtype)  # of distinct contexts, with a 1 for the bias
    hat[:, :-1] = sum(m.r.take(ctx[j][one], axis=0) * m.c[j] for j in range(CONTEXT))
    norm, step = np.empty(len(one), np.float32), max(1, (1 << 18) // m.top)
    first_level = np.column_stack([m.q[: m.top], m.b[: m.top]]).T.copy()
    for i in range(0, len(one), step):
        norm[i : i + step] = _lse(hat[i : i + step] @ first_level)
    hat = hat[:, :-1].copy()
    out = m.outcomes(ids)
    lp = np.einsum("ij,ij->i", hat.take(inv, axis=0), m.q.take(out, axis=0)) + m.b[out] - norm[inv]
    deep = np.flatnonzero(ids >= m.head)
    deep = deep[_order(ids[deep].astype(np.uint64))]
    h = hat.take(inv[deep], axis=0)
    for base, x, size in m.levels(ids[deep]):
        group = x // m.each
        biases = np.full((-(-size // m.each), m.each), -np.inf, np.float32)
        biases.ravel()[:size] = m.b[base : base + size]
        more = np.einsum("ij,ij->i", h, m.q.take(base + x, axis=0)) + m.b[base + x]
        for k in range(0, len(x), 4096):
            own = group[k : k + 4096]
            scores = np.zeros((len(own), m.each), np.float32)
            begin = np.flatnonzero(_new(own))
            for i, j, g in zip(begin.tolist(), np.append(begin[1:], len(own)).tolist(), own[begin].tolist()):
                lo, hi = g * m.each, min((g + 1) * m.each, size)
                scores[i:j, : hi - lo] = h[k + i : k + j] @ m.q[base + lo : base + hi].T
            scores += biases.take(own, axis=0)
            more[k : k + 4096] -= _lse(scores)
        lp[deep] += more
    return lp


def _counter(batches):
    pw, held, size = Powers(), [], 0

    def merged(parts):
        h, one, inv = np.unique(np.concatenate([p[0] for p in parts]), return_index=True, return_inverse=True)
        return h, np.bincount(inv, np.concatenate([p[1] for p in parts]), len(h)).astype(np.int64), np.concatenate([p[2] for p in parts])[one]

    def rows(part):
        return pa.RecordBatch.from_arrays([pa.array(part[0].view(np.int64)), pa.array(part[1]), pa.array(part[2].astype(np.int16))], ["hash", "n", "last"])

    for batch in batches:
        for _, data, off in slices(batch.column(0)):
            h, _, ends, _ = words(data, off, NORM, pw)
            h, one, n = np.unique(h, return_index=True, return_counts=True)
            held.append((h, n, NORM[data[ends[one] - 1]]))
            size += len(h)
            if size > 4_000_000:
                held = [merged(held)]
                if len(held[0][0]) > 2_000_000:
                    yield rows(held[0])
                    held = []
                size = sum(len(p[0]) for p in held)
    if held:
        yield rows(merged(held))


def _lowered(docs: DataFrame, *more) -> DataFrame:
    return docs.select(*more, F.lower(F.col("text").cast("string")).alias("text"))


def vocabulary(docs: DataFrame, share: float = SHARE, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the words of at least `share` of the corpus and `least` uses, most frequent first; their counts, then those of other words by last byte).

    There are at most 1 / share such words, so what the driver holds is bounded.
    """
    counts = cut(_lowered(docs).mapInArrow(_counter, "hash long, n long, last short").groupBy("hash").agg(F.sum("n").alias("n"), F.max("last").alias("last")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    enough = F.col("n") >= max(least, share * total)
    top = counts.where(enough).select("hash", "n").toArrow()
    h, n = (top.column(x).to_numpy() for x in ("hash", "n"))
    order = np.lexsort((h, -n))
    other = np.zeros(_SPELT, np.int64)
    for r in counts.where(~enough).groupBy("last").agg(F.sum("n").alias("n")).collect():
        other[r["last"]] = r["n"]
    return h[order].view(np.uint64), np.concatenate([n[order], other]).astype(np.int64)


def _packed(kind: str, rows: np.ndarray, weights: np.ndarray, values: np.ndarray, fan: int):
    """Rows of parameters' changes in blocks, for _average; half precision is precise enough for a change."""
    for block in np.unique(rows // _ROWS):
        at = slice(*np.searchsorted(rows, [block * _ROWS, (block + 1) * _ROWS]))
        yield kind, int(block), fan, rows[at].astype("<i4").tobytes(), weights[at].astype("<f4").tobytes(), values[at].astype("<f2").tobytes()


def _ids(model: Model, data: np.ndarray, off: np.ndarray, pw: Powers):
    """(hashes, ids, starts, ends, first) of a slice's words."""
    h, starts, ends, first = words(data, off, NORM, pw)
    return h, model.ids(h, NORM[data[ends - 1]]), starts, ends, first


def _trainer(shared, turn: int, passes: int, batch_words: int, seed: int):
    def run(batches):
        from pyspark import TaskContext

        model, part = pickle.loads(shared.value), TaskContext.get().partitionId()
        trainer, pw, trained, spelt = Trainer(model, seed + 1000 * turn + part), Powers(), 0, np.zeros(1 << 16)
        for batch in batches:
            for _, data, off in slices(batch.column(0)):
                _, ids, starts, ends, first = _ids(model, data, off, pw)
                rare = ids >= model.words
                spelt += np.bincount(_spelt(NORM[data], starts[rare], ends[rare])[0], minlength=1 << 16)
                for _ in range(passes):
                    trainer.texts(ids, first, batch_words)
                trained += len(ids)
        if trained:
            fan, used = part // _FAN, {k: np.flatnonzero(v) for k, v in trainer.used.items()}
            r, q, s, was = used["r"], used["q"], np.flatnonzero(spelt), pickle.loads(shared.value)
            for some in (
                _packed("r", r, trainer.used["r"][r], model.r[r] - was.r[r], fan),
                _packed("q", q, trainer.used["q"][q], np.column_stack([model.q[q] - was.q[q], model.b[q] - was.b[q]]), fan),
                _packed("c", np.arange(CONTEXT), np.full(CONTEXT, float(trained)), model.c - was.c, fan),
                _packed("s", s, spelt[s], np.zeros((len(s), 0)), fan),
            ):
                for row in some:
                    yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))], ["kind", "block", "fan", "rows", "weights", "data"])

    return run


def _average(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["rows", "weights", "data"])  # the same sum in whatever order rows came
    rows, weights = np.concatenate([np.frombuffer(x, "<i4") for x in pdf["rows"]]), np.concatenate([np.frombuffer(x, "<f4") for x in pdf["weights"]]).astype(float)
    data = np.concatenate([np.frombuffer(x, "<f2") for x in pdf["data"]]).astype(float)
    data = data.reshape(len(rows), len(data) // len(rows)) * weights[:, None]
    order, begin = _runs(rows)
    data, weights = (np.add.reduceat(x[order], begin, axis=0) for x in (data, weights))
    (got,) = _packed(key[0], rows[order[begin]], weights, data / weights[:, None], 0)
    return pd.DataFrame([got], columns=["kind", "block", "fan", "rows", "weights", "data"])


def _release(docs: DataFrame) -> None:
    """Let Spark remove the shuffles that nothing refers to, so that a round's don't lie beside the next one's; it does so when the driver collects garbage."""
    gc.collect()
    docs.sparkSession.sparkContext._jvm.System.gc()


def train(docs: DataFrame, share: float = SHARE, width: int = WIDTH, rounds: int = ROUNDS, passes: int = 1, batch_words: int = BATCH, seed: int = SEED, least: int = LEAST, head: int = HEAD) -> Model:
    """A model of all of docs; each partition goes over its texts `passes` times, in batches of `batch_words` words."""
    model = Model(*vocabulary(docs, share, least), width, seed, head)
    schema = "kind string, block int, fan int, rows binary, weights binary, data binary"
    for turn in range(rounds):
        shared = docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps(model))
        texts = docs.select(F.col("text").cast("string").alias("text")).where(F.pmod(F.xxhash64("text"), F.lit(rounds)) == turn)
        local = _lowered(texts).mapInArrow(_trainer(shared, turn, passes, batch_words, seed), schema)
        for r in local.groupBy("kind", "block", "fan").applyInPandas(_average, schema).groupBy("kind", "block").applyInPandas(_average, schema).collect():
            at, data = np.frombuffer(r["rows"], "<i4"), np.frombuffer(r["data"], "<f2").astype(np.float32).reshape(len(r["rows"]) // 4, -1) if r["data"] else None
            if r["kind"] == "s":
                model.spelt[at] += np.frombuffer(r["weights"], "<f4")
            elif r["kind"] == "q":
                model.q[at] += data[:, :-1]
                model.b[at] += data[:, -1]
            else:
                getattr(model, r["kind"])[at] += data
        shared.destroy()
        local = None
        _release(docs)
    return model


def _order(k: np.ndarray) -> np.ndarray:
    """A stable order of uint64 values, from a sort of their leading bits with places below, faster than argsort; ties of these bits are put right."""
    if len(k) < 2:
        return np.arange(len(k))
    bits = np.uint64(len(k).bit_length())
    x = k - k.min()
    x <<= np.uint64(min(63, 64 - int(x.max()).bit_length()))
    x >>= bits
    x <<= bits
    x |= np.arange(len(k), dtype=np.uint64)
    x.sort()
    order = (x & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    x >>= bits
    got = k[order]
    wrong = np.unique(x[1:][got[1:] < got[:-1]])
    for i, j in zip(np.searchsorted(x, wrong).tolist(), np.searchsorted(x, wrong, "right").tolist()):
        order[i:j] = order[i:j][np.argsort(got[i:j], kind="stable")]
    return order


def _pack(*arrays: np.ndarray) -> bytes:
    """Equally long arrays of non-negative integers, byte by byte, as high bytes compress; without the leading bytes that are 0 in all."""
    out = []
    for x in arrays:
        x = np.ascontiguousarray(x, "<u8")
        wide = (int(x.max()).bit_length() + 7) // 8 if len(x) else 0
        out.append(b"".join(x.view(np.uint8)[k::8].tobytes() for k in range(wide)))
    whole = b"".join(out)
    return pickle.dumps((len(arrays[0]), [len(x) for x in out], pa.Codec("zstd", compression_level=1).compress(whole, asbytes=True)))


def _unpack(data: bytes) -> list[np.ndarray]:
    n, sizes, whole = pickle.loads(data)
    whole, at, out = np.frombuffer(pa.Codec("zstd").decompress(whole, sum(sizes)), np.uint8), 0, []
    for size in sizes:
        full = np.zeros((n, 8), np.uint8)
        for k in range(size // n if size else 0):
            full[:, k] = whole[at + k * n : at + (k + 1) * n]
        at += size
        out.append(full.view("<u8").ravel())
    return out


def _triples(h: np.ndarray, ids: np.ndarray, first: np.ndarray, lp: np.ndarray, every: int, pw: Powers):
    """Triples that a word follows, one in `every` of them: (row, triple's hash, outcome, its log-probability in negative steps of 1 / _FINE)."""
    g = grams(h, 3, pw)
    ok = inside(first, 4, len(h)) if len(h) > 3 else np.zeros(0, bool)
    if every > 1:
        ok &= g[: len(ok)] % np.uint64(every) == 0
    at = np.flatnonzero(ok)
    row = np.repeat(np.arange(len(first) - 1, dtype=np.uint32), np.diff(first))[at]
    return row, g[at], ids[at + 3].astype(np.uint32), np.rint(np.maximum(-lp[at + 3], 0) * _FINE).astype(np.uint32)


_SENT = "bucket long, chunk long, data binary"


def _sent(*rows) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary()))], ["bucket", "chunk", "data"])


def _chunk(name: int, found: list, buckets: int):
    """What is sent of a chunk of texts: a bucket of its own (below 0) with its rows, and its triples by ranges of their hashes."""
    doc_id, tokens, lps, unknown, *_ = zip(*found)
    base = np.cumsum([0, *map(len, tokens)])
    row, key, out, lp = (np.concatenate([f[k] + base[i].astype(np.uint32) if k == 4 else f[k] for i, f in enumerate(found)]) for k in range(4, 8))
    yield _sent((-1 - name, name, pickle.dumps((pa.concat_arrays(doc_id), *map(np.concatenate, (tokens, lps, unknown)), np.bincount(row, minlength=base[-1])))))
    order = _order(key)
    row, key, out, lp = row[order], key[order], out[order], lp[order]
    begin = np.flatnonzero(_new(key, row, out))  # repeated lines send one
    n = np.diff(begin, append=len(key)) - 1
    row, key, out, lp = row[begin], key[begin], out[begin], lp[begin]
    bucket = ((key >> np.uint64(40)) * np.uint64(buckets)) >> np.uint64(24)
    edge = np.flatnonzero(_new(bucket))
    for i, j in zip(edge.tolist(), np.append(edge[1:], len(key)).tolist()):
        yield _sent((int(bucket[i]), name, _pack(np.diff(key[i:j], prepend=np.uint64(0)), row[i:j], out[i:j], lp[i:j], n[i:j])))


def _scored(shared, every: int, buckets: int):
    def run(batches):
        from pyspark import TaskContext

        model, name = pickle.loads(shared.value), TaskContext.get().partitionId() << 32
        pw, spelling, found, held = Powers(), model.spelling(), [], 0
        for batch in batches:
            for i, data, off in slices(batch.column(1), 2 << 20):
                h, ids, starts, ends, first = _ids(model, data, off, pw)
                lp = log_probs(model, ids, first).astype(float)
                triples = _triples(h, ids, first, lp, every, pw)
                rare = ids >= model.words
                if rare.any():
                    codes, begin = _spelt(NORM[data], starts[rare], ends[rare])
                    lp[rare] += np.add.reduceat(spelling[codes], begin)
                c = np.concatenate([[0.0], np.cumsum(np.rint(lp * _GRID) / _GRID)])
                u = np.concatenate([[0], np.cumsum(rare)])
                found.append((batch.column(0).slice(i, len(first) - 1), np.diff(first), c[first[1:]] - c[first[:-1]], u[first[1:]] - u[first[:-1]], *triples))
                held += len(ids) + len(first)
                if held > _HELD:
                    yield from _chunk(name, found, buckets)
                    name, found, held = name + 1, [], 0
        if found:
            yield from _chunk(name, found, buckets)

    return run


def _met(mu: float):
    """Of one bucket: what other rows' uses of its triples add to each row, summed by chunk.  Exact: all uses of a triple are in one bucket."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        if key[0].as_py() < 0:
            return table
        chunks, parts = table.column("chunk").to_numpy(), [_unpack(x) for x in table.column("data").to_pylist()]
        of = np.argsort(chunks)
        h = np.concatenate([np.cumsum(parts[i][0]) for i in of])
        order = _order(h)
        new = _new(h[order])
        again = ~new
        again[:-1] |= ~new[1:]
        order = order[again]  # of triples with several entries only
        doc = np.concatenate([parts[i][1] + np.uint64(k << 32) for k, i in enumerate(of)])[order]
        out, lp, n = (np.concatenate([parts[i][k] for i in of])[order] for k in (2, 3, 4))
        n = n.astype(np.int64) + 1
        new = new[again]
        triple = np.cumsum(new) - 1
        own = _new(triple, doc)  # rows of a triple are in order, as chunks and places in them are
        several = np.bincount(triple[own]) > 1
        total = np.bincount(triple, n).astype(np.int64)[triple] - np.bincount(np.cumsum(own) - 1, n).astype(np.int64)[np.cumsum(own) - 1]
        keep = several[triple]
        triple, doc, out, lp, n, total = (x[keep] for x in (triple, doc, out, lp, n, total))
        if not len(n):
            return table.slice(0, 0)
        pair = triple.astype(np.uint64) << np.uint64(32) | out
        order = _order(pair)
        pair, doc, lp, n, total = (x[order] for x in (pair, doc, lp, n, total))
        same, mine = np.cumsum(_new(pair)) - 1, np.cumsum(_new(pair, doc)) - 1
        both = np.bincount(same, n)[same] - np.bincount(mine, n)[mine]
        lp = lp.astype(float) / -_FINE
        gain = np.rint(n * (np.log(both + mu * np.exp(lp)) - np.log(total + mu) - lp) * _GRID)
        order = _order(doc)
        doc = doc[order]
        begin = np.flatnonzero(_new(doc))
        gain = np.add.reduceat(gain[order], begin).astype(np.int64)
        doc, gain = doc[begin], (gain << 1 ^ gain >> 63).view(np.uint64)
        edge = np.flatnonzero(_new(doc >> np.uint64(32)))
        ends = np.append(edge[1:], len(doc)).tolist()
        return pa.Table.from_batches([_sent(*((0, int(chunks[of[int(doc[i]) >> 32]]), _pack(doc[i:j] & np.uint64((1 << 32) - 1), gain[i:j])) for i, j in zip(edge.tolist(), ends)))])

    return run


def _settled(key: tuple, table: pa.Table) -> pa.Table:
    """The rows of a chunk with what the buckets add to them."""
    data, bucket = table.column("data").to_pylist(), table.column("bucket").to_numpy()
    doc_id, tokens, lp, unknown, uses = pickle.loads(data[int(np.flatnonzero(bucket < 0)[0])])
    gain = np.zeros(len(tokens))
    for x, b in zip(data, bucket):
        if b >= 0:
            row, more = _unpack(x)
            gain[row.astype(np.int64)] += (more >> np.uint64(1)).astype(np.int64) ^ -(more & np.uint64(1)).astype(np.int64)
    return pa.table([doc_id.cast(pa.int64()), *(pa.array(x.astype(t)) for x, t in zip((tokens, lp, unknown, uses, gain / _GRID), (np.int32, float, np.int32, np.int32, float)))], ["doc_id", "tokens", "model_log_prob", "unknown", "uses", "gain"])


def scores(docs: DataFrame, model: Model, every: int = EVERY, mu: float = MU) -> DataFrame:
    """One row a row of docs: doc_id, tokens, log_prob (natural, of all tokens, with the memory of other documents), mean_log_prob, perplexity, model_log_prob
    (without the memory), unknown_share (of words outside the vocabulary) and memory_gain (mean log-probability that the memory adds after a triple)."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(cloudpickle.dumps(model))
    slim = _lowered(docs, F.col("doc_id").cast("long").alias("doc_id"))
    buckets = min(1 << 24, max(int(spark.conf.get("spark.sql.shuffle.partitions")), model.uses // _HELD))
    sent = slim.mapInArrow(_scored(shared, every, buckets), _SENT)
    met = written(sent.groupBy("bucket").applyInArrow(_met(mu), _SENT), "lblm-scores")  # a few bytes a document: no action scores again
    rows = met.groupBy("chunk").applyInArrow(_settled, "doc_id long, tokens int, model_log_prob double, unknown int, uses int, gain double")
    some = lambda x: F.when(F.col("tokens") > 0, x)
    total = F.col("model_log_prob") + F.col("gain")
    return rows.select(
        "doc_id", "tokens", total.alias("log_prob"), some(total / F.col("tokens")).alias("mean_log_prob"), some(F.exp(-total / F.col("tokens"))).alias("perplexity"), "model_log_prob",
        some(F.col("unknown") / F.col("tokens")).alias("unknown_share"), F.when(F.col("uses") > 0, F.col("gain") / F.col("uses")).alias("memory_gain"),
    )
