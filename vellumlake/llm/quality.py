"""Quality rules by isolation forest: documents whose rule statistics are easy to isolate are rejected.

Rule statistics (shares of symbols, capitals, digits, repeated words, lines and so on) are taken from each whole text.  A forest
of random axis-parallel splits is grown on the good rows in a bounded sample of the labelled rows (`fit_rows`, taken by the
hash of doc_id).  A statistic enters as its excess: how far it lies beyond the usual spread of good rows, shrunk for short texts,
whose shares scatter more.  A document's mean path length over the trees gives its anomaly score 2 ** (-path / c).  The threshold
is the score that best separates the labelled good from the labelled bad rows of that sample, among those that
reject at most `good_loss` of the good ones.

Defined cases: a null, empty or wordless text has no statistics, score 1, and is rejected; repeated rows get equal scores; labels
of null quality or doc_id, and of absent documents, are ignored, and of a doc_id with several labels the least quality counts;
without labelled good rows the forest has no sample and every text with a word is kept (score 0); without labelled bad rows the
threshold is the largest good score; extra columns pass through the filter; an empty table gives an empty result.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import free_name
from .textvec import PART, PLAIN, Powers, grams, inside, mix, slices, words

TREES = 200
SUBSAMPLE = 256
FIT_ROWS = 20_000
GOOD_LOSS = 0.005
SEED = 20
STEADY_WORDS = 30
STATS = ["letters", "capitals", "symbols", "bars", "digits", "word_length", "short_words", "repeats", "top_word", "distinct", "same_grams", "same_lines"]

_CLASS = np.zeros(256, np.uint8)  # 0: continuation bytes of a character
for _b in range(256):
    _c = chr(_b)
    _CLASS[_b] = 6 if _b >= 192 else 0 if _b >= 128 else 1 if _c.islower() else 2 if _c.isupper() else 3 if _c.isdigit() else 4 if _c in "#$%&*@^~<>{}[]\\_=+!" else 5 if _c == "|" else 7 if _c.isspace() else 8


def _per_row(first: np.ndarray, x: np.ndarray) -> np.ndarray:
    c = np.concatenate([[0], np.cumsum(x)])
    return c[first[1:]] - c[first[:-1]]


def _duplicates(row: np.ndarray, h: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By row: distinct values, values beyond a first one, and the most frequent value's count."""
    if not len(h):
        z = np.zeros(rows, np.int64)
        return z, z, z
    key = np.sort((h & np.uint64((1 << 40) - 1)) | (row.astype(np.uint64) << np.uint64(40)))  # rows of a slice are few
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    n = np.diff(np.concatenate([at, [len(key)]]))
    r = (key[at] >> np.uint64(40)).astype(np.int64)
    top = np.zeros(rows, np.int64)
    np.maximum.at(top, r, n)
    return np.bincount(r, minlength=rows), np.bincount(r, weights=n - 1, minlength=rows), top


def statistics(data: np.ndarray, off: np.ndarray, pw: Powers) -> tuple[np.ndarray, np.ndarray]:
    """(word counts, statistics: one line a row, columns STATS)."""
    rows = len(off) - 1
    if rows == 1:  # perhaps very long
        cls = sum(np.bincount(_CLASS[data[i : i + PART]], minlength=9) for i in range(0, max(1, len(data)), PART)).reshape(1, 9).astype(float)
    else:
        of = np.repeat(np.arange(rows), np.diff(off))
        cls = np.bincount(of * 9 + _CLASS[data], minlength=rows * 9).reshape(rows, 9).astype(float)
    h, starts, ends, first = words(data, off, PLAIN, pw)
    n = np.diff(first)
    wrow = np.repeat(np.arange(rows), n)
    letters = cls[:, 1] + cls[:, 2] + cls[:, 6]
    chars = np.maximum(1, cls[:, 1:].sum(1) - cls[:, 7])
    some = np.maximum(1, n)
    same = np.concatenate([[False], (h[1:] == h[:-1]) & (wrow[1:] == wrow[:-1])]) if len(h) else np.zeros(0, bool)
    distinct, _, top = _duplicates(wrow, h, rows)
    g, ok = grams(h, 4, pw), inside(first, 4, len(h))
    at = np.flatnonzero(ok)
    _, again, _ = _duplicates(wrow[at], g[at], rows)
    # lines: a word that follows a line break begins one; its hash is that of its words
    brk = np.concatenate([np.zeros(1, np.int32), np.cumsum(data == 10, dtype=np.int32)])
    fresh = np.concatenate([[True], (wrow[1:] != wrow[:-1]) | (brk[starts[1:]] != brk[starts[:-1]])]) if len(h) else np.zeros(0, bool)
    begin = np.flatnonzero(fresh)
    if len(begin):
        spot = np.arange(len(h)) - np.repeat(begin, np.diff(np.concatenate([begin, [len(h)]])))
        line = np.add.reduceat(mix(h + spot.astype(np.uint64)), begin)
    else:
        line = np.zeros(0, np.uint64)
    _, twice, _ = _duplicates(wrow[begin], line, rows)
    lines = np.maximum(1, np.bincount(wrow[begin], minlength=rows))
    stats = np.stack(
        [
            letters / chars,
            cls[:, 2] / np.maximum(1, letters),
            cls[:, 4] / some,
            cls[:, 5] / some,
            cls[:, 3] / chars,
            np.log(1 + chars / some),
            _per_row(first, ends - starts <= 3) / some,
            _per_row(first, same) / some,
            top / some,
            np.log(1 + distinct) / np.log(1 + some),
            again / some,
            twice / lines,
        ],
        axis=1,
    )
    return n, np.where(n[:, None] > 0, stats, np.nan)


class Forest:
    """An isolation forest as flat arrays: node -> (statistic or -1, split, left child), path length at leaves."""

    def __init__(self, n: np.ndarray, x: np.ndarray, trees: int, subsample: int, seed: int) -> None:
        rng = np.random.default_rng(seed)
        self.middle, self.spread = np.median(x, axis=0), np.ones(x.shape[1])
        self.spread = np.quantile(np.abs(self.excess(n, x, raw=True)), 0.95, axis=0) + 1e-4
        x = self.excess(n, x)
        size = min(subsample, len(x))
        self.c = max(1e-9, path_of(size))
        deep = int(np.ceil(np.log2(max(2, size))))
        self.trees = [self._grow(x[rng.choice(len(x), size, replace=False)], deep, rng) for _ in range(trees)]
        self.deep = deep

    def excess(self, n: np.ndarray, x: np.ndarray, raw: bool = False) -> np.ndarray:
        z = (x - self.middle) * np.sqrt(n / (n + STEADY_WORDS))[:, None] / self.spread
        return z if raw else np.clip(np.abs(z) - 1, 0, 10)

    @staticmethod
    def _grow(x: np.ndarray, deep: int, rng):
        feature, split, left, length, todo = [], [], [], [], [(x, 0)]
        where = 0
        while where < len(todo):
            part, depth = todo[where]
            where += 1
            wide = np.flatnonzero(np.ptp(part, axis=0) > 0) if len(part) > 1 and depth < deep else []
            if len(wide):
                f = int(rng.choice(wide))
                s = rng.uniform(part[:, f].min(), part[:, f].max())
                less = part[:, f] < s
                feature.append(f)
                split.append(s)
                left.append(len(todo))
                length.append(0.0)
                todo += [(part[less], depth + 1), (part[~less], depth + 1)]
            else:
                feature.append(-1)
                split.append(0.0)
                left.append(-1)
                length.append(depth + path_of(len(part)))
        return np.array(feature), np.array(split), np.array(left), np.array(length)

    def score(self, n: np.ndarray, x: np.ndarray) -> np.ndarray:
        """2 ** (-mean path / c): near 1 for what is soon isolated."""
        x = self.excess(n, x)
        total, at_row = np.zeros(len(x)), np.arange(len(x))
        for feature, split, left, length in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.deep):
                f = feature[node]
                inner = f >= 0
                node = np.where(inner, left[node] + (x[at_row, np.maximum(f, 0)] >= split[node]), node)
            total += length[node]
        return 2.0 ** (-total / len(self.trees) / self.c)


def path_of(n: int) -> float:
    """Mean depth of an unsuccessful search in a tree of n rows."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def threshold(good: np.ndarray, bad: np.ndarray, good_loss: float) -> float:
    """The score above which a document is rejected."""
    if not len(good):
        return np.inf
    least = np.quantile(good, 1 - good_loss, method="higher")
    if not len(bad):
        return float(good.max())
    cuts = np.unique(np.concatenate([[least], good[good >= least], bad[bad >= least]]))
    b, g = np.sort(bad), np.sort(good)
    right = (len(b) - np.searchsorted(b, cuts, "right")) / len(b) - (len(g) - np.searchsorted(g, cuts, "right")) / len(g)
    return float(cuts[int(np.argmax(right))])


def _stats_only(batches):
    pw = Powers()
    for batch in batches:
        for i, data, off in slices(batch.column(1)):
            n, s = statistics(data, off, pw)
            flat = pa.array(s.ravel())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, len(n)), pa.array(n.astype(np.int32)), pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * len(STATS)), flat)], ["quality", "n_words", "stats"])


def fit(docs: DataFrame, labels: DataFrame, trees: int = TREES, subsample: int = SUBSAMPLE, fit_rows: int = FIT_ROWS, good_loss: float = GOOD_LOSS, seed: int = SEED):
    """(forest, threshold) of a sample of at most fit_rows labelled rows; (None, inf) without good ones."""
    by_id = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("__id")).agg(F.min("quality").cast("int").alias("__quality"))
    sample = by_id.orderBy(F.xxhash64("__id"), "__id").limit(fit_rows)
    picked = docs.select(F.col("doc_id").cast("long").alias("__id"), F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "__id")
    rows = picked.select("__quality", "text").mapInArrow(_stats_only, "quality int, n_words int, stats array<double>").where("n_words > 0").toPandas()
    rows["stats"] = rows["stats"].map(tuple)
    rows = rows.sort_values(["quality", "n_words", "stats"], kind="stable")  # whatever order tasks ended in
    x, quality = np.array(rows["stats"].tolist(), float).reshape(-1, len(STATS)), rows["quality"].to_numpy()
    if not (quality == 1).any():
        return None, np.inf
    n = rows["n_words"].to_numpy(float)
    forest = Forest(n[quality == 1], x[quality == 1], trees, subsample, seed)
    s = forest.score(n, x)
    return forest, threshold(s[quality == 1], s[quality == 0], good_loss)


def _keeper(shared, full: bool, name: str = "__text"):
    def run(batches):
        pw = Powers()
        forest, most = pickle.loads(shared.value)
        for batch in batches:
            for i, data, off in slices(batch.column(batch.schema.get_field_index(name))):
                n, s = statistics(data, off, pw)
                score = np.where(n > 0, 0.0, 1.0)
                has = np.flatnonzero(n > 0)
                if forest is not None and len(has):
                    score[has] = forest.score(n[has], s[has])
                keep = (n > 0) & (score <= most)
                part = batch.slice(i, len(n))
                if full:
                    cols = [part.column(part.schema.get_field_index("doc_id")), pa.array(n.astype(np.int32)), *(pa.array(c, mask=n == 0) for c in s.T), pa.array(score), pa.array(keep)]
                    yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_words", *STATS, "score", "keep"])
                else:
                    yield part.select([c for c in part.schema.names if c != name]).filter(pa.array(keep))

    return run


def scored(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """doc_id, n_words, the rule statistics, score and keep for every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps(fit(docs, labels, **how)))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("__text"))
    return slim.mapInArrow(_keeper(shared, True), "doc_id long, n_words int, " + ", ".join(f"{c} double" for c in STATS) + ", score double, keep boolean")


def kept(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """The rows of docs that the forest doesn't find anomalous, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps(fit(docs, labels, **how)))
    name = free_name(docs, "__text")
    return docs.withColumn(name, F.col("text").cast("string")).mapInArrow(_keeper(shared, False, name), docs.schema)
