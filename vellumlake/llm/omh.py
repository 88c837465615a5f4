"""MinHash near-dedup by Order MinHash, candidates verified by banded alignment.

Words are lower-cased runs of letters, digits and non-ASCII characters.  A text's k-mers are labelled with their
occurrence number; each of `sketches` hash functions takes the `SAMPLED` labelled k-mers of least hash and keeps them in text
order, so that a sketch agrees only where content *and order* agree.  Texts that share a sketch are candidates.  A candidate pair
is a near copy when its word edit distance is at most (1 - similarity) of the longer text, found exactly by alignment in a
band that widens as far as that limit.  Near copies are closed into groups (connected components).

Hot buckets need no cap: texts that are equal after normalisation are one node; in a bucket each node is first
aligned with the bucket's least node, which settles buckets of true copies in linear work; only where a bucket still holds
different groups are its remaining cross-group pairs aligned, all of them.  The groups are those of all candidate pairs.

Defined cases: null and empty texts, and texts without a word, are in no group; texts under k words only group with equal ones;
repeated rows are copies of each other; of a group the row of least doc_id is kept (null ids last); extra columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import cut, free_name, written
from .textvec import NORM, Powers, grams, inside, mix, slices, words

K = 3
SAMPLED = 3
SKETCHES = 24
SIMILARITY = 0.7
_TOP = np.uint64((1 << 64) - 1)


def text_nodes(h: np.ndarray, first: np.ndarray, pw: Powers) -> np.ndarray:
    """A hash of each row's word sequence; 0 where it has no word."""
    p, q = pw.of(0xD6E8FEB86659FD93, len(h) + 1)
    c = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * p[: len(h)], out=c[1:])
    n = np.diff(first).astype(np.uint64)
    return np.where(n > 0, mix((c[first[1:]] - c[first[:-1]]) * q[first[:-1]] + n), np.uint64(0))


def order_sketches(h: np.ndarray, first: np.ndarray, k: int, sketches: int, pw: Powers) -> tuple[np.ndarray, np.ndarray]:
    """(rows with a k-mer, their sketch keys: one line a row)."""
    g, ok = grams(h, k, pw), inside(first, k, len(h))
    place = np.flatnonzero(ok)
    g = g[place]
    if not len(g):
        return np.zeros(0, np.int64), np.zeros((0, sketches), np.uint64)
    row = np.searchsorted(first, place, "right") - 1
    order = np.argsort(g ^ mix(row.astype(np.uint64)), kind="stable")
    s, r = g[order], row[order]
    fresh = np.concatenate([[True], (s[1:] != s[:-1]) | (r[1:] != r[:-1])])
    run = np.maximum.accumulate(np.where(fresh, np.arange(len(s)), 0))
    label = np.empty(len(s), np.uint64)
    label[order] = mix(s + (np.arange(len(s)) - run).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    begin = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    count = np.diff(np.concatenate([begin, [len(row)]]))
    keys = np.empty((len(begin), sketches), np.uint64)
    for j in range(sketches):
        x = (label ^ mix(np.array([j + 1], np.uint64))) * np.uint64((0xC2B2AE3D27D4EB4F * (2 * j + 1)) & ((1 << 64) - 1))
        got = []
        for _ in range(SAMPLED):
            at = np.full(len(begin), -1, np.int64)
            least = np.flatnonzero(x == np.repeat(np.minimum.reduceat(x, begin), count))
            at[np.searchsorted(begin, least, "right") - 1] = least
            x[at] = _TOP
            got.append(at)
        got = np.sort(np.stack(got), axis=0)  # back in text order
        key = np.full(len(begin), j + 1, np.uint64)
        for at in got:
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + g[at])
        keys[:, j] = key
    return row[begin], keys


def _signer(k: int, sketches: int):
    def run(batches):
        pw = Powers()
        for batch in batches:
            ids = batch.column(0)
            for i, data, off in slices(batch.column(1)):
                h, _, _, first = words(data, off, NORM, pw)
                node = text_nodes(h, first, pw)
                rows, keys = order_sketches(h, first, k, sketches, pw)
                per = np.full(len(node), 0, np.int32)
                per[rows] = sketches
                offsets = np.concatenate([[0], np.cumsum(per)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(i, len(node)), pa.array(node.view(np.int64), mask=node == 0), pa.array(np.diff(first).astype(np.int32)), lists],
                    ["doc_id", "node", "n_words", "keys"],
                )

    return run


def signatures(docs: DataFrame, k: int = K, sketches: int = SKETCHES) -> DataFrame:
    """doc_id, node (hash of the normalised text; null without words), n_words, keys (its sketches)."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower(F.col("text").cast("string")).alias("text"))
    return slim.mapInArrow(_signer(k, sketches), "doc_id long, node long, n_words int, keys array<long>")


def bag_bound(a: np.ndarray, b: np.ndarray) -> int:
    """A lower bound of the edit distance: words of the one that the other lacks."""
    s, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    d = np.bincount(inv[: len(a)], minlength=len(s)) - np.bincount(inv[len(a) :], minlength=len(s))
    return int(max(d[d > 0].sum(), -d[d < 0].sum()))


def banded(pairs: list[tuple[np.ndarray, np.ndarray]], band: int) -> np.ndarray:
    """Edit distances of pairs, aligned together in a band; a value above `band` only says that the distance is above it."""
    far, big = 2 * band + 1, 1 << 28
    la = np.array([len(a) for a, _ in pairs])
    order = np.argsort(la, kind="stable")
    longest = int(la.max(initial=0))
    a = np.full((len(pairs), longest), -1, np.int64)
    b = np.full((len(pairs), longest + far), -2, np.int64)
    for r, o in enumerate(order):
        x, y = pairs[o]
        a[r, : len(x)] = x
        y = y[: longest + band + 1]
        b[r, band : band + len(y)] = y
    step = np.arange(far, dtype=np.int32)
    d = np.tile(np.where(step >= band, step - band, big).astype(np.int32), (len(pairs), 1))
    out = np.full(len(pairs), big)
    ends, done = la[order], 0
    for i in range(longest + 1):
        if i:
            t = d + (a[:, i - 1 : i] != b[:, i - 1 : i - 1 + far])
            np.minimum(t[:, :-1], d[:, 1:] + 1, out=t[:, :-1])
            t -= step
            d = np.minimum.accumulate(t, axis=1) + step
        while done < len(order) and ends[done] == i:
            shift = len(pairs[order[done]][1]) - i + band
            if 0 <= shift < far:
                out[order[done]] = d[done, shift]
            done += 1
        if done and done * 2 >= len(d) and done < len(order):  # finished pairs leave the table
            a, b, d, order, ends, done = a[done:], b[done:], d[done:], order[done:], ends[done:], 0
    return out


def near(pairs: list[tuple[np.ndarray, np.ndarray]], similarity: float) -> np.ndarray:
    """For each pair of word sequences its edit similarity, 1 - distance / longer length; -1 where it's below `similarity`."""
    out = np.full(len(pairs), -1.0)
    limit = [int((1 - similarity) * max(len(a), len(b)) + 1e-9) for a, b in pairs]
    todo = [i for i, (a, b) in enumerate(pairs) if abs(len(a) - len(b)) <= limit[i] and bag_bound(a, b) <= limit[i]]
    band = 8
    while todo:
        todo.sort(key=lambda i: len(pairs[i][0]))
        rest, at = [], 0
        while at < len(todo):
            to, most = at, 0
            while to < len(todo) and (to == at or (to - at + 1) * max(most, len(pairs[todo[to]][0]) + 2 * band) <= 2_000_000 and to - at < 512):
                most = max(most, len(pairs[todo[to]][0]) + 2 * band)
                to += 1
            got = todo[at:to]
            for i, x in zip(got, banded([pairs[i] for i in got], band)):
                if x <= min(band, limit[i]):
                    out[i] = 1 - x / max(1, len(pairs[i][0]), len(pairs[i][1]))
                elif band < limit[i]:
                    rest.append(i)
            at = to
        todo, band = rest, band * 4
    return out


def _tokens(batches):
    pw = Powers()
    for batch in batches:
        for i, data, off in slices(batch.column(1)):
            h, _, _, first = words(data, off, NORM, pw)
            node = text_nodes(h, first, pw)
            o = (first * 8).astype(np.int64)
            toks = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(node), [None, pa.py_buffer(o.tobytes()), pa.py_buffer(h.tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64), mask=node == 0), toks], ["node", "toks"])


def _verify(similarity: float):
    def run(batches):
        for batch in batches:
            for part in range(0, len(batch), 4096):
                some = batch.slice(part, 4096)
                ta, tb = some.column(2), some.column(3)
                s = near([(np.frombuffer(x.as_buffer(), np.int64), np.frombuffer(y.as_buffer(), np.int64)) for x, y in zip(ta, tb)], similarity)
                at = pa.array(np.flatnonzero(s >= 0))
                yield pa.RecordBatch.from_arrays([some.column(0).take(at), some.column(1).take(at), pa.array(s[s >= 0])], ["a", "b", "similarity"])

    return run


def _aligned(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of nodes that are near copies; texts are read again only for nodes in a pair."""
    asked = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes, "node").select("doc_id").distinct()
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower(F.col("text").cast("string")).alias("text"))
    # null ids match no join key: all their rows are read again
    plain, null = slim.join(asked.where("doc_id is not null"), "doc_id", "left_semi"), slim.where("doc_id is null")
    toks = plain.union(null).mapInArrow(_tokens, "node long, toks binary").where("node is not null").dropDuplicates(["node"])
    ta, tb = (toks.select(F.col("node").alias(x), F.col("toks").alias("t" + x)) for x in "ab")
    return pairs.join(ta, "a").join(tb, "b").select("a", "b", "ta", "tb").mapInArrow(_verify(similarity), "a long, b long, similarity double")


def components(edges: DataFrame) -> DataFrame:
    """(node, label): label is the least node of its component.  edges: (a, b).  Labels pass along edges and then jump to their label's."""
    both = cut(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = cut(both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("label")))
    while True:
        heard = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("low"))
        passed = labels.join(heard, labels.node == heard.a).select("node", F.col("label").alias("old"), F.least("label", "low").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        new = cut(passed.join(jump, "label").select("node", "old", F.least("label", "next").alias("label")))
        changed = new.where("old <> label").limit(1).count()
        labels = new.select("node", "label")
        if not changed:
            return labels


def near_groups(docs: DataFrame, similarity: float = SIMILARITY, k: int = K, sketches: int = SKETCHES) -> tuple[DataFrame, DataFrame]:
    """(signatures: doc_id, node, n_words, keys; labels: node, label of nodes that have a near copy)."""
    sigs = written(signatures(docs, k, sketches), "omh-signatures")
    nodes = sigs.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("keys").alias("keys"))
    buckets = nodes.select("node", F.explode("keys").alias("key"))
    hub = F.min("node").over(Window.partitionBy("key"))
    size = F.count(F.lit(1)).over(Window.partitionBy("key"))
    shared = written(buckets.select("key", "node", hub.alias("hub"), size.alias("size")).where("size > 1").select("key", "node", "hub"), "omh-buckets")
    names = nodes.select("node", "doc_id")
    stars = cut(shared.where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct())
    edges = cut(_aligned(stars, docs, names, similarity))
    labels = components(edges)
    # buckets whose members aren't in one group yet: every pair across groups that wasn't aligned is aligned now
    named = shared.join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"))
    spread = Window.partitionBy("key")
    mixed = named.select("key", "node", "label", F.min("label").over(spread).alias("lo"), F.max("label").over(spread).alias("hi")).where("lo < hi")
    x, y = (mixed.select("key", F.col("node").alias(n), F.col("label").alias("l" + n)) for n in "ab")
    rest = x.join(y, "key").where("a < b and la <> lb").select("a", "b").distinct().join(stars, ["a", "b"], "left_anti")
    more = cut(_aligned(cut(rest), docs, names, similarity))
    if more.limit(1).count():
        edges = edges.select("a", "b").union(more.select("a", "b"))
        labels = components(edges)
    return sigs, labels


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, k: int = K, sketches: int = SKETCHES) -> DataFrame:
    """One row a document that has a copy or near copy: doc_id, kept_id (the least id of its group), group_rows, is_kept.

    See the module for the defined cases.
    """
    sigs, labels = near_groups(docs, similarity, k, sketches)
    rows = sigs.where("node is not null").select("doc_id", "node").join(labels, "node", "left").select("doc_id", F.coalesce("label", "node").alias("label"))
    groups = rows.groupBy("label").agg(F.min("doc_id").alias("kept_id"), F.count(F.lit(1)).alias("group_rows")).where("group_rows > 1")
    return rows.join(groups, "label").select("doc_id", "kept_id", "group_rows", F.coalesce(F.col("doc_id") == F.col("kept_id"), F.lit(False)).alias("is_kept"))


def drop_near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, k: int = K, sketches: int = SKETCHES) -> DataFrame:
    """docs with one row of each group of near copies, that of least doc_id; rows without words all stay."""
    sigs, labels = near_groups(docs, similarity, k, sketches)
    rows = sigs.where("node is not null").select("doc_id", "node").join(labels, "node", "left").select("doc_id", "node", F.coalesce("label", "node").alias("label"))
    best = rows.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "node")).alias("best"))
    key, node, mine = (free_name(docs, x) for x in ("__id", "__node", "__node_of"))
    kept = best.select(F.col("best.doc_id").alias("doc_id"), F.col("best.node").alias("node"))
    repeated = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc_id is null").select(F.col("doc_id").alias(key))
    once = repeated.where(F.col(key).isNotNull())
    plain = kept.where("doc_id is not null").select(F.col("doc_id").alias(key)).join(once, key, "left_anti")
    odd = kept.join(repeated, F.col("doc_id").eqNullSafe(F.col(key)), "left_semi").select(F.col("node").alias(node))
    wordless = sigs.where("node is null and doc_id is not null").select(F.col("doc_id").alias(key)).join(rows.select(F.col("doc_id").alias(key)), key, "left_anti")
    id_ = F.col("doc_id").cast("long")
    stay = docs.join(plain.union(wordless), id_ == F.col(key), "left_semi")
    # rows whose id is null, or is another row's too, are told apart by their text
    shared = sigs.where("node is null").select(F.col("doc_id").alias(key)).join(rows.select(F.col("doc_id").alias(key)), key, "left_semi")
    again = docs.join(repeated.union(shared).union(sigs.where("doc_id is null").select(F.col("doc_id").alias(key))).distinct(), id_.eqNullSafe(F.col(key)), "left_semi")
    hashed = _with_node(again, mine)
    mixed = plain.join(shared, key, "left_semi")  # already in `stay`, together with their wordless namesakes
    one = hashed.where(F.col(mine).isNotNull()).join(odd, F.col(mine) == F.col(node), "left_semi").dropDuplicates([mine])
    none = hashed.where(F.col(mine).isNull()).join(mixed, id_.eqNullSafe(F.col(key)), "left_anti")
    return stay.unionByName(one.drop(mine)).unionByName(none.drop(mine))


def _with_node(docs: DataFrame, name: str) -> DataFrame:
    @F.pandas_udf("long")
    def node_of(text: pd.Series) -> pd.Series:
        pw, out = Powers(), []
        for _, data, off in slices(pa.array(text, pa.string(), from_pandas=True)):
            h, _, _, first = words(data, off, NORM, pw)
            out.append(text_nodes(h, first, pw))
        got = np.concatenate(out) if out else np.zeros(0, np.uint64)
        return pd.Series(got.view(np.int64)).astype("Int64").mask(pd.Series(got == 0))

    return docs.withColumn(name, node_of(F.lower(F.col("text").cast("string"))))
