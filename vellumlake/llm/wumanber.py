"""Benchmark decontamination by Wu-Manber multi-pattern search.

A benchmark item's patterns are its windows of `window` words (the whole item where it is shorter), normalised and framed by single
spaces so that they match whole words only.  A table over hashed blocks of 8 bytes tells how far the search may shift
from a position; where it can't shift, the suffix block's bucket gives the patterns to try, a prefix block thins
them, and a direct comparison of bytes confirms.  All texts of a batch are searched side by side, a lane for each stretch of text.

Normal form: lower case; ASCII characters other than letters and digits separate words.

Defined cases: null and empty texts match nothing; null or empty items, and items of fewer than `least_words` words, have no
pattern; equal items each report; every row of the documents is searched and reported, repeated rows too; extra columns
are ignored; an empty benchmark or empty documents give an empty result.  Patterns are broadcast in chunks of bounded size: a
benchmark beyond one chunk is searched in as many passes as it has chunks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import free_name
from .textvec import NORM, slices

WINDOW = 10
LEAST_WORDS = 5
CHUNK_BYTES = 32 << 20
BLOCK = 8
_HASH = np.uint64(0x9E3779B97F4A7C15)
SEPARATORS = r"[\x00-/:-@\[-`{-\x7f]+"


def patterns(benchmark: DataFrame, window: int = WINDOW, least_words: int = LEAST_WORDS) -> DataFrame:
    """(item_id, patterns): the distinct windows of each item."""
    if least_words < 4:
        raise ValueError("least_words must be 4 or more: a framed pattern must fill a block")
    text = F.trim(F.regexp_replace(F.lower(F.col("text").cast("string")), SEPARATORS, " "))
    item = benchmark.where("text is not null and item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), F.split(text, " ").alias("w"))
    item = item.where((F.size("w") >= least_words) & (F.element_at("w", 1) != ""))
    at = F.explode(F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1))))
    wins = item.select("item_id", "w", at.alias("at")).select("item_id", F.concat(F.lit(" "), F.array_join(F.expr(f"slice(w, at, {window})"), " "), F.lit(" ")).alias("pattern"))
    return wins.groupBy("item_id").agg(F.sort_array(F.collect_set("pattern")).alias("patterns"))


class Tables:
    """Shift, suffix and prefix tables of one set of patterns."""

    def __init__(self, pats: list[bytes]) -> None:
        self.m = m = min(map(len, pats))
        heads = np.frombuffer(b"".join(p[:m] for p in pats), np.uint8).reshape(len(pats), m)
        self.reach = m - BLOCK + 1
        self.bits = min(24, max(16, (len(pats) * self.reach).bit_length() + 3))
        self.shift = np.full(1 << self.bits, self.reach, np.uint8 if self.reach < 256 else np.int32)
        for j in range(self.reach):  # blocks nearer the end come last and leave the smaller shift
            b = np.ascontiguousarray(heads[:, j : j + BLOCK]).view("<u8").ravel()
            self.shift[(b * _HASH) >> np.uint64(64 - self.bits)] = self.reach - 1 - j
        suffix = np.ascontiguousarray(heads[:, m - BLOCK :]).view("<u8").ravel()
        self.order = np.argsort(suffix, kind="stable")
        self.suffix = suffix[self.order]
        self.prefix = np.ascontiguousarray(heads[:, :BLOCK]).view("<u8").ravel()[self.order]
        self.length = np.array([len(p) for p in pats])[self.order]
        self.pats = [pats[i] for i in self.order]


def search(t: Tables, data: np.ndarray, off: np.ndarray, stretch: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """(position, pattern) of every occurrence; rows are data[off[r]:off[r + 1]], and no occurrence crosses rows."""
    if len(data) < BLOCK:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    block = np.ndarray((len(data) - BLOCK + 1,), "<u8", data.tobytes(), strides=(1,))
    # a lane looks at the block that ends where the first m bytes of an occurrence would end
    n = np.maximum(0, np.diff(off) - t.m + 1)
    lanes = -(-n // stretch)
    row = np.repeat(np.arange(len(n)), lanes)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
    pos = off[row] + nth * stretch + t.m - BLOCK
    end = np.minimum(pos + stretch, off[row + 1] - BLOCK + 1)
    found, bits = [], np.uint64(64 - t.bits)
    while len(pos):
        b = block[pos]
        move = t.shift[(b * _HASH) >> bits].astype(np.int64)
        stop = move == 0
        if stop.any():
            at, b = pos[stop], b[stop]
            lo = np.searchsorted(t.suffix, b, "left")
            many = np.searchsorted(t.suffix, b, "right") - lo
            if many.any():
                which = np.repeat(lo - (np.cumsum(many) - many), many) + np.arange(many.sum())
                start = np.repeat(at, many) - (t.m - BLOCK)
                good = block[start] == t.prefix[which]
                found.append((start[good], which[good]))
        pos = pos + np.where(stop, 1, move)
        on = pos < end
        if not on.all():
            pos, end = pos[on], end[on]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start, which = (np.concatenate(x) for x in zip(*found))
    stop = off[np.searchsorted(off, start, "right")]
    fits = start + t.length[which] <= stop
    start, which = start[fits], which[fits]
    raw = memoryview(data)
    same = np.fromiter((raw[s : s + len(p)] == p for s, p in ((s, t.pats[w]) for s, w in zip(start.tolist(), which.tolist()))), bool, len(start))
    return start[same], which[same]


def framed(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows in normal form, each framed by spaces."""
    n, rows = len(data), len(off) - 1
    wide = np.empty(n + 2 * rows, np.uint8)
    at = np.arange(n) + 2 * np.repeat(np.arange(rows), np.diff(off)) + 1
    wide[at] = NORM[data]
    edges = off + 2 * np.arange(rows + 1)
    wide[edges[:-1]] = 0
    wide[edges[1:] - 1] = 0
    gap = wide == 0
    keep = ~gap
    keep[1:] |= ~gap[:-1]
    keep[edges[:-1]] = True
    out = wide[keep]
    out[out == 0] = 32
    return out, np.concatenate([[0], np.cumsum(keep)])[edges]


def _matcher(shared):
    def run(batches):
        tables, items = None, None
        for batch in batches:
            if tables is None:
                pats, items = shared.value
                tables = Tables(pats)
                items = [items[i] for i in tables.order]
            ids = batch.column(0)
            for i, data, off in slices(batch.column(1)):
                text, edges = framed(data, off)
                start, which = search(tables, text, edges)
                row = np.searchsorted(edges, start, "right") - 1
                seen = {}
                for r, w in set(zip(row.tolist(), which.tolist())):
                    for item in items[w]:
                        seen[r, item] = seen.get((r, item), 0) + 1
                if seen:
                    keys = sorted(seen)
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array([i + r for r, _ in keys])), pa.array([x for _, x in keys], pa.int64()), pa.array([seen[k] for k in keys], pa.int32())],
                        ["doc_id", "item_id", "windows"],
                    )

    return run


def chunks(items: DataFrame, chunk_bytes: int):
    """(patterns, the items of each): runs of whole items of bounded size."""
    got, size = {}, 0
    for r in items.toLocalIterator():
        for p in r["patterns"]:
            got.setdefault(p.encode(), []).append(r["item_id"])
            size += len(p) + 32
        if size >= chunk_bytes:
            yield list(got), list(got.values())
            got, size = {}, 0
    if got:
        yield list(got), list(got.values())


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, least_words: int = LEAST_WORDS, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, item_id, windows: for each row of docs and item that share a window, how many distinct windows of the item it holds."""
    spark = docs.sparkSession
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower(F.col("text").cast("string")).alias("text"))
    schema, out = "doc_id long, item_id long, windows int", None
    for chunk in chunks(patterns(benchmark, window, least_words), chunk_bytes):
        shared = spark.sparkContext.broadcast(chunk)
        part = slim.mapInArrow(_matcher(shared), schema)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], schema)
    return out


def _flagger(shared, name: str):
    def run(batches):
        tables = None
        for batch in batches:
            if tables is None:
                tables = Tables(shared.value)
            bad = np.zeros(len(batch), bool)
            for i, data, off in slices(batch.column(batch.schema.get_field_index(name))):
                text, edges = framed(data, off)
                start, _ = search(tables, text, edges)
                bad[i + np.searchsorted(edges, start, "right") - 1] = True
            kept = batch.filter(pa.array(~bad))
            yield kept.select([n for n in kept.schema.names if n != name])

    return run


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, least_words: int = LEAST_WORDS, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The rows of docs that hold no benchmark window, with all their columns."""
    for chunk in chunks(patterns(benchmark, window, least_words), chunk_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(chunk[0])
        name = free_name(docs, "__search")
        docs = docs.withColumn(name, F.lower(F.col("text").cast("string"))).mapInArrow(_flagger(shared, name), docs.schema)
    return docs

