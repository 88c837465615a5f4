"""Substring dedup: windows of 50 words that occur more than once, found exactly behind a count-min prefilter.

Pass 1 sketches.  Every 50-word window holds at least one winnowed anchor (the 25-word gram of least hash among 26
neighbours), and equal windows hold equal anchors, so an anchor occurs at least as often as any window around it.  Each
partition adds its anchors to a count-min sketch; the partial sketches are merged by addition, cell block by cell
block.  Pass 2 reads the texts again and emits only windows around an anchor whose every cell counts two or more:
the sketch never underestimates, so no repeated window is lost.  These windows are grouped exactly, by 128 bits.

The merged sketch is broadcast, as bits, while it is smaller than `max_sketch_bytes`.  Beyond that it is a table of its cells, added up by the
same partial sketches, and anchors meet it in joins, row by row of the sketch; the texts of those that are left are joined to their places.  Either way
the same cells of the same width decide, so that the windows are the same.

Defined cases: null and empty texts, and texts under `window` words, have no window; every occurrence counts,
also in repeated rows and twice in one text; rows of null doc_id count towards repetition but are not reported; other
columns are ignored; an empty table gives an empty result.  Words are runs of characters other than ASCII white space.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import written
from .textvec import PLAIN, Powers, grams, inside, sliding, slices, words

WINDOW = 50
DEPTH = 2
CELLS_PER_ANCHOR = 8
MAX_SKETCH_BYTES = 128 << 20
BLOCK_BITS = 18

SPANS = "doc_id long, start_word int, end_word int, windows int, copies long"


def anchors(h: np.ndarray, first: np.ndarray, k: int, pw: Powers) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of winnowed k-grams: of each k + 1 (at least) neighbours inside a row the least, and its equals."""
    g = grams(h, k, pw)
    ok = inside(first, k, len(h))
    g = np.where(ok, g >> np.uint64(1), np.uint64(1) << np.uint64(63))  # a gram across rows is never least
    low = sliding(g, k + 1)
    whole = inside(first, 2 * k, len(h))  # neighbourhoods inside one row
    low = np.where(whole, low, np.uint64(0))
    pad = np.zeros(k, np.uint64)
    at = np.flatnonzero((g == sliding(np.concatenate([pad, low, pad]), k + 1, np.maximum)) & ok) if len(low) else np.zeros(0, np.int64)
    return at, g[at]


def cells(g: np.ndarray, row: int, width: int) -> np.ndarray:
    """The cell of each gram in a row of the sketch."""
    a = (0x9E3779B97F4A7C15 * (2 * row + 1)) & ((1 << 64) - 1)
    b = (0xC2B2AE3D27D4EB4F * (2 * row + 3)) & ((1 << 64) - 1)
    x = (g ^ (g >> np.uint64(29))) * np.uint64(a | 1)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(b | 1)
    return (x >> np.uint64(64 - (width.bit_length() - 1))).astype(np.int64)


def _sketcher(k: int, width: int, depth: int):
    def add(parts: list) -> list:
        """Rows of one partial sketch: its non-zero cells by block, with saturated counts."""
        g = np.concatenate(parts)
        out = []
        for row in range(depth):
            at, n = np.unique(cells(g, row, width), return_counts=True)
            n = np.minimum(n, 255).astype(np.uint8)
            cuts = np.flatnonzero(np.diff(at >> BLOCK_BITS)) + 1
            for a, c in zip(np.split(at, cuts), np.split(n, cuts)):
                if len(a):
                    out.append((row, int(a[0] >> BLOCK_BITS), (a & ((1 << BLOCK_BITS) - 1)).astype("<u4").tobytes(), c.tobytes()))
        return out

    def rows(out: list) -> pa.RecordBatch:
        r, b, c, n = zip(*out) if out else ((), (), (), ())
        return pa.RecordBatch.from_arrays([pa.array(r, pa.int32()), pa.array(b, pa.int32()), pa.array(c, pa.binary()), pa.array(n, pa.binary())], ["row", "block", "cells", "counts"])

    def run(batches):
        pw, parts, held = Powers(), [], 0
        for batch in batches:
            for _, data, off in slices(batch.column(0)):
                h, _, _, first = words(data, off, PLAIN, pw)
                _, g = anchors(h, first, k, pw)
                parts.append(g)
                held += len(g)
                if held > 4_000_000:
                    yield rows(add(parts))
                    parts, held = [], 0
        if held:
            yield rows(add(parts))

    return run


def _merge(key, pdf):
    """Partial sketches of one block, added; the cells of two or more, as bits."""
    import pandas as pd

    total = np.zeros(1 << BLOCK_BITS, np.int64)
    for c, n in zip(pdf["cells"], pdf["counts"]):
        total[np.frombuffer(c, "<u4")] += np.frombuffer(n, np.uint8)
    bits = np.packbits(total >= 2, bitorder="little")
    return pd.DataFrame({"row": [key[0]], "block": [key[1]], "bits": [bits.tobytes()]})


def _marked(a: np.ndarray, first: np.ndarray, n: int, k: int, window: int) -> np.ndarray:
    """Starts of the windows that hold a marked anchor."""
    hit = np.zeros(n + 1, np.int32)
    np.add.at(hit, np.maximum(a - (window - k), 0), 1)
    np.add.at(hit, a + 1, -1)
    ok = inside(first, window, n)
    return np.flatnonzero((np.cumsum(hit)[: len(ok)] > 0) & ok)


def _emit(doc_ids: np.ndarray, known: np.ndarray, h, first, at, window, pw) -> pa.RecordBatch:
    one, two = grams(h, window, pw), grams(h, window, pw, second=True)
    row = np.searchsorted(first, at, "right") - 1
    return pa.RecordBatch.from_arrays(
        [pa.array(one[at].view(np.int64)), pa.array(two[at].view(np.int64)), pa.array(doc_ids[row], mask=~known[row]), pa.array((at - first[row]).astype(np.int32))],
        ["h1", "h2", "doc_id", "pos"],
    )


def _ids(batch: pa.RecordBatch, name: str = "doc_id") -> tuple[np.ndarray, np.ndarray]:
    c = batch.column(name)
    return c.fill_null(0).to_numpy(zero_copy_only=False), ~c.is_null().to_numpy(zero_copy_only=False)


def _second(bits, k: int, window: int, width: int, depth: int):
    def run(batches):
        pw = Powers()
        table = [np.frombuffer(b, np.uint8) for b in bits.value]
        for batch in batches:
            ids, known = _ids(batch)
            for i, data, off in slices(batch.column(batch.schema.get_field_index("text"))):
                h, _, _, first = words(data, off, PLAIN, pw)
                at, g = anchors(h, first, k, pw)
                maybe = np.ones(len(g), bool)
                for row in range(depth):
                    c = cells(g, row, width)
                    maybe &= (table[row][c >> 3] >> (c & 7).astype(np.uint8)) & 1 == 1
                at = _marked(at[maybe], first, len(h), k, window)
                if len(at):
                    yield _emit(ids[i:], known[i:], h, first, at, window, pw)

    return run


def _cell_rows(k: int, width: int, depth: int):
    """Rows (row, cell, n) of partial sketches, each of millions of anchors at most."""

    def added(parts: list) -> pa.RecordBatch:
        g, out = np.concatenate(parts), []
        for row in range(depth):
            at, n = np.unique(cells(g, row, width), return_counts=True)
            out.append((np.full(len(at), row, np.int32), at, n.astype(np.int64)))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], ["row", "cell", "n"])

    def run(batches):
        pw, parts, held = Powers(), [], 0
        for batch in batches:
            for _, data, off in slices(batch.column(0)):
                h, _, _, first = words(data, off, PLAIN, pw)
                parts.append(anchors(h, first, k, pw)[1])
                held += len(parts[-1])
                if held > 2_000_000:
                    yield added(parts)
                    parts, held = [], 0
        if held:
            yield added(parts)

    return run


def _anchor_rows(k: int, width: int, depth: int):
    """Every anchor's cells, with its text's key and its place."""

    def run(batches):
        pw = Powers()
        for batch in batches:
            uid = batch.column(batch.schema.get_field_index("uid")).to_numpy(zero_copy_only=False)
            for i, data, off in slices(batch.column(batch.schema.get_field_index("text"))):
                h, _, _, first = words(data, off, PLAIN, pw)
                at, g = anchors(h, first, k, pw)
                row = np.searchsorted(first, at, "right") - 1
                cols = [pa.array(uid[i + row]), pa.array((at - first[row]).astype(np.int32)), *(pa.array(cells(g, r, width)) for r in range(depth))]
                yield pa.RecordBatch.from_arrays(cols, ["uid", "pos", *(f"c{r}" for r in range(depth))])

    return run


def _from_places(k: int, window: int):
    """Windows around the given anchor places of each text."""

    def run(batches):
        pw = Powers()
        for batch in batches:
            ids, known = _ids(batch)
            places = batch.column(batch.schema.get_field_index("places")).to_pylist()
            for i, data, off in slices(batch.column(batch.schema.get_field_index("text"))):
                h, _, _, first = words(data, off, PLAIN, pw)
                a = [np.asarray(places[i + r], np.int64) + first[r] for r in range(len(off) - 1)]
                a = np.concatenate([x[x < first[r + 1]] for r, x in enumerate(a)])  # texts of one key are nearly sure to be equal
                at = _marked(a, first, len(h), k, window)
                if len(at):
                    yield _emit(ids[i:], known[i:], h, first, at, window, pw)

    return run


_WINDOWS = "h1 long, h2 long, doc_id long, pos int"


def candidate_windows(docs: DataFrame, window: int = WINDOW, depth: int = DEPTH, max_sketch_bytes: int = MAX_SKETCH_BYTES) -> DataFrame:
    """(h1, h2, doc_id, pos): every window that repeats, and the few others that the sketch can't tell from these."""
    spark, k = docs.sparkSession, window // 2
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    need = max(2, CELLS_PER_ANCHOR * (size // 6) * 2 // (k + 2))
    width = 1 << max(BLOCK_BITS, math.ceil(math.log2(need)))
    if depth * width // 8 <= max_sketch_bytes:
        merged = docs.select("text").mapInArrow(_sketcher(k, width, depth), "row int, block int, cells binary, counts binary").groupBy("row", "block").applyInPandas(_merge, "row int, block int, bits binary")
        table = [bytearray(width // 8) for _ in range(depth)]
        per = (1 << BLOCK_BITS) // 8
        for r in merged.toLocalIterator():
            table[r["row"]][r["block"] * per : (r["block"] + 1) * per] = r["bits"]
        bits = spark.sparkContext.broadcast([bytes(t) for t in table])
        return docs.mapInArrow(_second(bits, k, window, width, depth), _WINDOWS)
    keyed = docs.withColumn("uid", F.xxhash64("doc_id", "text"))
    sketch = docs.select("text").mapInArrow(_cell_rows(k, width, depth), "row int, cell long, n long").groupBy("row", "cell").agg(F.sum("n").alias("n"))
    often = written(sketch.where("n > 1").select("row", "cell"), "sketch-cells")
    left = keyed.select("uid", "text").mapInArrow(_anchor_rows(k, width, depth), "uid long, pos int, " + ", ".join(f"c{r} long" for r in range(depth)))
    for r in range(depth):
        left = left.join(often.where(F.col("row") == r).select(F.col("cell").alias(f"c{r}")), f"c{r}", "left_semi").drop(f"c{r}")
    places = left.groupBy("uid").agg(F.collect_set("pos").alias("places"))
    return keyed.join(places, "uid").select("doc_id", "text", "places").mapInArrow(_from_places(k, window), _WINDOWS)


def _merge_spans(window: int):
    def run(batches):
        for batch in batches:
            d, pos, n = (batch.column(j) for j in range(3))
            ids, starts, ends, count, most = [], [], [], [], []
            for doc, p, c in zip(d.to_pylist(), pos, n):
                p, c = p.values.to_numpy(), c.values.to_numpy()
                order = np.argsort(p, kind="stable")
                p, c = p[order], c[order]
                new = np.concatenate([[True], np.diff(p) > window])  # windows that overlap or touch are one span
                at = np.flatnonzero(new)
                last = np.concatenate([at[1:], [len(p)]]) - 1
                ids += [doc] * len(at)
                starts.append(p[at])
                ends.append(p[last] + window)
                distinct = np.concatenate([[1], (np.diff(p) > 0).astype(np.int64)])
                count.append(np.add.reduceat(distinct, at))
                most.append(np.maximum.reduceat(c, at))
            cat = lambda x, t: pa.array(np.concatenate(x).astype(t)) if x else pa.array([], pa.from_numpy_dtype(t))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), cat(starts, np.int32), cat(ends, np.int32), cat(count, np.int32), cat(most, np.int64)], ["doc_id", "start_word", "end_word", "windows", "copies"])

    return run


def repeated_spans(docs: DataFrame, window: int = WINDOW, max_sketch_bytes: int = MAX_SKETCH_BYTES) -> DataFrame:
    """Spans of words covered by windows that occur at least twice in the corpus.

    One row a maximal span: doc_id, start_word, end_word (exclusive), windows (repeated windows in it) and copies (the most
    occurrences that any of them has).  See the module for the defined cases.
    """
    found = candidate_windows(docs, window, max_sketch_bytes=max_sketch_bytes)
    copies = F.count(F.lit(1)).over(Window.partitionBy("h1", "h2"))  # spills, however hot a window is
    often = found.withColumn("n", copies).where("n > 1 and doc_id is not null")
    by_doc = often.groupBy("doc_id").agg(F.collect_set(F.struct("pos", "n")).alias("at")).select("doc_id", F.col("at.pos").alias("pos"), F.col("at.n").alias("n"))
    return by_doc.mapInArrow(_merge_spans(window), SPANS)

