"""Packing of documents into training sequences as a cutting-stock problem, by column generation.

Documents are cut into pieces of at most `context` tokens, all but a document's last one full.  The histogram of piece lengths,
rounded up to `quantum` tokens, is the demand.  A linear program over cutting patterns is solved by revised simplex; new
patterns are priced by knapsack dynamic programming over the dual values.  Pattern uses are rounded down and the few pieces left over
are packed first-fit decreasing, as patterns of their own.  Pieces are ranked within their length class and the
patterns' slots are dealt out by rank, so the assignment needs no shuffle of texts and the driver holds only the histogram.

Tokens are runs of characters other than ASCII white space, and one separator ends each piece.

Defined cases: null, empty and wordless texts have no piece; repeated rows are packed as often as they occur; null ids are
packed; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import written
from .textvec import PLAIN, slices

CONTEXT = 2048
QUANTUM = 16
GAP = 1e-4
RANK_ROWS = 100_000
PIECES = "doc_id long, piece int, start_word int, n_words int"


def _cutter(context: int):
    room = context - 1  # the separator's place

    def run(batches):
        for batch in batches:
            for i, data, off in slices(batch.column(1)):
                solid = PLAIN[data] != 0
                begin = solid.copy()
                begin[1:] &= ~solid[:-1]
                edge = off[1:-1][off[1:-1] < len(data)]
                begin[edge] = solid[edge]
                c = np.concatenate([[0], np.cumsum(begin)])
                n = c[off[1:]] - c[off[:-1]]
                parts = -(-n // room)
                row = np.repeat(np.arange(len(n)), parts)
                nth = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(i + row)), pa.array(nth.astype(np.int32)), pa.array((nth * room).astype(np.int32)), pa.array(np.minimum(room, n[row] - nth * room).astype(np.int32))],
                    ["doc_id", "piece", "start_word", "n_words"],
                )

    return run


def knapsack(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most worth that fits, items repeating, and how often each item is taken."""
    best, took = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    order = np.argsort(sizes, kind="stable")
    s, w = sizes[order], worth[order]
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        k = np.searchsorted(s, c, "right")
        if k:
            v = best[c - s[:k]] + w[:k]
            j = int(np.argmax(v))
            if v[j] > best[c] + 1e-12:
                best[c], took[c] = v[j], order[j]
    counts, c = np.zeros(len(sizes), np.int64), capacity
    while c > 0:
        if took[c] < 0:
            c -= 1
        else:
            counts[took[c]] += 1
            c -= sizes[took[c]]
    return float(best[capacity]), counts


def _times(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    return (a * x).sum(1)  # a driver's linear-algebra threads may hang beside the JVM; these are small


def _inverse(a: np.ndarray) -> np.ndarray:
    """By Gauss-Jordan elimination with row pivots."""
    m = len(a)
    t = np.concatenate([a.astype(float), np.eye(m)], axis=1)
    for k in range(m):
        p = k + int(np.argmax(np.abs(t[k:, k])))
        t[[k, p]] = t[[p, k]]
        t[k] /= t[k, k]
        others = t[:, k].copy()
        others[k] = 0
        t -= others[:, None] * t[k]
    return t[:, m:]


def linear_program(sizes: np.ndarray, demand: np.ndarray, capacity: int, gap: float = GAP) -> tuple[np.ndarray, np.ndarray]:
    """(patterns: one a column, uses): a basic solution of min sum(uses), patterns @ uses = demand, by column generation.

    With duals priced at `value`, sum(uses) / value is a lower bound; columns are made until that is within `gap` or half a bin.
    """
    m = len(sizes)
    patterns = np.diag(capacity // sizes).astype(float)
    inverse = np.diag(1.0 / (capacity // sizes))
    x = _times(inverse, demand)
    for turn in range(50 * m + 100):
        dual = inverse.sum(0)
        value, column = knapsack(sizes, dual, capacity)
        if value <= 1 + 1e-9 or x.sum() * (1 - 1 / value) <= max(0.5, gap * x.sum()):
            break
        d = _times(inverse, column)
        up = d > 1e-9
        ratio = np.where(up, x / np.where(up, d, 1), np.inf)
        out = int(np.lexsort((-d, ratio))[0])
        step = max(0.0, ratio[out])
        x = x - step * d
        x[out] = step
        x[np.abs(x) < 1e-11] = 0
        patterns[:, out] = column
        pivot = inverse[out] / d[out]
        inverse = inverse - np.outer(d, pivot)
        inverse[out] = pivot
        if turn % 200 == 199:  # errors of the updates don't pile up
            inverse = _inverse(patterns)
            x = _times(inverse, demand)
    return patterns.astype(np.int64), np.maximum(x, 0)


def solve(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[list[tuple[np.ndarray, int]], float]:
    """(patterns with whole uses that cover the demand exactly, the linear program's bound)."""
    if not len(sizes):
        return [], 0.0
    patterns, x = linear_program(sizes, demand, capacity)
    uses = np.floor(x + 1e-9).astype(np.int64)
    left = demand - patterns @ uses
    for j in np.flatnonzero(uses):  # rounding noise can't use up more than there is
        while (left < 0).any() and uses[j] and (patterns[left < 0, j] > 0).any():
            uses[j] -= 1
            left = left + patterns[:, j]
    out = [(patterns[:, j], int(uses[j])) for j in np.flatnonzero(uses)]
    bins: list[tuple[int, np.ndarray]] = []
    for i in np.argsort(-sizes, kind="stable"):
        for _ in range(int(left[i])):
            for k, (room, counts) in enumerate(bins):
                if room >= sizes[i]:
                    counts[i] += 1
                    bins[k] = (room - sizes[i], counts)
                    break
            else:
                counts = np.zeros(len(sizes), np.int64)
                counts[i] = 1
                bins.append((capacity - int(sizes[i]), counts))
    return out + [(c, 1) for _, c in bins], float(x.sum())


def slots(sizes: np.ndarray, plan: list[tuple[np.ndarray, int]], quantum: int) -> dict[int, tuple]:
    """By length class: rank starts, first bins, pieces a bin and offsets in the bin, of each pattern that takes the class."""
    out = {int(s): ([], [], [], []) for s in sizes}
    at, base = np.zeros(len(sizes), np.int64), 0
    for counts, uses in plan:
        place = 0
        for i in np.flatnonzero(counts):
            for x, v in zip(out[int(sizes[i])], (at[i], base, counts[i], place * quantum)):
                x.append(int(v))
            at[i] += counts[i] * uses
            place += counts[i] * sizes[i]
        base += uses
    return {s: tuple(np.array(x, np.int64) for x in v) for s, v in out.items()}


def _dealer(shared, quantum: int):
    def run(batches):
        table = shared.value
        for batch in batches:
            cls, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("size", "rank"))
            bins, at = np.zeros(len(cls), np.int64), np.zeros(len(cls), np.int64)
            for s in np.unique(cls):
                starts, base, per, offset = table[int(s)]
                here = np.flatnonzero(cls == s)
                p = np.searchsorted(starts, rank[here], "right") - 1
                nth = rank[here] - starts[p]
                bins[here] = base[p] + nth // per[p]
                at[here] = offset[p] + nth % per[p] * int(s) * quantum
            cols = [batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "piece", "start_word", "n_words")]
            yield pa.RecordBatch.from_arrays([pa.array(bins), pa.array(at.astype(np.int32)), *cols], ["sequence_id", "position", "doc_id", "piece", "start_word", "n_words"])

    return run


def packed(docs: DataFrame, context: int = CONTEXT, quantum: int = QUANTUM, rank_rows: int = RANK_ROWS) -> DataFrame:
    """One row a piece: sequence_id, position (its first token's in the sequence), doc_id, piece, start_word, n_words.

    Sequences hold `context` tokens; position + n_words + 1 never exceeds it.  See the module for the defined cases.
    """
    if context % quantum:
        raise ValueError("context must be a multiple of quantum")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = written(slim.mapInArrow(_cutter(context), PIECES).withColumn("size", F.ceil((F.col("n_words") + 1) / quantum).cast("int")), "pieces")
    histogram = sorted((r["size"], r["count"]) for r in pieces.groupBy("size").count().collect())  # at most context / quantum rows
    sizes, demand = (np.array([h[j] for h in histogram], np.int64) for j in (0, 1))
    plan, _ = solve(sizes, demand, context // quantum)
    shared = docs.sparkSession.sparkContext.broadcast(slots(sizes, plan, quantum))
    # rank in the class: by shard and in it by id, so that no class is ranked in one task
    shards = max(1, -(-int(demand.max(initial=1)) // rank_rows))
    sharded = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shards)))
    ahead = Window.partitionBy("size").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    before = sharded.groupBy("size", "shard").count().select("size", "shard", F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("before"))
    inner = F.row_number().over(Window.partitionBy("size", "shard").orderBy("doc_id", "piece"))
    ranked = sharded.withColumn("nth", inner).join(before, ["size", "shard"]).withColumn("rank", (F.col("nth") - 1 + F.col("before")).cast("long"))
    schema = "sequence_id long, position int, doc_id long, piece int, start_word int, n_words int"
    return ranked.select("doc_id", "piece", "start_word", "n_words", "size", "rank").mapInArrow(_dealer(shared, quantum), schema)
