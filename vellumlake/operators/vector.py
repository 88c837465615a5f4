"""Whole-column operators: compare, search, sum, filter, map and sort, as Spark runs them."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import cut


def positions_equal(arrays: DataFrame, id_: str, array: str, value) -> DataFrame:
    """(id, pos) of elements equal to a value, from 0."""
    return arrays.select(id_, F.posexplode(array).alias("pos", "x")).where(F.col("x") == value).select(id_, "pos")


def count_occurrences(text: Column | str, part: str) -> Column:
    """Occurrences of a string that don't overlap, also across any boundary."""
    text = F.col(text) if isinstance(text, str) else text
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / F.lit(len(part))).cast("long")


def first_positions(text: Column | str, part: str) -> Column:
    """Character offsets, from 0, of occurrences that don't overlap."""
    text = F.col(text) if isinstance(text, str) else text
    pieces = F.split(text, "\\Q" + part + "\\E")
    lengths = F.transform(pieces, F.length)
    ends = F.transform(F.sequence(F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(1))), lambda i: F.aggregate(F.slice(lengths, 1, i), F.lit(0), lambda a, x: a + x) + (i - 1) * len(part))
    return F.when(F.size(pieces) > 1, ends).otherwise(F.array().cast("array<int>"))


def total(df: DataFrame, column: str) -> DataFrame:
    """The sum, or null where it doesn't fit."""
    return df.agg(F.try_sum(column).alias("total"))


def sorted_with_rank(df: DataFrame, *by: Column) -> DataFrame:
    """Rows with their place, from 1, in a total order: ranges are sorted apart and numbered from their sizes.

    A plain row_number over everything would sort in one task.  The sorted ranges are checkpointed, as another run may cut them elsewhere.
    """
    ordered = cut(df.orderBy(*by)).withColumn("__part", F.spark_partition_id()).withColumn("__nth", F.monotonically_increasing_id())
    sizes = ordered.groupBy("__part").count()
    before = sizes.select("__part", F.coalesce(F.sum("count").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    local = F.col("__nth").bitwiseAND(F.lit((1 << 33) - 1))
    return ordered.join(F.broadcast(before), "__part").withColumn("rank", local + F.col("__before") + 1).drop("__part", "__nth", "__before")


def fnv1a32(keys: list[str | None]) -> np.ndarray:
    """32-bit FNV-1a of many strings at once; 0 for a null."""
    raw = [(k or "").encode() for k in keys]
    size = np.array([len(r) for r in raw])
    grid = np.zeros((len(raw), int(size.max(initial=0))), np.uint64)
    for i, r in enumerate(raw):
        grid[i, : len(r)] = np.frombuffer(r, np.uint8)
    h = np.full(len(raw), 0x811C9DC5, np.uint64)
    for j in range(grid.shape[1]):
        h = np.where(size > j, ((h ^ grid[:, j]) * np.uint64(0x01000193)) & np.uint64(0xFFFFFFFF), h)
    return np.where([k is None for k in keys], 0, h.astype(np.int64)) if len(raw) else h.astype(np.int64)


def ring(weights: dict[int, int], vnodes: int = 150) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, shards) of a consistent-hash ring's virtual nodes 'shard-n', in hash order."""
    names = [(f"{s}-{i}", s) for s, w in sorted(weights.items()) for i in range(vnodes * w)]
    points = dict(zip(fnv1a32([n for n, _ in names]).tolist(), (s for _, s in names)))  # of equal hashes the later shard holds
    at = sorted(points)
    return np.array(at, np.int64), np.array([points[h] for h in at], np.int64)


def assign_shards(keys: DataFrame, key: str, weights: dict[int, int], replicas: int = 1, vnodes: int = 150) -> DataFrame:
    """(key, hash, shards): the shard of the first virtual node at or after a key's hash, round the ring, and the next distinct ones."""
    hashes, owner = ring(weights, vnodes)
    replicas = min(replicas, len(set(owner.tolist())))
    follow = []
    for i in range(len(owner)):
        seen = list(dict.fromkeys(np.roll(owner, -i).tolist()))
        follow.append(seen[:replicas])

    def run(batches):
        for b in batches:
            h = fnv1a32(b.column(0).to_pylist())
            at = np.searchsorted(hashes, h) % len(hashes)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(h), pa.array([follow[i] for i in at], pa.list_(pa.int32()))], ["key", "hash", "shards"])

    return keys.select(F.col(key).cast("string").alias("key")).mapInArrow(run, "key string, hash long, shards array<int>")


def shard_stats(assigned: DataFrame) -> DataFrame:
    """Keys of each shard as first owner and as any, from assign_shards."""
    each = assigned.select(F.posexplode("shards").alias("nth", "shard"))
    return each.groupBy("shard").agg(F.count_if(F.col("nth") == 0).alias("owned"), F.count(F.lit(1)).alias("held"))


def moved(keys: DataFrame, key: str, before: dict[int, int], after: dict[int, int], vnodes: int = 150) -> DataFrame:
    """(from_shard, to_shard, keys): what changing the shards of a ring moves."""
    a = assign_shards(keys, key, before, 1, vnodes).select("key", F.col("shards")[0].alias("from_shard"))
    b = assign_shards(keys, key, after, 1, vnodes).select("key", F.col("shards")[0].alias("to_shard"))
    return a.distinct().join(b.distinct(), "key").where("from_shard <> to_shard").groupBy("from_shard", "to_shard").agg(F.count(F.lit(1)).alias("keys"))

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of this package
