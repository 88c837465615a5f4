"""Bloom filters: sets that never miss a member and let few others through."""

from __future__ import annotations

import math
import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FALSE_POSITIVES = 0.01
MAX_BYTES = 64 << 20


@dataclass(frozen=True)
class Bloom:
    bits: bytes
    hashes: int
    members: int

    def stats(self) -> dict:
        filled = int(np.unpackbits(np.frombuffer(self.bits, np.uint8)).sum()) / (8 * len(self.bits))
        return {"members": self.members, "bytes": len(self.bits), "hashes": self.hashes, "filled": filled, "expected_false_positives": filled**self.hashes}


def _places(h: np.ndarray, hashes: int, size: int) -> np.ndarray:
    a = h.view(np.uint64)
    b = (a ^ (a >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)
    return np.stack([(a + np.uint64(i) * b) % np.uint64(size) for i in range(hashes)])


def build(df: DataFrame, column: str, false_positives: float = FALSE_POSITIVES) -> Bloom | None:
    """A filter of a column's values, built in parts where they lie; None where it would outgrow MAX_BYTES."""
    members = df.select(column).distinct().where(F.col(column).isNotNull()).count()
    size = max(64, math.ceil(-max(1, members) * math.log(false_positives) / math.log(2) ** 2 / 8) * 8)
    if size // 8 > MAX_BYTES:
        return None
    hashes = max(1, round(size / max(1, members) * math.log(2)))

    def part(batches):
        bits = np.zeros(size, bool)
        for b in batches:
            bits[_places(b.column(0).to_numpy(zero_copy_only=False), hashes, size)] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bits).tobytes()])], ["bits"])

    total = np.zeros(size // 8, np.uint8)
    for r in df.where(F.col(column).isNotNull()).select(F.xxhash64(column).alias("h")).mapInArrow(part, "bits binary").toLocalIterator():
        total |= np.frombuffer(r["bits"], np.uint8)
    return Bloom(total.tobytes(), hashes, members)


def might_contain(df: DataFrame, column: str, bloom: Bloom) -> DataFrame:
    """The rows whose value may be a member; rows without a value go."""
    shared = df.sparkSession.sparkContext.broadcast((bloom.bits, bloom.hashes))
    names = df.columns

    def run(batches):
        raw, hashes = shared.value
        bits = np.frombuffer(raw, np.uint8)
        for batch in batches:
            p = _places(batch.column(len(names)).to_numpy(zero_copy_only=False), hashes, 8 * len(bits)).astype(np.int64)
            yield batch.filter(pa.array(((bits[p >> 3] >> (7 - (p & 7)).astype(np.uint8)) & 1).all(axis=0))).select(names)

    extra = "h"
    while extra in names:
        extra += "_"
    return df.where(F.col(column).isNotNull()).withColumn(extra, F.xxhash64(column)).mapInArrow(run, df.schema)


def semi_join(df: DataFrame, column: str, members: DataFrame, member: str) -> DataFrame:
    """Rows of df whose value is a member: most others go by the filter before anything is shuffled, the join settles the rest."""
    bloom = build(members, member)
    maybe = might_contain(df, column, bloom) if bloom else df
    right = members.select(F.col(member).alias("__member")).distinct()
    return maybe.join(right, maybe[column] == right["__member"], "left_semi")

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of this package
