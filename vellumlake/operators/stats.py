"""Counts of collections, storage tiers, and the index advisor."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import storage_tier


def collection_stats(docs: DataFrame, revisions: DataFrame, index: DataFrame) -> DataFrame:
    """documents, revisions and index rows of each collection that any of them names: one union, one aggregation."""
    tagged = None
    for kind, df in enumerate((docs, revisions, index)):
        part = df.select("collection", F.lit(kind).alias("kind"))
        tagged = part if tagged is None else tagged.unionByName(part)
    count = lambda k: F.count_if(F.col("kind") == k)
    return tagged.groupBy("collection").agg(count(0).alias("document_count"), count(1).alias("revision_count"), count(2).alias("meta_index_count"))


def totals(stats: DataFrame) -> DataFrame:
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(f"total_{c}")
    return stats.agg(F.count(F.lit(1)).alias("collections"), *map(total, ("document_count", "revision_count", "meta_index_count")))


def tiers(docs: DataFrame) -> DataFrame:
    """How many documents and bytes each storage encoding takes."""
    return docs.groupBy(storage_tier("content_md").alias("tier")).agg(F.count(F.lit(1)).alias("documents"), F.sum(F.octet_length("content_md").cast("long")).alias("bytes"))


def index_advice(log: DataFrame, since: int | None = None) -> DataFrame:
    """From a query log (collection, pattern, ts, rows, millis): the index that most patterns of a collection suggest.

    A pattern of ten samples and under 10 ms on average suggests, by the rows of its last query, bloom (none), hash (one), btree (under 100),
    bitmap (under 10,000) or full; other patterns vote for hash.  Patterns last seen before `since` don't vote; equal votes go to the first name.
    """
    by = log.groupBy("collection", "pattern").agg(F.count(F.lit(1)).alias("samples"), F.avg("millis").alias("millis"), F.max_by("rows", F.struct("ts", "rows")).alias("rows"), F.max("ts").alias("seen"))
    if since is not None:
        by = by.where(F.col("seen") >= since)
    sure = (F.col("samples") >= 10) & (F.col("millis") < 10)
    kind = F.when(~sure, "hash").when(F.col("rows") == 0, "bloom").when(F.col("rows") == 1, "hash").when(F.col("rows") < 100, "btree").when(F.col("rows") < 10000, "bitmap").otherwise("full")
    votes = by.groupBy("collection", kind.alias("index_type")).agg(F.count(F.lit(1)).alias("votes"))
    first = F.row_number().over(Window.partitionBy("collection").orderBy(F.desc("votes"), "index_type"))
    return votes.withColumn("nth", first).where("nth = 1").drop("nth")
