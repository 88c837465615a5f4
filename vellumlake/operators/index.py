"""The inverted metadata index, always derived from the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = ["collection", "meta_key", "meta_value", "doc_id"]


def build_index(docs: DataFrame) -> DataFrame:
    """The set of (collection, meta_key, meta_value, doc_id); content is never read."""
    by_key = docs.select("collection", F.col("id").alias("doc_id"), F.explode("meta").alias("meta_key", "values"))
    return by_key.select("collection", "meta_key", F.explode("values").alias("meta_value"), "doc_id").dropDuplicates().select(*KEYS)


def index_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Postings to delete and to put, from the index of before and after: KEYS and op ('del' or 'put')."""
    both = old.withColumn("was", F.lit(True)).join(new.withColumn("is", F.lit(True)), KEYS, "full_outer")
    return both.where("was is null or is is null").select(*KEYS, F.when(F.col("is").isNull(), "del").otherwise("put").alias("op"))


def postings(index: DataFrame, collection: str, key: str, values: list[str]) -> DataFrame:
    """Ids with any of the values under a key."""
    return index.where((F.col("collection") == collection) & (F.col("meta_key") == key) & F.col("meta_value").isin(values)).select("doc_id").distinct()


def matching_ids(index: DataFrame, collection: str, filters: dict[str, list[str]]) -> DataFrame:
    """Ids that have, for every key, one of its values: one pass over the index and one aggregation."""
    any_of = F.lit(False)
    for k, vs in filters.items():
        any_of = any_of | ((F.col("meta_key") == k) & F.col("meta_value").isin(list(vs)))
    hits = index.where((F.col("collection") == collection) & any_of)
    return hits.groupBy("doc_id").agg(F.countDistinct("meta_key").alias("n")).where(F.col("n") == len(filters)).select("doc_id")
