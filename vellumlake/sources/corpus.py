"""The document model over the star-schema test tables: documents, revisions, changes and versions for queries and benchmarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import doc_id

T0 = 1_704_067_200
LANGS = {"en": "en_US", "de": "de_DE", "fr": "fr_FR"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _single(value) -> F.Column:
    return F.array(value.cast("string"))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with labels as DOCS rows: metadata size, lang, tag (source, lang, and form) and, where labelled, quality and toxic."""
    d, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    joined = d.join(labels, "doc_id", "left")
    lang = F.lit("es_ES")
    for short, long_ in LANGS.items():
        lang = F.when(F.col("lang") == short, long_).otherwise(lang)
    size = F.when(F.length("text") < 1024, "short").when(F.length("text") < 10240, "medium").otherwise("long")
    tag = F.array_compact(F.array(F.col("source"), F.col("lang"), F.when(F.col("text").contains("|"), "table"), F.when(F.col("text").contains("\n"), "lines")))
    entries = F.array(
        F.struct(F.lit("size").alias("key"), _single(size).alias("value")),
        F.struct(F.lit("lang").alias("key"), _single(F.col("lang")).alias("value")),
        F.struct(F.lit("tag").alias("key"), tag.alias("value")),
        F.struct(F.lit("quality").alias("key"), _single(F.col("quality")).alias("value")),
        F.struct(F.lit("toxic").alias("key"), _single(F.col("toxic")).alias("value")),
    )
    meta = F.map_from_entries(F.filter(entries, lambda e: e["value"][0].isNotNull()))
    key = F.concat(F.lit("Doc-"), F.col("doc_id"))
    added = (F.lit(T0) + F.col("doc_id") * 60).cast("long")
    return joined.select(
        F.col("source").alias("collection"),
        doc_id(F.col("source"), key, lang).alias("id"),
        key.alias("key"),
        lang.alias("lang"),
        meta.alias("meta"),
        F.col("text").alias("content_md"),
        added.alias("added_at"),
        (added + F.pmod("doc_id", F.lit(7)) * 3600).cast("long").alias("updated_at"),
    )


def aliases(docs: DataFrame) -> DataFrame:
    return docs.select("collection", "key", "lang", "id")


def edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch: every labelled document with a note (existing ids), every page (new ids), and every benchmark item without a language (invalid)."""
    d, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    base = corpus(spark, sf_dir).withColumn("n", F.substring_index("key", "-", -1).cast("long"))
    known = base.join(labels.select(F.col("doc_id").alias("n")).distinct(), "n", "left_semi")
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<array<string>>"))
    one = lambda k, v: F.map_from_arrays(F.array(F.lit(k)), F.array(F.array(v)))
    old = known.select("collection", "key", "lang", one("state", F.lit("edited")).alias("meta"), F.concat("content_md", F.lit(" (edited)")).alias("content_md"), F.lit(True).alias("save_revision"), F.col("n").alias("seq"))
    new = table(spark, sf_dir, "pages").select(F.lit("pages").alias("collection"), F.concat(F.lit("Page-"), "page_id").alias("key"), F.lit("en_US").alias("lang"), one("url", F.col("url")).alias("meta"), F.col("html").alias("content_md"), F.lit(False).alias("save_revision"), F.col("page_id").alias("seq"))
    bad = table(spark, sf_dir, "benchmark").select(F.lit("pages").alias("collection"), F.concat(F.lit("Item-"), "item_id").alias("key"), F.lit("").alias("lang"), empty.alias("meta"), F.col("text").alias("content_md"), F.lit(False).alias("save_revision"), F.col("item_id").alias("seq"))
    return old.unionByName(new).unionByName(bad)


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch with many rows for one id: the turns of each conversation, the last of which wins."""
    return table(spark, sf_dir, "conversations").select(
        F.lit("talk").alias("collection"), F.concat(F.lit("Conv-"), "conv_id").alias("key"), F.lit("en_US").alias("lang"),
        F.map_from_arrays(F.array(F.lit("role")), F.array(F.array("role"))).alias("meta"), F.col("text").alias("content_md"), F.lit(True).alias("save_revision"), F.col("turn").alias("seq"),
    )


def revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as revisions: a conversation is a document, a turn a revision of it."""
    t = table(spark, sf_dir, "conversations")
    key, lang, ts = F.concat(F.lit("Conv-"), F.col("conv_id")), F.lit("en_US"), (F.lit(T0) + F.col("turn")).cast("long")
    id_ = doc_id(F.lit("talk"), key, lang)
    meta = F.map_from_arrays(F.array(F.lit("role")), F.array(F.array("role")))
    doc = F.struct(id_.alias("id"), key.alias("key"), lang.alias("lang"), meta.alias("meta"), F.col("text").alias("content_md"), F.lit(T0).cast("long").alias("added_at"), ts.alias("updated_at"))
    return t.select(F.lit("talk").alias("collection"), id_.alias("doc_id"), ts.alias("ts"), doc.alias("doc"))


def talk_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The living documents of the revisions: conversations whose first turn is the user's."""
    first = table(spark, sf_dir, "conversations").where("turn = 0 and role = 'user'")
    return first.select(F.lit("talk").alias("collection"), doc_id(F.lit("talk"), F.concat(F.lit("Conv-"), F.col("conv_id")), F.lit("en_US")).alias("id"))


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a change log of users: an error deletes."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("entity"), F.unix_timestamp("ts").alias("ts"), F.col("event_id").alias("seq"),
        F.when(F.col("event_type") == "error", "delete").otherwise("upsert").alias("op"), F.col("event_type").alias("value"),
    )
