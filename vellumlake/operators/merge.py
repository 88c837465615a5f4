"""Writes as merges: each takes the tables of before and gives those of after, and what happened.

A batch is applied as a whole against the state before it: the last row (by seq) of equal ids is stored, and every row is counted.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import doc_id, meta_changed, normal_meta

DOC = ["collection", "id", "key", "lang", "meta", "content_md", "added_at", "updated_at"]
PK = ["collection", "id"]


@dataclass
class Outcome:
    """state: documents after; counts: one row of counters; errors: (error) rows; revisions, aliases: rows to append or put."""

    state: DataFrame
    counts: DataFrame
    errors: DataFrame | None = None
    revisions: DataFrame | None = None
    aliases: DataFrame | None = None


def normal(rows: DataFrame) -> DataFrame:
    """Change rows with every column there, strings never null, and ids."""
    have = set(rows.columns)
    text = lambda c: F.coalesce(F.col(c), F.lit("")) if c in have else F.lit("")
    out = rows.select(
        text("collection").alias("collection"),
        text("key").alias("key"),
        text("lang").alias("lang"),
        (normal_meta("meta") if "meta" in have else normal_meta(F.lit(None).cast("map<string,array<string>>"))).alias("meta"),
        text("content_md").alias("content_md"),
        (F.coalesce("save_revision", F.lit(False)) if "save_revision" in have else F.lit(False)).alias("save_revision"),
        (F.coalesce("seq", F.lit(0)) if "seq" in have else F.lit(0)).cast("long").alias("seq"),
    )
    return out.withColumn("id", doc_id("collection", "key", "lang"))


def is_valid() -> Column:
    return (F.col("collection") != "") & (F.col("key") != "") & (F.col("lang") != "")


def last_of_each(rows: DataFrame) -> DataFrame:
    """The row of highest seq for each id; partial aggregation keeps one row an id on the map side."""
    rest = [c for c in rows.columns if c not in PK]
    best = rows.groupBy(*PK).agg(F.max_by(F.struct(*rest), F.struct("seq", "key", "content_md")).alias("row"))
    return best.select(*PK, "row.*")


def _known(rows: DataFrame, state: DataFrame) -> DataFrame:
    """rows with `known`: whether their id is in the state."""
    return rows.join(state.select(*PK, F.lit(True).alias("known")), PK, "left").withColumn("known", F.coalesce("known", F.lit(False)))


def _errors(rows: DataFrame) -> DataFrame:
    return rows.where(~is_valid()).select(F.concat("key", F.when((F.col("key") != "") & (F.col("lang") != ""), F.concat(F.lit("/"), "lang")).otherwise(""), F.lit(": missing "), F.when(F.col("collection") == "", "collection").otherwise("key or lang")).alias("error"))


def _revisions(written: DataFrame, saved: Column) -> DataFrame:
    return written.where(saved).select("collection", F.col("id").alias("doc_id"), F.col("updated_at").alias("ts"), F.struct(*[c for c in DOC if c != "collection"]).alias("doc"))


def upsert_batch(state: DataFrame, rows: DataFrame, now: int, always_revise: bool = False) -> Outcome:
    """Put rows: content and metadata are replaced; added_at stays unless it is 0."""
    rows = normal(rows)
    valid = rows.where(is_valid())
    last = last_of_each(valid)
    old = state.select(*PK, F.col("key").alias("old_key"), F.col("lang").alias("old_lang"), F.col("meta").alias("old_meta"), F.col("content_md").alias("old_content"), F.col("added_at").alias("old_added"), F.col("updated_at").alias("old_updated"))
    new = last.select(*PK, "key", "lang", "meta", "content_md", "save_revision", F.lit(True).alias("new"))
    both = old.join(new, PK, "full_outer")
    pick = lambda new_, old_: F.when(F.col("new"), F.col(new_)).otherwise(F.col(old_))
    merged = both.select(
        *PK,
        pick("key", "old_key").alias("key"),
        pick("lang", "old_lang").alias("lang"),
        pick("meta", "old_meta").alias("meta"),
        pick("content_md", "old_content").alias("content_md"),
        F.when(F.col("new"), F.coalesce(F.nullif("old_added", F.lit(0)), F.lit(now))).otherwise(F.col("old_added")).cast("long").alias("added_at"),
        F.when(F.col("new"), F.lit(now)).otherwise(F.col("old_updated")).cast("long").alias("updated_at"),
        F.coalesce("new", F.lit(False)).alias("new"),
        F.coalesce("save_revision", F.lit(False)).alias("save_revision"),
        (F.col("new") & meta_changed("old_meta", "meta")).alias("reindexed"),
    )
    seen = _known(rows, state)
    counts = seen.agg(
        F.count_if(is_valid() & ~F.col("known")).alias("added"),
        F.count_if(is_valid() & F.col("known")).alias("updated"),
        F.count_if(~is_valid()).alias("failed"),
    )
    saved = F.col("new") & (F.lit(always_revise) | F.col("save_revision"))
    aliases = valid.select("collection", "key", "lang", "id").distinct()
    return Outcome(merged.select(*DOC), counts, _errors(rows), _revisions(merged, saved), aliases)


def update_batch(state: DataFrame, rows: DataFrame, now: int) -> Outcome:
    """As upsert_batch, for documents that exist; others are counted, and aliases stay as they are."""
    rows = normal(rows)
    seen = _known(rows, state)
    hits = seen.where(is_valid() & F.col("known")).drop("known")
    last = last_of_each(hits).select(*PK, F.col("key").alias("k"), F.col("lang").alias("l"), F.col("meta").alias("m"), F.col("content_md").alias("c"), F.col("save_revision").alias("save"), F.lit(True).alias("new"))
    both = state.join(last, PK, "left")
    pick = lambda new_, old_: F.when(F.col("new"), F.col(new_)).otherwise(F.col(old_)).alias(old_)
    merged = both.select(
        *PK, pick("k", "key"), pick("l", "lang"), pick("m", "meta"), pick("c", "content_md"),
        F.when(F.col("new"), F.coalesce(F.nullif("added_at", F.lit(0)), F.lit(now))).otherwise(F.col("added_at")).cast("long").alias("added_at"),
        F.when(F.col("new"), F.lit(now)).otherwise(F.col("updated_at")).cast("long").alias("updated_at"),
        F.coalesce("save", F.lit(False)).alias("save"),
    )
    counts = seen.agg(F.count_if(is_valid() & F.col("known")).alias("updated"), F.count_if(is_valid() & ~F.col("known")).alias("not_found"), F.count_if(~is_valid()).alias("failed"))
    return Outcome(merged.select(*DOC), counts, _errors(rows), _revisions(merged, F.col("save")))


def delete_batch(state: DataFrame, rows: DataFrame) -> Outcome:
    """Without the documents that rows name; every row counts by the state before."""
    rows = normal(rows)
    seen = _known(rows, state)
    counts = seen.agg(F.count_if(is_valid() & F.col("known")).alias("deleted"), F.count_if(is_valid() & ~F.col("known")).alias("not_found"), F.count_if(~is_valid()).alias("failed"))
    gone = rows.where(is_valid()).select(*PK).distinct()
    return Outcome(state.join(gone, PK, "left_anti"), counts, _errors(rows), aliases=rows.where(is_valid()).select("collection", "key", "lang", "id").distinct())


def delete_collection(state: DataFrame, collection: str) -> Outcome:
    return Outcome(state.where(F.col("collection") != collection), state.agg(F.count_if(F.col("collection") == collection).alias("deleted")))


def append_revisions(revisions: DataFrame, new: DataFrame) -> DataFrame:
    """Both; of equal (collection, doc_id, ts) the newly written one."""
    tagged = revisions.withColumn("age", F.lit(0)).unionByName(new.withColumn("age", F.lit(1)))
    return tagged.groupBy("collection", "doc_id", "ts").agg(F.max_by("doc", "age").alias("doc"))


def truncate(revisions: DataFrame, docs: DataFrame, collection: str, keep: int) -> DataFrame:
    """Revisions of which each living document of a collection keeps its newest `keep`; fewer than 0: all stay."""
    if keep < 0:
        return revisions
    living = docs.where(F.col("collection") == collection).select("collection", F.col("id").alias("doc_id"), F.lit(True).alias("alive"))
    nth = F.row_number().over(Window.partitionBy("collection", "doc_id").orderBy(F.col("ts").desc()))
    marked = revisions.where(F.col("collection") == collection).join(living, ["collection", "doc_id"], "left").withColumn("nth", nth)
    kept = marked.where(F.col("alive").isNull() | (F.col("nth") <= keep)).drop("alive", "nth")
    return revisions.where(F.col("collection") != collection).unionByName(kept)


def as_of(revisions: DataFrame, ts: int) -> DataFrame:
    """The newest revision of each document at a time."""
    then = revisions.where(F.col("ts") <= ts)
    return then.groupBy("collection", "doc_id").agg(F.max("ts").alias("ts"), F.max_by("doc", "ts").alias("doc"))


def drop_older(versions: DataFrame, by: list[str], ts: str, cutoff: int) -> DataFrame:
    """Versions not older than the cutoff, and each one's newest in any case."""
    newest = F.max(ts).over(Window.partitionBy(*by))
    return versions.withColumn("__newest", newest).where((F.col(ts) >= cutoff) | (F.col(ts) == F.col("__newest"))).drop("__newest")


def fold_changes(changes: DataFrame, by: list[str], upto: Column | None = None) -> DataFrame:
    """The state that a log of (ts, seq, op, ...) leaves: each key's last change, unless that is a delete."""
    if upto is not None:
        changes = changes.where(upto)
    rest = [c for c in changes.columns if c not in by]
    last = changes.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct("ts", "seq")).alias("last"))
    return last.select(*by, "last.*").where("op <> 'delete'")


def snapshot_read(versions: DataFrame, key: str, txn: int) -> DataFrame:
    """Each key's newest visible version at a transaction; deleted ones are absent."""
    seen = versions.where(F.col("visible") & (F.col("txn_id") <= txn))
    rest = [c for c in versions.columns if c != key]
    return seen.groupBy(key).agg(F.max_by(F.struct(*rest), "txn_id").alias("v")).select(key, "v.*").where(~F.col("deleted"))
