"""Folders of markdown, NDJSON and ZIP."""

from __future__ import annotations

import io
import os
import sys
import zipfile

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import frontmatter, parse_meta, safe_name, slugify
from ..schema import META


def _without(entries: Column, others: Column) -> Column:
    return F.filter(entries, lambda e: ~F.exists(others, lambda x: x["key"] == e["key"]))


def markdown_folder(spark: SparkSession, path: str, collection: str, lang: str = "en_US", meta: str = "", recursive: bool = False, with_frontmatter: bool = True, cli_compat: bool = False) -> DataFrame:
    """Change rows (collection, key, lang, meta, content_md) of a folder's *.md files, one scan of whole files.

    A file's metadata is source and filename, then `meta` (mini-syntax), then its frontmatter, which stays in the content; later ones win.
    cli_compat keeps only the part of a frontmatter value before its first comma.
    """
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=recursive, pathGlobFilter="*.md")
    name = F.element_at(F.split(F.input_file_name(), "/"), -1)
    name = F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))
    lists = lambda m: F.transform_values(m, lambda k, v: F.array(v))
    parts = [F.array(F.struct(F.lit("source").alias("key"), F.array(F.lit("folder-import")).alias("value")), F.struct(F.lit("filename").alias("key"), F.array(F.col("name")).alias("value")))]
    if meta:
        parts.append(F.map_entries(parse_meta(F.lit(meta))))
    if with_frontmatter:
        parts.append(F.map_entries(lists(frontmatter("value", cli_compat))))
    merged = parts[0]
    for p in parts[1:]:  # entries of a later part replace those of the same key
        merged = F.concat(_without(merged, p), p)
    rows = files.select(name.alias("name"), "value").select(F.lit(collection).alias("collection"), slugify("name").alias("key"), F.lit(lang).alias("lang"), F.map_from_entries(merged).alias("meta"), F.col("value").alias("content_md"))
    return rows.where("key <> ''")


def ndjson_lines(docs: DataFrame) -> DataFrame:
    """One JSON object a document, fields in their published order."""
    doc = F.struct("id", "key", "lang", "meta", F.col("content_md").alias("contentMd"), F.col("added_at").alias("addedAt"), F.col("updated_at").alias("updatedAt"))
    return docs.select("id", F.to_json(doc).alias("line"))


def write_ndjson(docs: DataFrame, path: str) -> None:
    ndjson_lines(docs).sortWithinPartitions("id").select("line").write.mode("errorifexists").text(path)


def read_ndjson(spark: SparkSession, path: str, collection: str) -> DataFrame:
    schema = "id string, key string, lang string, meta map<string,array<string>>, contentMd string, addedAt long, updatedAt long"
    j = spark.read.schema(schema).json(path)
    return j.select(F.lit(collection).alias("collection"), "id", "key", "lang", F.col("meta").cast(META), F.col("contentMd").alias("content_md"), F.col("addedAt").alias("added_at"), F.col("updatedAt").alias("updated_at"))


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """JSON add requests as change rows, numbered in file order."""
    schema = "collection string, key string, lang string, meta map<string,array<string>>, contentMd string, saveRevision boolean"
    j = spark.read.schema(schema).json(path)
    return j.select("collection", "key", "lang", "meta", F.col("contentMd").alias("content_md"), F.col("saveRevision").alias("save_revision"), F.monotonically_increasing_id().alias("seq"))


def zip_names(docs: DataFrame) -> DataFrame:
    """The archive's entry name of each document."""
    return docs.select("id", F.concat(safe_name("key"), F.lit("."), safe_name("lang"), F.lit(".md")).alias("file_name"))


def write_zip(docs: DataFrame, path: str) -> int:
    """An archive of the contents, streamed through the driver one partition at a time; the number of entries."""
    n = 0
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        rows = docs.select("id", F.concat(safe_name("key"), F.lit("."), safe_name("lang"), F.lit(".md")).alias("name"), "content_md").orderBy("id")
        for r in rows.toLocalIterator():
            z.writestr(r["name"], r["content_md"] or "")
            n += 1
    return n


def write_zip_parts(docs: DataFrame, path: str) -> None:
    """An archive for each partition, written where the partition lies: the way out for exports beyond one machine."""

    def pack(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        os.makedirs(path, exist_ok=True)
        out, n = io.BytesIO(), 0
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for b in batches:
                for name, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    z.writestr(name, text or "")
                    n += 1
        if n:
            part = os.path.join(path, f"part-{TaskContext.get().partitionId():05d}.zip")
            with open(part + ".tmp", "wb") as f:
                f.write(out.getvalue())
            os.replace(part + ".tmp", part)  # a task that runs again leaves the same file
            yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([n])], ["part", "n"])

    docs.select(F.concat(safe_name("key"), F.lit("."), safe_name("lang"), F.lit(".md")).alias("name"), "content_md").mapInArrow(pack, "part string, n long").count()

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of this package
