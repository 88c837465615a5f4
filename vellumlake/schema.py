"""The document model: four tables, as Spark types."""

from __future__ import annotations

from pyspark.sql import types as T

META = T.MapType(T.StringType(), T.ArrayType(T.StringType()))

DOCS = T.StructType(
    [
        T.StructField("collection", T.StringType()),
        T.StructField("id", T.StringType()),
        T.StructField("key", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("meta", META),
        T.StructField("content_md", T.StringType()),
        T.StructField("added_at", T.LongType()),
        T.StructField("updated_at", T.LongType()),
    ]
)

ALIASES = T.StructType([T.StructField(c, T.StringType()) for c in ("collection", "key", "lang", "id")])

REVISIONS = T.StructType(
    [
        T.StructField("collection", T.StringType()),
        T.StructField("doc_id", T.StringType()),
        T.StructField("ts", T.LongType()),
        T.StructField("doc", T.StructType([f for f in DOCS.fields if f.name not in ("collection",)])),
    ]
)

INDEX = T.StructType([T.StructField(c, T.StringType()) for c in ("collection", "meta_key", "meta_value", "doc_id")])

#: What a batch row may carry; columns that are absent count as null.
CHANGES = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("collection", "key", "lang")]
    + [T.StructField("meta", META), T.StructField("content_md", T.StringType()), T.StructField("save_revision", T.BooleanType()), T.StructField("seq", T.LongType())]
)
