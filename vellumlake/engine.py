"""The engine: all calls on a store of document collections."""

from __future__ import annotations

import time
from concurrent.futures import ThreadPoolExecutor
from enum import Enum

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .functions import apply_env, as_list, doc_id, parse_uri  # noqa: F401
from .operators import merge, stats
from .operators.index import build_index
from .operators.search import Query, get_by_key
from .schema import CHANGES
from .sources import files
from .store import Store


class Mode(Enum):
    READ = "read"
    WRITE = "write"
    READ_WRITE = "wr"


class EngineError(Exception):
    """A call that can't be served."""


class NotFound(EngineError):
    pass


class ReadOnly(EngineError):
    pass


class Engine:
    """Collections under a root folder; `mode` 'read' refuses writes."""

    def __init__(self, spark: SparkSession, root: str, mode: str | Mode = Mode.READ_WRITE, clock=time.time) -> None:
        self.spark, self.store, self.mode, self.clock = spark, Store(spark, root), Mode(mode), clock

    # reading

    def health(self) -> dict:
        return {"status": "healthy" if self.spark.sql("SELECT 1").first()[0] == 1 else "unhealthy", "mode": self.mode.value, "version": self.store.version()}

    def docs(self) -> DataFrame:
        return self.store.table("docs")

    def index(self) -> DataFrame:
        return build_index(self.docs())

    def get(self, collection: str, key: str, lang: str, env: dict[str, str] | None = None) -> Row:
        self._need(collection=collection, key=key, lang=lang)
        wanted = self.spark.createDataFrame([(collection, key, lang)], "collection string, key string, lang string")
        docs = self.docs().where(F.col("collection") == collection)
        found = get_by_key(docs, self.store.table("aliases"), wanted).drop("asked_key", "asked_lang")
        if env:
            found = found.withColumn("content_md", apply_env("content_md", env))
        row = found.first()
        if row is None:
            raise NotFound(f"{collection}/{key}/{lang}")
        return row

    def search(self, collection: str, filters: dict[str, list[str]] | None = None, sort: str = "", asc: bool = False, limit: int = 0, offset: int = 0, total: bool = False) -> DataFrame:
        return Query(collection, filters or {}, sort, asc, limit, offset).of(self.docs(), total=total)

    def resolve(self, uri: str) -> Row | DataFrame:
        """The document or search that an address names."""
        u = parse_uri(uri)
        if "key" in u:
            return self.get(u["collection"], u["key"], u["lang"], u["env"])
        return self.search(u["collection"], u["filter"], u["sort"], u["asc"], u["limit"], u["offset"])

    def query(self, collection: str) -> BoundQuery:
        return BoundQuery(self, Query(collection))

    def stats(self) -> tuple[DataFrame, DataFrame]:
        """(collections in order of name, totals)."""
        by = stats.collection_stats(self.docs(), self.store.table("revisions"), self.index())
        return by.orderBy("collection"), stats.totals(by)

    def revisions(self, collection: str, key: str, lang: str) -> DataFrame:
        """A document's revisions, newest first."""
        r = self.store.table("revisions")
        return r.where((F.col("collection") == collection) & (F.col("doc_id") == doc_id(F.lit(collection), F.lit(key), F.lit(lang)))).orderBy(F.desc("ts"))

    def as_of(self, collection: str, ts: int) -> DataFrame:
        return merge.as_of(self.store.table("revisions").where(F.col("collection") == collection), ts)

    def sql(self, text: str) -> DataFrame:
        """SQL over the views docs, aliases, revisions and idxmeta."""
        for name in ("docs", "aliases", "revisions"):
            self.store.table(name).createOrReplaceTempView(name)
        self.index().createOrReplaceTempView("idxmeta")
        return self.spark.sql(text)

    def export(self, collection: str, path: str, form: str = "ndjson", filters: dict[str, list[str]] | None = None) -> str:
        found = Query(collection, filters or {}).matches(self.docs())
        if form == "ndjson":
            files.write_ndjson(found, path)
        elif form == "zip":
            files.write_zip(found, path)
        else:
            raise EngineError(f"unsupported format {form!r}")
        return path

    # writing

    def add(self, collection: str, key: str, lang: str, meta: dict | None = None, content_md: str = "", save_revision: bool = True) -> Row:
        self._need(collection=collection, key=key, lang=lang)
        self.add_batch([{"collection": collection, "key": key, "lang": lang, "meta": meta or {}, "content_md": content_md, "save_revision": save_revision, "seq": 0}])
        return self.get(collection, key, lang)

    def add_batch(self, rows, collection: str | None = None) -> dict:
        """rows: a DataFrame or dicts of change columns.  added, updated, failed and errors."""
        return self._apply(rows, collection, lambda old, new: merge.upsert_batch(old, new, self._now()))

    def update_batch(self, rows, collection: str | None = None) -> dict:
        return self._apply(rows, collection, lambda old, new: merge.update_batch(old, new, self._now()))

    def delete_batch(self, rows, collection: str | None = None) -> dict:
        return self._apply(rows, collection, merge.delete_batch, gone=True)

    def delete(self, collection: str, key: str, lang: str) -> None:
        self._need(collection=collection, key=key, lang=lang)
        done = self.delete_batch([{"collection": collection, "key": key, "lang": lang}])
        if not done["deleted"]:
            raise NotFound(f"{collection}/{key}/{lang}")

    def delete_collection(self, collection: str) -> int:
        self._need(collection=collection)
        self._writable()
        base = self.store.version()
        out = merge.delete_collection(self.store.table("docs", base), collection)
        n = out.counts.first()["deleted"]
        others = F.col("collection") != collection
        self.store.commit(base, docs=out.state, aliases=self.store.table("aliases", base).where(others), revisions=self.store.table("revisions", base).where(others))
        return n

    def truncate(self, collection: str, keep: int) -> None:
        self._need(collection=collection)
        self._writable()
        base = self.store.version()
        self.store.commit(base, revisions=merge.truncate(self.store.table("revisions", base), self.store.table("docs", base), collection, keep))

    def load_folder(self, path: str, collection: str, **how) -> dict:
        return self.add_batch(files.markdown_folder(self.spark, path, collection, **how))

    def backup(self, to: str | None = None) -> str:
        return self.store.backup(to or f"{self.store.root}-backup-{int(self.clock())}")

    def restore(self, source: str) -> str:
        self._writable()
        self.store.restore(source)
        return source

    def _now(self) -> int:
        return int(self.clock())

    def _writable(self) -> None:
        if self.mode is Mode.READ:
            raise ReadOnly("the engine is read-only")

    @staticmethod
    def _need(**fields: str) -> None:
        missing = [k for k, v in fields.items() if not v]
        if missing:
            raise EngineError("missing " + ", ".join(missing))

    def _apply(self, rows, collection: str | None, plan, gone: bool = False) -> dict:
        self._writable()
        if not isinstance(rows, DataFrame):
            names = [f.name for f in CHANGES.fields]
            rows = self.spark.createDataFrame([tuple({"seq": i, **r}.get(c) for c in names) for i, r in enumerate(rows)], CHANGES)
        if collection is not None:
            rows = rows.withColumn("collection", F.lit(collection))
        base = self.store.version()
        rows = rows.cache()  # counters and state come from the same rows; lost blocks are computed again
        try:
            out = plan(self.store.table("docs", base), rows)
            tables = {"docs": out.state}
            aliases, revisions = self.store.table("aliases", base), self.store.table("revisions", base)
            if gone:
                ids = out.aliases.select("collection", "id").distinct()
                hit = ids.join(self.store.table("docs", base).select("collection", "id"), ["collection", "id"], "left_semi")
                tables["aliases"] = aliases.join(out.aliases.join(hit, ["collection", "id"], "left_semi"), ["collection", "key", "lang"], "left_anti")
                tables["revisions"] = revisions.join(hit.withColumnRenamed("id", "doc_id"), ["collection", "doc_id"], "left_anti")
            else:
                if out.aliases is not None:
                    tables["aliases"] = aliases.unionByName(out.aliases).distinct()
                tables["revisions"] = merge.append_revisions(revisions, out.revisions)
            with ThreadPoolExecutor(1) as beside:  # the counters are taken while the tables are written
                told = beside.submit(lambda: (out.counts.first().asDict(), out.errors.orderBy("error").collect() if out.errors is not None else []))
                self.store.commit(base, **tables)
                counts, failed = told.result()
                errors = [r["error"] for r in failed]
        finally:
            rows.unpersist()
        return counts | {"errors": errors}


class BoundQuery:
    """engine.query('blog').where('tag', 'a', 'b').order_by('key').page(10).rows()"""

    def __init__(self, engine: Engine, query: Query) -> None:
        self.engine, self.query = engine, query

    def where(self, key: str, *values: str) -> BoundQuery:
        return BoundQuery(self.engine, self.query.where(key, *values))

    def order_by(self, sort: str, asc: bool = True) -> BoundQuery:
        return BoundQuery(self.engine, self.query.order_by(sort, asc))

    def page(self, limit: int, offset: int = 0) -> BoundQuery:
        return BoundQuery(self.engine, self.query.page(limit, offset))

    def rows(self, total: bool = False) -> DataFrame:
        return self.query.of(self.engine.docs(), total=total)
