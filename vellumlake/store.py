"""Versioned tables in a folder that all executors share: immutable snapshots and a manifest that names the newest.

A commit writes its tables beside the others and then publishes manifest n + 1, which fails if another writer has published it.
Readers hold the snapshot that they began with, so nothing that is read is ever overwritten.
"""

from __future__ import annotations

import json
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession

from .schema import ALIASES, DOCS, REVISIONS

TABLES = {"docs": DOCS, "aliases": ALIASES, "revisions": REVISIONS}


class Conflict(RuntimeError):
    """Another writer has published the version that this commit would have."""


class Store:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _read(self, name: str) -> str:
        stream = self._fs.open(self._path(f"{self.root}/{name}"))
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def versions(self) -> list[int]:
        folder = self._path(f"{self.root}/_manifest")
        if not self._fs.exists(folder):
            return []
        return sorted(int(s.getPath().getName()[:-5]) for s in self._fs.listStatus(folder) if s.getPath().getName().endswith(".json"))

    def version(self) -> int:
        """The newest version; 0 of an empty store."""
        return (self.versions() or [0])[-1]

    def table(self, name: str, version: int | None = None) -> DataFrame:
        version = self.version() if version is None else version
        if version and (path := json.loads(self._read(f"_manifest/{version}.json"))["tables"].get(name)):
            return self.spark.read.schema(TABLES[name]).parquet(f"{self.root}/{path}")
        return self.spark.createDataFrame([], TABLES[name])

    def commit(self, base: int, **tables: DataFrame) -> int:
        """Publish new states of some tables on top of version `base`."""
        paths = json.loads(self._read(f"_manifest/{base}.json"))["tables"] if base else {}

        def write(name: str) -> None:
            tables[name].select(*[f.name for f in TABLES[name].fields]).write.option("compression", "zstd").parquet(f"{self.root}/{paths[name]}")

        for name in tables:
            paths[name] = f"{name}/{base + 1:020d}-{uuid.uuid4().hex}"
        with ThreadPoolExecutor(len(TABLES)) as beside:  # the tables don't depend on each other
            list(beside.map(write, tables))
        target = self._path(f"{self.root}/_manifest/{base + 1}.json")
        if self._fs.exists(target):
            raise Conflict(f"version {base + 1} is there already")
        draft = self._path(f"{self.root}/_manifest/.{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps({"version": base + 1, "tables": paths}).encode()))
        out.close()
        if self._fs.exists(target) or not self._fs.rename(draft, target):
            self._fs.delete(draft, False)
            raise Conflict(f"version {base + 1} is there already")
        return base + 1

    def backup(self, to: str) -> str:
        """A copy of the newest snapshot as a store of its own."""
        other, at = Store(self.spark, to), self.version()
        if other.version():
            raise FileExistsError(to)
        other.commit(0, **{name: self.table(name, at) for name in TABLES})
        return to

    def restore(self, source: str) -> int:
        """Publish another store's newest snapshot as this one's next."""
        other = Store(self.spark, source)
        if not other.version():
            raise FileNotFoundError(source)
        return self.commit(self.version(), **{name: other.table(name) for name in TABLES})
