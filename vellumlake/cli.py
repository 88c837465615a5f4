"""python -m vellumlake.cli --root DIR add|get|search|export|backup|restore|truncate|stats ..."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .engine import Engine, EngineError
from .functions import iso_time, parse_env, parse_meta


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="vellumlake", description=__doc__)
    p.add_argument("--root", required=True)
    p.add_argument("--mode", default="wr", choices=["read", "write", "wr"])
    c = p.add_subparsers(dest="call", required=True)

    def call(name: str, *fields: str) -> argparse.ArgumentParser:
        s = c.add_parser(name)
        for f in fields:
            s.add_argument(f)
        return s

    s = call("add", "collection", "key", "lang")
    s.add_argument("-m", "--meta", default="")
    s.add_argument("-f", "--file", default="-")
    s = call("get", "collection", "key", "lang")
    s.add_argument("-e", "--env", default="")
    s.add_argument("--content-only", action="store_true")
    s = call("search", "collection")
    s.add_argument("-f", "--filter", default="")
    s.add_argument("-s", "--sort", default="updatedAt")
    s.add_argument("-a", "--asc", action="store_true")
    s.add_argument("-l", "--limit", type=int, default=50)
    s.add_argument("-o", "--offset", type=int, default=0)
    s = call("export", "collection", "path")
    s.add_argument("--format", default="ndjson")
    s.add_argument("-f", "--filter", default="")
    call("backup", "to")
    call("restore", "source")
    s = call("truncate", "collection")
    s.add_argument("-k", "--keep", type=int, default=5)
    call("stats")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = _parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("vellumlake").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    engine = Engine(spark, a.root, a.mode)
    parsed = lambda f, s: spark.range(1).select(f(F.lit(s)).alias("m")).first()["m"] if s else {}
    show = lambda r: print(json.dumps(r.asDict(recursive=True), ensure_ascii=False))
    try:
        if a.call == "add":
            text = sys.stdin.read() if a.file == "-" else open(a.file, encoding="utf-8").read()
            show(engine.add(a.collection, a.key, a.lang, parsed(parse_meta, a.meta), text))
        elif a.call == "get":
            row = engine.get(a.collection, a.key, a.lang, parsed(parse_env, a.env))
            print(row["content_md"]) if a.content_only else show(row)
        elif a.call == "search":
            for r in engine.search(a.collection, parsed(parse_meta, a.filter), a.sort, a.asc, a.limit, a.offset).withColumn("updated", iso_time("updated_at")).collect():
                show(r)
        elif a.call == "export":
            print(engine.export(a.collection, a.path, a.format, parsed(parse_meta, a.filter)))
        elif a.call == "backup":
            print(engine.backup(a.to))
        elif a.call == "restore":
            print(engine.restore(a.source))
        elif a.call == "truncate":
            engine.truncate(a.collection, a.keep)
        else:
            by, total = engine.stats()
            for r in [*by.collect(), *total.collect()]:
                show(r)
    except EngineError as e:
        print(json.dumps({"error": str(e)}), file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
