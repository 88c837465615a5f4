"""Calls end to end, with the small cases of the document model."""

import json
import zipfile

import pytest

from vellumlake.cli import main
from vellumlake.engine import Engine, EngineError, NotFound, ReadOnly
from vellumlake.store import Conflict
from vellumlake.streaming import change_stream, maintain


class Clock:
    now = 100

    def __call__(self):
        return self.now


@pytest.fixture
def clock():
    return Clock()


@pytest.fixture
def engine(spark, tmp_path, clock):
    return Engine(spark, f"file://{tmp_path}/store", clock=clock)


def test_add_get_search_flow(engine, clock):
    a = engine.add("blog", "Homepage", "en_GB", {"category": ["blog"], "author": ["John Doe"]}, "# Hi %%name%%")
    assert a["id"] == "blog|homepage|en_gb" and a["added_at"] == a["updated_at"] == 100
    clock.now = 200
    b = engine.add("blog", "homepage", "en_gb", {"category": ["tutorial"]}, "v2 %%name%%")
    assert (b["added_at"], b["updated_at"], b["key"], b["meta"]) == (100, 200, "homepage", {"category": ["tutorial"]})
    assert engine.get("blog", "Homepage", "en_GB", {"name": "Ann"})["content_md"] == "v2 Ann"
    with pytest.raises(NotFound):
        engine.get("blog", "HOMEPAGE", "en_GB")
    assert [r["ts"] for r in engine.revisions("blog", "homepage", "en_gb").collect()] == [200, 100]
    assert engine.as_of("blog", 150).first()["doc"]["content_md"] == "# Hi %%name%%"
    engine.delete("blog", "homepage", "en_gb")
    for spelling in (("Homepage", "en_GB"), ("homepage", "en_gb")):
        with pytest.raises(NotFound):
            engine.get("blog", *spelling)
    with pytest.raises(NotFound):
        engine.delete("blog", "homepage", "en_gb")
    assert engine.store.table("revisions").count() == 0


def test_search_pages_and_filters(engine):
    rows = [{"key": f"post{i}", "lang": "en", "meta": {"category": ["blog" if i < 2 else "news"], "author": ["John Doe"]}, "content_md": "x" * i} for i in range(4)]
    assert engine.add_batch(rows, "blog") == {"added": 4, "updated": 0, "failed": 0, "errors": []}
    keys = lambda df: [r["key"] for r in df.collect()]
    assert keys(engine.search("blog", {"category": ["blog", "tutorial"], "author": ["John Doe"]}, "key", True)) == ["post0", "post1"]
    assert keys(engine.search("blog", {"category": []})) == []
    assert len(keys(engine.search("blog", {}))) == 4 and keys(engine.search("", {})) == []
    assert keys(engine.search("blog", sort="key", asc=False, limit=2, offset=1)) == ["post2", "post1"]
    assert keys(engine.search("blog", sort="key", asc=True, offset=-1, limit=1)) == ["post0"] and keys(engine.search("blog", offset=10**6)) == []
    assert keys(engine.search("blog", sort="updatedAt")) == ["post0", "post1", "post2", "post3"]  # ties by id
    assert {r["total"] for r in engine.search("blog", limit=2, total=True).collect()} == {4}
    assert keys(engine.query("blog").where("category", "news").order_by("key").page(1).rows()) == ["post2"]
    assert keys(engine.resolve("x-search://blog?meta.category=news&sort=key&asc=true")) == ["post2", "post3"]
    assert engine.resolve("x://blog/post1?lang=en")["key"] == "post1"
    assert engine.sql("SELECT count(*) AS n FROM idxmeta WHERE meta_key = 'author'").first()["n"] == 4


def test_batches(engine, clock):
    out = engine.add_batch([{"key": "a", "lang": "en", "content_md": "1", "save_revision": True}, {"key": "A", "lang": "en", "content_md": "2", "save_revision": True}, {"key": "b", "lang": ""}], "c")
    assert out == {"added": 2, "updated": 0, "failed": 1, "errors": ["b: missing key or lang"]}
    assert engine.get("c", "a", "en")["content_md"] == "2" and engine.store.table("revisions").count() == 1
    clock.now = 300
    out = engine.update_batch([{"key": "a", "lang": "en", "content_md": "3"}, {"key": "zz", "lang": "en"}], "c")
    assert (out["updated"], out["not_found"], out["failed"], out["errors"]) == (1, 1, 0, [])
    got = engine.get("c", "a", "en")
    assert (got["content_md"], got["added_at"], got["updated_at"]) == ("3", 100, 300)
    out = engine.delete_batch([{"key": "a", "lang": "en"}, {"key": "a", "lang": "en"}, {"key": "zz", "lang": "en"}], "c")
    assert (out["deleted"], out["not_found"]) == (2, 1)
    assert engine.docs().count() == 0


def test_same_second_keeps_one_revision(engine, clock):
    for text in ("1", "2"):
        engine.add("c", "k", "en", {}, text)
    assert [r["doc"]["content_md"] for r in engine.revisions("c", "k", "en").collect()] == ["2"]


def test_truncate(engine, clock):
    for i in range(4):
        clock.now = 100 + i
        engine.add("c", "k", "en", {}, str(i))
    engine.truncate("c", -1)
    assert engine.revisions("c", "k", "en").count() == 4
    engine.truncate("c", 2)
    assert [r["ts"] for r in engine.revisions("c", "k", "en").collect()] == [103, 102]
    engine.truncate("c", 0)
    assert engine.revisions("c", "k", "en").count() == 0


def test_collections_and_stats(engine):
    engine.add("a", "k", "en", {"t": ["x", "y", "x"]}, "1")
    engine.add("b", "k", "en", {}, "1")
    by, total = engine.stats()
    assert [tuple(r) for r in by.collect()] == [("a", 1, 1, 2), ("b", 1, 1, 0)] and tuple(total.first()) == (2, 2, 2, 2)
    assert engine.delete_collection("a") == 1 and engine.docs().count() == 1
    assert engine.delete_collection("nothing") == 0


def test_modes_and_errors(engine, spark, tmp_path):
    engine.add("c", "k", "en", {}, "1")
    reader = Engine(spark, engine.store.root, "read")
    assert reader.get("c", "k", "en")["content_md"] == "1" and reader.health()["mode"] == "read"
    for call in (lambda: reader.add("c", "k", "en"), lambda: reader.truncate("c", 1), lambda: reader.delete_collection("c"), lambda: reader.restore("x")):
        with pytest.raises(ReadOnly):
            call()
    Engine(spark, engine.store.root, "write").add("c", "k2", "en")
    with pytest.raises(EngineError):
        engine.add("c", "", "en")
    with pytest.raises(EngineError):
        engine.export("c", str(tmp_path / "x"), "xml")


def test_export_round_trip_and_backup(engine, spark, tmp_path):
    from vellumlake.sources import files

    engine.add("c", "K 1", "en", {"a": ["1"]}, "text\nmore")
    engine.add("c", "k2", "en", {}, "")
    path = engine.export("c", f"file://{tmp_path}/nd")
    line = min(r["value"] for r in spark.read.text(path).collect())
    assert list(json.loads(line)) == ["id", "key", "lang", "meta", "contentMd", "addedAt", "updatedAt"]
    back = files.read_ndjson(spark, path, "c").select(*engine.docs().columns)
    assert sorted(map(str, back.collect())) == sorted(map(str, engine.docs().collect()))
    z = engine.export("c", str(tmp_path / "x.zip"), "zip")
    with zipfile.ZipFile(z) as f:
        assert f.namelist() == ["K-1.en.md", "k2.en.md"] and f.read("K-1.en.md") == b"text\nmore"
    files.write_zip_parts(engine.docs(), str(tmp_path / "zips"))
    assert sum(len(zipfile.ZipFile(p).namelist()) for p in (tmp_path / "zips").iterdir()) == 2
    to = engine.backup(f"file://{tmp_path}/copy")
    with pytest.raises(FileExistsError):
        engine.backup(to)
    engine.delete_collection("c")
    engine.restore(to)
    assert engine.get("c", "K 1", "en")["content_md"] == "text\nmore"


def test_conflicting_commits(engine):
    engine.add("c", "k", "en")
    with pytest.raises(Conflict):
        engine.store.commit(engine.store.version() - 1, docs=engine.docs())


def test_old_versions_stay_readable(engine):
    engine.add("c", "k", "en", {}, "1")
    v = engine.store.version()
    engine.add("c", "k", "en", {}, "2")
    assert engine.store.table("docs", v).first()["content_md"] == "1"


def test_folder(engine, tmp_path):
    d = tmp_path / "md"
    (d / "sub").mkdir(parents=True)
    (d / "My Document (v2).md").write_text("---\nauthor: Jane\ntags: a, b\nstatus: published\n---\n# T\n")
    (d / "Other.txt").write_text("no")
    (d / "sub" / "Deep.md").write_text("# deep")
    assert engine.load_folder(f"file://{d}", "docs", meta="status=draft,category=tutorial")["added"] == 1
    got = engine.get("docs", "my-document-v2", "en_US")
    assert got["meta"] == {"source": ["folder-import"], "filename": ["My Document (v2).md"], "category": ["tutorial"], "author": ["Jane"], "tags": ["a, b"], "status": ["published"]}
    assert engine.load_folder(f"file://{d}", "docs", recursive=True, cli_compat=True) == {"added": 1, "updated": 1, "failed": 0, "errors": []}
    assert engine.get("docs", "my-document-v2", "en_US")["meta"]["tags"] == ["a"]


def test_stream(engine, spark, tmp_path):
    schema = "collection string, key string, lang string, content_md string, op string, ts long, seq long"
    for i, rows in enumerate([[("c", "a", "en", "1", "upsert", 1, 1), ("c", "b", "en", "1", "upsert", 1, 2)], [("c", "a", "en", "2", "upsert", 2, 3), ("c", "b", "en", None, "delete", 3, 4), ("c", "b", "en", "x", "upsert", 2, 5)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in{i}")
    for i in range(2):
        maintain(engine, change_stream(spark, f"file://{tmp_path}/in{i}", schema), f"file://{tmp_path}/cp{i}").awaitTermination()
    assert [(r["key"], r["content_md"]) for r in engine.docs().collect()] == [("a", "2")]


def test_cli(spark, tmp_path, capsys, monkeypatch):
    import io

    root = ["--root", f"file://{tmp_path}/s"]
    monkeypatch.setattr("sys.stdin", io.StringIO("Hi %%n%%"))
    assert main([*root, "add", "c", "K", "en", "-m", "t=a|b"], spark) == 0
    assert main([*root, "get", "c", "K", "en", "-e", "n=Ann", "--content-only"], spark) == 0
    assert main([*root, "search", "c", "-f", "t=b"], spark) == 0
    assert main([*root, "stats"], spark) == 0
    assert main([*root, "get", "c", "none", "en"], spark) == 1
    out = capsys.readouterr().out
    assert "Hi Ann" in out and '"document_count": 1' in out
