import zlib

import pytest
from hypothesis import given
from hypothesis import settings as h_settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vellumlake import functions as fn
from vellumlake.functions.scalars import _delta, _undelta
from vellumlake.operators import membership, vector


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "parts,want",
    [(("blog", "Homepage", "en_GB"), "blog|homepage|en_gb"), (("B", "ÄHello", "de"), "b|Ähello|de")],
)
def test_doc_id_lowers_ascii_only(spark, parts, want):
    assert one(spark, fn.doc_id(*map(F.lit, parts))) == want


def test_template(spark):
    assert one(spark, fn.apply_env(F.lit("# Welcome to %%siteName%% in %%year%%"), {"siteName": "My Blog", "year": "2024"})) == "# Welcome to My Blog in 2024"
    env = {"a": "%%b%%", "b": "2"}
    assert one(spark, fn.apply_env(F.lit("<%%a%%|%%c%%>"), env)) == "<2|%%c%%>"
    m = F.create_map(*[F.lit(x) for kv in env.items() for x in kv])
    assert one(spark, fn.apply_env(F.lit("<%%a%%|%%c%%>"), m)) == "<2|%%c%%>"
    assert one(spark, fn.apply_env(F.lit("x"), F.lit(None).cast("map<string,string>"))) == "x"


@pytest.mark.parametrize(
    "name,want",
    [("Getting Started.md", "getting-started"), ("API_Reference.md", "api-reference"), ("2024-01-15-blog-post.md", "2024-01-15-blog-post"), ("My Document (v2).md", "my-document-v2")],
)
def test_slugs(spark, name, want):
    assert one(spark, fn.slugify(F.lit(name))) == want


def test_mini_syntax(spark):
    assert one(spark, fn.parse_meta(F.lit("a=1|2,junk,b=x=y,a=3"))) == {"a": ["3"], "b": ["x=y"]}
    assert one(spark, fn.parse_env(F.lit("a=1,junk,b=x=y,a="))) == {"a": "", "b": "x=y"}
    assert one(spark, fn.parse_meta(F.lit(""))) == {}


def test_safe_name(spark):
    assert one(spark, fn.safe_name(F.lit("a b😀.c_d-e"))) == "a-b--c_d-e"


def test_frontmatter(spark):
    text = '---\ntitle: "A: b"\ntags: a, b\nnone\n---\n# T'
    assert one(spark, fn.frontmatter(F.lit(text))) == {"title": "A: b", "tags": "a, b"}
    assert one(spark, fn.frontmatter(F.lit(text), True)) == {"title": "A: b", "tags": "a"}
    for other in ("# no\n---\na: b\n---\n", "", "---\na: b\n"):
        assert one(spark, fn.frontmatter(F.lit(other))) == {}


def test_meta_changed(spark):
    def changed(a, b):
        m = lambda x: F.lit(None).cast("map<string,array<string>>") if x is None else F.from_json(F.lit(x), "map<string,array<string>>")
        return one(spark, fn.meta_changed(m(a), m(b)))

    assert not changed(None, "{}") and not changed('{"a":["1"],"b":["2"]}', '{"b":["2"],"a":["1"]}')
    assert changed('{"a":["x","y"]}', '{"a":["y","x"]}') and changed(None, '{"a":["1"]}') and changed('{"a":["1"]}', None)


def test_strings(spark):
    assert one(spark, fn.zero_pad(F.lit(42))) == "0" * 18 + "42"
    assert one(spark, fn.nth_part(F.lit("a|b"), "|", 1)) == "b" and one(spark, fn.nth_part(F.lit("a|b"), "|", 2)) is None
    assert one(spark, fn.last_index_of(F.lit("a|b|c"), "|")) == 3 and one(spark, fn.last_index_of(F.lit("abc"), "|")) == -1
    assert [one(spark, fn.human_bytes(F.lit(n))) for n in (0, 512, 1536, 1048576)] == ["0 B", "512 B", "1.5 KB", "1 MB"]
    assert one(spark, fn.iso_time(F.lit(0))) == "1970-01-01T00:00:00Z"
    assert one(spark, fn.as_list(F.lit('["a", 1]'))) == ["a", ""] and one(spark, fn.as_list(F.lit('"a"'))) == ["a"]


def test_hashes(spark):
    assert one(spark, F.crc32(F.lit("123456789"))) == zlib.crc32(b"123456789") == 3421780262
    assert one(spark, fn.fnv1a32(F.lit("foobar"))) == 0xBF9CF968
    assert one(spark, fn.fnv1a64(F.lit("foobar"))) == "85944171f73967e8"
    assert vector.fnv1a32(["foobar", "", None]).tolist() == [0xBF9CF968, 0x811C9DC5, 0]


@h_settings(max_examples=200, deadline=None)
@given(st.binary(max_size=40), st.binary(max_size=40))
def test_delta_is_exact(old, new):
    assert _undelta(old, _delta(old, new)) == new


def test_uri():
    u = fn.parse_uri("x-search://blog?meta.tag=a&meta.tag=b&meta.author=J%20D&sort=key&limit=zz&offset=5")
    assert u["filter"] == {"tag": ["a", "b"], "author": ["J D"]} and u["limit"] == 0 and u["offset"] == 5 and u["lang"] == "en_US"
    assert fn.parse_uri("x://blog/home?lang=de_DE&env.a=1") == {"collection": "blog", "lang": "de_DE", "env": {"a": "1"}, "key": "home"}
    with pytest.raises(ValueError):
        fn.parse_uri("nothing")


def test_vectors(spark):
    assert one(spark, vector.first_positions(F.lit("abxabxx"), "ab")) == [0, 3]
    assert one(spark, vector.first_positions(F.lit("zz"), "ab")) == []
    df = spark.createDataFrame([(2**62,), (2**62,)], "v long")
    assert vector.total(df, "v").first()["total"] is None
    points, owner = vector.ring({0: 1, 1: 1, 2: 2}, 10)
    assert len(points) == 40 and (owner == 2).sum() == 20
    got = vector.assign_shards(spark.createDataFrame([("k1",), ("k2",)], "k string"), "k", {0: 1, 1: 1}, replicas=5).collect()
    assert all(sorted(r["shards"]) == [0, 1] for r in got)


def test_bloom(spark):
    inside = spark.createDataFrame([(f"k{i}",) for i in range(2000)] + [(None,)], "k string")
    b = membership.build(inside, "k")
    others = spark.createDataFrame([(f"x{i}", i) for i in range(5000)], "k string, h int")
    assert membership.might_contain(inside, "k", b).count() == 2000
    assert membership.might_contain(others, "k", b).count() < 150
    assert b.stats()["members"] == 2000 and b.stats()["expected_false_positives"] < 0.02
    none = inside.limit(0)
    assert membership.might_contain(others, "k", membership.build(none, "k")).count() == 0
    assert membership.semi_join(others.union(spark.createDataFrame([("k1", 1)], "k string, h int")), "k", inside, "k").collect()[0]["k"] == "k1"


def test_ring_moves_only_to_the_new_shard(spark):
    keys = spark.createDataFrame([(f"key-{i}",) for i in range(500)], "k string")
    got = vector.moved(keys, "k", {0: 1, 1: 1}, {0: 1, 1: 1, 2: 1}).collect()
    assert {r["to_shard"] for r in got} == {2} and sum(r["keys"] for r in got) < 500
    assert sum(r["owned"] for r in vector.shard_stats(vector.assign_shards(keys, "k", {0: 1, 1: 1}, 2)).collect()) == 500


def test_checksums_are_of_the_texts(spark):
    """Against FNV-1a and CRC-32 byte by byte, also of nulls, empty, non-ASCII and long texts."""
    import zlib

    from tests.conftest import SF

    from vellumlake.plans.queries import checksums

    def fnv(x, h, p, m):
        for b in x.encode():
            h = ((h ^ b) * p) & m
        return h

    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(30).collect()] + [None, "", "É 漢字", "x" * 5000] + ["ab" * i for i in range(40)]
    want = [None if t is None else (fnv(t, 0x811C9DC5, 0x01000193, 2**32 - 1), f"{fnv(t, 0xCBF29CE484222325, 0x100000001B3, 2**64 - 1):016x}") for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").coalesce(1)
    got = df.select("i", fn.fnv1a32("t").alias("a"), fn.fnv1a64("t").alias("b")).orderBy("i").collect()
    assert [None if r.a is None and r.b is None else (r.a, r.b) for r in got] == want
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in checksums(spark, SF).orderBy("doc_id").limit(30).collect():
        t = docs[r.doc_id]
        assert (r.crc, r.fnv32, r.fnv64) == (zlib.crc32(t.encode()), fnv(t, 0x811C9DC5, 0x01000193, 2**32 - 1), f"{fnv(t, 0xCBF29CE484222325, 0x100000001B3, 2**64 - 1):016x}")


def python_nodes(df):
    """Names of the plan's nodes that send rows to Python."""
    import re

    return re.findall(r"\w*Python\w*|\w*InArrow\w*|\w*InPandas\w*", df._jdf.queryExecution().optimizedPlan().toString())


def test_deltas_need_no_python(spark):
    """Byte for byte what _delta gives, in Spark alone: no worker holds texts, however many or long they are."""
    import random

    from vellumlake.plans.queries import delta_roundtrip

    r = random.Random(1)
    word = lambda n: "".join(r.choice("ab é漢") for _ in range(n))
    pairs = [(word(r.randrange(40)), word(r.randrange(40))) for _ in range(100)]
    for _ in range(100):
        b = word(r.randrange(80))
        i, j = sorted((r.randrange(len(b) + 1), r.randrange(len(b) + 1)))
        pairs.append((b, b[:i] + word(r.randrange(9)) + b[j:]))
    big = word(50_000)
    pairs += [("", ""), (None, "x"), (None, ""), ("x", None), (None, None), ("x", ""), ("", "x" * 30), (big, big), (big, big + " tail"), (big, "x" + big), (big, big[::-1])]
    pairs += [(big, big[:20_000] + "x" + big[20_001:]), ("é" * 20, "è" * 20), *(("a" * m, "a" * n) for m in (0, 11, 12, 13, 14, 50) for n in (0, 11, 12, 13, 14, 30))]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, old string, new string")
    got = df.withColumn("d", fn.delta_encode("old", "new")).withColumn("back", fn.delta_decode("old", "d")).orderBy("i").collect()
    assert [r.d and bytes(r.d) for r in got] == [n if n is None else _delta((o or "").encode(), n.encode()) for o, n in pairs]
    assert [r.back for r in got] == [n for _, n in pairs]
    from tests.conftest import SF

    assert python_nodes(delta_roundtrip(spark, SF)) == []


def test_texts_are_read_where_they_lie_in_the_batch(spark):
    """zstd_ratio, fnv1a32 and fnv1a64: a worker holds an Arrow batch of texts once, and no table as long as the longest text."""
    import random
    import tracemalloc

    import pyarrow as pa
    import zstandard

    r = random.Random(2)
    texts = [None, "", "É 漢字", "a", "".join(map(chr, r.choices(range(33, 127), k=60)))] + ["ab" * i for i in range(40)] + ["".join(r.choices("abc \n", k=3000)), "x" * 70_000, None]

    def fnv(x, h, p, m):
        for b in x.encode():
            h = ((h ^ b) * p) & m
        return h

    def ratio(x):
        return min(1.0, len(zstandard.ZstdCompressor(level=3).compress(x.encode())) / len(x.encode())) if x else 1.0

    kinds = [(fn.zstd_ratio, ratio), (fn.fnv1a32, lambda x: fnv(x, 0x811C9DC5, 0x01000193, 2**32 - 1)), (fn.fnv1a64, lambda x: f"{fnv(x, 0xCBF29CE484222325, 0x100000001B3, 2**64 - 1):016x}")]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").coalesce(1)
    many = pa.array([t * 10_000 for t in ("lorem ipsum", "dolor sit  ")] * 200)  # 44 MB
    for f, plain in kinds:
        want = [None if t is None else plain(t) for t in texts]
        assert [x.v for x in rows.select("i", f("t").alias("v")).orderBy("i").collect()] == want
        for kind in (pa.string(), pa.large_string()):
            assert f.func(pa.array(texts, kind)).to_pylist() == want
            assert f.func(pa.array(["before", *texts, "after"], kind)[1:-1]).to_pylist() == want
            assert f.func(pa.array([], kind)).to_pylist() == [] and f.func(pa.array([None, ""], kind)).to_pylist() == [None, plain("")]
    tracemalloc.start()
    for f, batch in ((fn.zstd_ratio, many), (fn.fnv1a32, pa.array(["x" * 1_000_000, "y"])), (fn.fnv1a64, many.slice(0, 20))):
        tracemalloc.reset_peak()
        f.func(batch)
        assert tracemalloc.get_traced_memory()[1] < 500_000 + tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
