import numpy as np
import pytest
from tests.conftest import SF, rows_of_duck, rows_of_spark
from hypothesis import given
from hypothesis import settings as h_settings
from hypothesis import strategies as st

from vellumlake.llm import registry
from vellumlake.llm import wumanber as wm

from .conftest import frame, prose


@h_settings(max_examples=150, deadline=None)
@given(st.sets(st.text("ab", min_size=8, max_size=14), min_size=1, max_size=12), st.lists(st.text("ab", max_size=80), min_size=1, max_size=5), st.sampled_from([1, 7, 4096]))
def test_search_equals_brute_force(pats, texts, stretch):
    pats = sorted(p.encode() for p in pats)
    t = wm.Tables(pats)
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    off = np.concatenate([[0], np.cumsum([len(x) for x in texts])])
    start, which = wm.search(t, data, off, stretch)
    got = sorted((int(s), t.pats[w]) for s, w in zip(start, which))
    want = sorted((int(off[r]) + i, p) for r, x in enumerate(texts) for p in pats for i in range(len(x)) if x.encode()[i : i + len(p)] == p)
    assert got == want


def norm(t):
    return "".join(c if c.isalnum() or not c.isascii() else " " for c in (t or "").lower()).split()


def brute(docs, items, window=wm.WINDOW, least=wm.LEAST_WORDS):
    out = []
    for d, t in docs:
        text = f" {' '.join(norm(t))} "
        for i, x in items:
            w = norm(x)
            if i is not None and len(w) >= least:
                n = sum(f" {p} " in text for p in {" ".join(w[k : k + window]) for k in range(max(1, len(w) - window + 1))})
                if n:
                    out.append((d, i, n))
    return sorted(out, key=str)


def test_contamination_equals_brute_force(spark):
    a, b = prose(1, 40), prose(2, 15)
    items = [(1, a), (2, b), (3, b.upper()), (4, None), (5, ""), (6, "too few words here"), (7, "just five words as item"), (None, a), (1, a)]
    docs = [(1, prose(3, 50) + "\n" + a.upper() + "!! " + prose(4, 20)), (2, " ".join(a.split()[5:17])), (3, a.replace(" ", "")), (4, b), (4, b), (None, b), (5, None), (6, ""), (7, "Just, five words: as ITEM"), (8, "adjust five words as item"), (9, prose(9, 20_000) + " " + b)]
    found = wm.contamination(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(tuple, found.collect()), key=str) == brute(docs, dict(items[:7]).items())
    small = wm.contamination(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"), chunk_bytes=1)
    assert sorted(map(tuple, small.collect()), key=str) == sorted(map(tuple, found.collect()), key=str)
    clean = wm.decontaminated(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(r["doc_id"] for r in clean.collect()) == [3, 5, 6, 8]


def test_query_equals_sql_and_brute_force(spark, duck):
    got = registry.op8_benchmark_leaks(spark, SF)
    assert rows_of_spark(got) == rows_of_duck(duck, registry.SQL["op8_benchmark_leaks"])
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, items)


def test_edges(spark, edge, none):
    bench = spark.createDataFrame([(1, prose(1, 20))], "item_id long, text string")
    nothing = bench.limit(0)
    want = brute([(r["doc_id"], r["text"]) for r in edge.collect()], [(1, prose(1, 20))])
    assert sorted(map(tuple, wm.contamination(edge, bench).collect()), key=str) == want and len(want) >= 3
    out = wm.decontaminated(edge, bench)
    assert out.schema == edge.schema and out.count() == edge.count() - wm.contamination(edge, bench).count()
    assert wm.contamination(edge, nothing).count() == 0 and wm.decontaminated(edge, nothing).count() == edge.count()
    assert wm.contamination(none, bench).count() == 0 == wm.decontaminated(none, bench).count()
    with pytest.raises(ValueError):
        wm.patterns(bench, least_words=2)
