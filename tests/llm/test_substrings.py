import numpy as np
import pyarrow as pa
import pytest
from tests.conftest import SF, rows_of_duck, rows_of_spark

from vellumlake.llm import registry
from vellumlake.llm import substrings as ss
from vellumlake.llm.textvec import PLAIN, Powers, slices, words

from .conftest import frame, prose


def brute(rows, window=ss.WINDOW):
    seen = {}
    for d, t in rows:
        w = (t or "").split()
        for i in range(len(w) - window + 1):
            seen.setdefault(tuple(w[i : i + window]), []).append((d, i))
    at = {}
    for places in seen.values():
        if len(places) > 1:
            for d, i in places:
                if d is not None:
                    at.setdefault(d, {})[i] = max(len(places), at.get(d, {}).get(i, 0))
    out = []
    for d, pos in at.items():
        run = []
        for i in sorted(pos):
            if run and i - run[-1] > window:
                out.append((d, run[0], run[-1] + window, len(run), max(pos[x] for x in run)))
                run = []
            run.append(i)
        out.append((d, run[0], run[-1] + window, len(run), max(pos[x] for x in run)))
    return sorted(out)


def rows():
    p, q = prose(1, 60), prose(2, 55)
    out = [(i, prose(10 + i, 80) + "\n" + p + "\t" + prose(40 + i, 30)) for i in range(5)]
    out += [(5, q), (6, prose(60, 10) + " " + q + " x"), (6, prose(60, 10) + " " + q + " x"), (7, "tick tock " * 60), (8, prose(70, 49)), (9, prose(70, 49)), (10, prose(71, 50)), (11, prose(71, 50))]
    out += [(None, q), (None, None), (12, ""), (13, prose(80, 30_000) + " " + p), (14, "É 漢字 " * 30)]
    return out


@pytest.mark.parametrize("most", [ss.MAX_SKETCH_BYTES, 0])
def test_spans_equal_brute_force(spark, most):
    got = ss.repeated_spans(frame(spark, rows()).repartition(3), max_sketch_bytes=most)
    assert sorted(map(tuple, got.collect())) == brute(rows())


def test_every_window_holds_an_anchor():
    pw = Powers()
    for _, data, off in slices(pa.array([prose(3, 500), "tick " * 120, prose(4, 51), prose(5, 50), prose(6, 49)])):
        h, _, _, first = words(data, off, PLAIN, pw)
        at, _ = ss.anchors(h, first, 25, pw)
        for r in range(len(first) - 1):
            for s in range(first[r], first[r + 1] - 49):
                assert ((at >= s) & (at + 25 <= s + 50)).any()
            assert all(first[np.searchsorted(first, a, "right")] >= a + 25 for a in at)


def test_sketch_never_underestimates():
    g = np.random.default_rng(1).integers(0, 2**62, 3000).astype(np.uint64)
    g = np.concatenate([g, g[:700]])
    for row in range(ss.DEPTH):
        c = ss.cells(g, row, 1 << 12)
        n = np.bincount(c, minlength=1 << 12)
        assert (n[c[:700]] >= 2).all() and c.max() < 1 << 12


def test_query_equals_sql(spark, duck):
    assert rows_of_spark(registry.op10_repeated_spans(spark, SF)) == rows_of_duck(duck, registry.SQL["op10_repeated_spans"])


def test_edges(edge, none, spark):
    want = brute([(r["doc_id"], r["text"]) for r in edge.collect()])
    assert sorted(map(tuple, ss.repeated_spans(edge).collect())) == want and {d for d, *_ in want} >= {1, 2, 4, 9, 10}
    assert ss.repeated_spans(none).count() == 0 and ss.repeated_spans(none, max_sketch_bytes=0).count() == 0


def test_sketch_as_a_table_lets_the_same_windows_pass(spark):
    docs = frame(spark, [(i, prose(i % 7, 400 + i)) for i in range(20)] + rows())
    a, b = (sorted(map(tuple, ss.candidate_windows(docs, max_sketch_bytes=m).distinct().collect()), key=str) for m in (ss.MAX_SKETCH_BYTES, 0))
    assert a == b and a


def test_long_texts_in_parts():
    pw = Powers()
    texts = pa.array(["ab cd\u00e9 " * 500, "", "x" * 3000 + " y", " ", "end"])
    for _, data, off in slices(texts):
        whole = words(data, off, PLAIN, pw)
        for part in (7, 64, 1000, 2999):
            assert all((x == y).all() for x, y in zip(whole, words(data, off, PLAIN, pw, part)))
