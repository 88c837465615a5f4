import numpy as np
import pyarrow as pa
import pytest
from tests.conftest import SF
from hypothesis import given
from hypothesis import settings as h_settings
from hypothesis import strategies as st

from vellumlake.llm import omh
from vellumlake.llm.textvec import NORM, Powers, slices, words

from .conftest import changed, frame, prose


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j - 1] + (x != y), last[j] + 1, row[-1] + 1))
    return row[-1]


@h_settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 5), max_size=14), st.lists(st.integers(0, 5), max_size=14)), min_size=1, max_size=6), st.integers(1, 9))
def test_band_equals_full_table(pairs, band):
    arrays = [(np.array(a, np.int64), np.array(b, np.int64)) for a, b in pairs]
    for (a, b), got in zip(pairs, omh.banded(arrays, band)):
        d = distance(a, b)
        assert got == d if d <= band else got > band
    for (a, b), (x, y) in zip(pairs, arrays):
        assert omh.bag_bound(x, y) <= distance(a, b) if a or b else True


@h_settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 3), max_size=60), st.lists(st.integers(0, 3), max_size=60)), max_size=5))
def test_near_equals_brute_force(pairs):
    got = omh.near([(np.array(a, np.int64), np.array(b, np.int64)) for a, b in pairs], 0.7)
    for (a, b), s in zip(pairs, got):
        want = 1 - distance(a, b) / max(1, len(a), len(b))
        assert s == pytest.approx(want) if want >= 0.7 - 1e-9 else s == -1


def sketches(texts):
    pw, rows, keys = Powers(), [], []
    for i, data, off in slices(pa.array(texts)):
        h, _, _, first = words(data, off, NORM, pw)
        r, k = omh.order_sketches(h, first, omh.K, omh.SKETCHES, pw)
        rows += (r + i).tolist()
        keys += k.tolist()
    return dict(zip(rows, keys))


def test_sketch_keeps_order():
    """Equal content in another order has other sketches; equal sequences have equal ones whatever lies around them."""
    words_ = [f"w{i}" for i in range(60)]
    a, b = " ".join(words_), " ".join(words_[30:] + words_[:30])
    s = sketches([a, "x", b, a.upper() + "!", "p q r s " * 50])
    assert s[0] == s[3] and 1 not in s
    same = sum(x == y for x, y in zip(s[0], s[2]))
    assert same < omh.SKETCHES // 2


def brute_groups(rows, similarity):
    norm = lambda t: "".join(c if c.isalnum() or not c.isascii() else " " for c in (t or "").lower()).split()
    seqs = [norm(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if seqs[i] and seqs[j] and find(i) != find(j):
                n = max(len(seqs[i]), len(seqs[j]))
                if seqs[i] == seqs[j] or n < 1000 and min(len(seqs[i]), len(seqs[j])) >= similarity * n and distance(seqs[i], seqs[j]) <= (1 - similarity) * n + 1e-9:
                    root[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        if seqs[i]:
            groups.setdefault(find(i), []).append(rows[i][0])
    return sorted(sorted(g) for g in groups.values() if len(g) > 1)


def test_groups_equal_brute_force(spark):
    rows = []
    for g in range(8):
        base = prose(100 + g, 60 + 10 * g)
        rows += [(len(rows), base)]
        for v in range(g):
            rows.append((len(rows), changed(base, 1000 * g + v, 0.06) if v % 3 else base.upper()))
    shared = prose(999, 70)
    rows += [(len(rows), prose(500 + i, 60) + " " + shared) for i in range(6)]  # a passage in common is no near copy
    got = {}
    for r in omh.near_duplicates(frame(spark, rows)).collect():
        got.setdefault(r["kept_id"], []).append(r["doc_id"])
    assert sorted(map(sorted, got.values())) == brute_groups(rows, omh.SIMILARITY)


def test_recall_on_test_data(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect() if len(r["text"]) < 3000]
    want = brute_groups(rows, omh.SIMILARITY)
    ids = {i for i, _ in rows}
    got = {r["doc_id"]: r["kept_id"] for r in omh.near_duplicates(docs).collect()}
    pairs = [(g[0], x) for g in want for x in g[1:]]
    assert pairs and sum(got.get(a) == got.get(b) is not None for a, b in pairs) >= 0.95 * len(pairs)
    assert not [i for i in got if i in ids and not any(i in g for g in want) and all(got[i] != got[j] or i == j or j not in ids for j in got)]


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (103, 101), (200, 200)]
    got = {r["node"]: r["label"] for r in omh.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 1 for i in range(1, 41)) and got[100] == got[101] == got[103] == 100 and 200 not in got


def test_mixed_buckets_are_settled_exactly(spark, monkeypatch):
    """With one sketch key for all, only alignment tells groups apart."""
    bases = [prose(700 + i, 50) for i in range(4)]
    rows = [(i * 10 + j, bases[i] if not j else changed(bases[i], i * 7 + j, 0.05)) for i in range(4) for j in range(3)]
    real = omh.signatures
    monkeypatch.setattr(omh, "signatures", lambda *a: real(*a).selectExpr("doc_id", "node", "n_words", "array(1L) AS keys"))
    got = {}
    for r in omh.near_duplicates(frame(spark, rows)).collect():
        got.setdefault(r["kept_id"], []).append(r["doc_id"])
    assert sorted(map(sorted, got.values())) == brute_groups(rows, omh.SIMILARITY)


def test_edges(edge, none):
    got = {}
    for r in omh.near_duplicates(edge).collect():
        got.setdefault(r["kept_id"], []).append((r["doc_id"], r["is_kept"], r["group_rows"]))
    assert sorted(got) == [1, 4, 9]
    assert sorted(got[1]) == [(1, True, 4), (2, False, 4), (2, False, 4), (3, False, 4)]
    assert sorted(got[4], key=str) == [(4, True, 2), (None, False, 2)] and len(got[9]) == 2
    out = omh.drop_near_duplicates(edge)
    assert out.schema == edge.schema
    assert sorted([r["doc_id"] for r in out.collect()], key=lambda x: (x is None, x)) == [1, 4, 5, 5, 6, 7, 8, 9, 11, 12, 13, 14, None]
    assert omh.near_duplicates(none).count() == 0 == omh.drop_near_duplicates(none).count()


def test_repeated_ids_with_other_texts(spark):
    a, b = prose(1, 80), prose(2, 80)
    rows = [(1, a), (1, b), (1, a), (2, a), (1, None), (3, b), (7, None), (7, prose(9, 80))]
    left = sorted((r["doc_id"], r["text"] or "") for r in omh.drop_near_duplicates(frame(spark, rows)).collect())
    assert left == sorted([(1, a), (1, b), (1, ""), (7, ""), (7, prose(9, 80))])


def test_near_copies_with_null_ids_are_found(spark):
    a, b = prose(21, 120), prose(22, 120)
    docs = frame(spark, [(1, a), (None, changed(a, 5, 0.04)), (None, b), (None, changed(b, 6, 0.04))])
    got = omh.near_duplicates(docs).collect()
    assert sorted((r.kept_id or 0, r.group_rows) for r in got) == [(0, 2), (0, 2), (1, 2), (1, 2)]
    assert omh.drop_near_duplicates(docs).count() == 2
