import itertools
import re

import numpy as np
from tests.conftest import SF
from hypothesis import given
from hypothesis import settings as h_settings
from hypothesis import strategies as st

from vellumlake.llm import packing

from .conftest import frame


@h_settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 9), st.floats(0.05, 1)), min_size=1, max_size=4, unique_by=lambda x: x[0]), st.integers(9, 14))
def test_knapsack_equals_brute_force(items, capacity):
    sizes, worth = np.array([s for s, _ in items]), np.array([w for _, w in items])
    value, counts = packing.knapsack(sizes, worth, capacity)
    best = max(sum(c * w for c, w in zip(cs, worth)) for cs in itertools.product(*[range(capacity // s + 1) for s in sizes]) if sum(c * s for c, s in zip(cs, sizes)) <= capacity)
    assert abs(value - best) < 1e-9 and (counts * sizes).sum() <= capacity and abs((counts * worth).sum() - value) < 1e-9


@h_settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 500), min_size=1, max_size=12))
def test_plan_covers_demand_near_the_bound(demand):
    sizes, d = np.array(sorted(demand)), np.array([demand[s] for s in sorted(demand)])
    plan, bound = packing.solve(sizes, d, 30)
    assert (sum(c * n for c, n in plan) == d).all() and all((c * sizes).sum() <= 30 and n > 0 for c, n in plan)
    bins = sum(n for _, n in plan)
    assert bins >= np.ceil((sizes * d).sum() / 30) and bins <= bound * (1 + packing.GAP) + len(sizes) + 1


def test_inverse():
    a = np.random.default_rng(1).integers(0, 4, (40, 40)) + 5 * np.eye(40)
    assert np.allclose((packing._inverse(a)[:, :, None] * a).sum(1), np.eye(40))


def check(rows, docs, context):
    """Every word of every document lies in exactly one sequence, and no sequence overflows or overlaps."""
    by_seq, by_doc = {}, {}
    for r in rows:
        by_seq.setdefault(r["sequence_id"], []).append((r["position"], r["position"] + r["n_words"] + 1))
        by_doc.setdefault(r["doc_id"], []).append((r["start_word"], r["start_word"] + r["n_words"]))
    for spans in by_seq.values():
        spans.sort()
        assert spans[-1][1] <= context and all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
    for i, n in docs.items():
        spans = sorted(by_doc.pop(i, []))
        assert (spans[0][0] == 0 and spans[-1][1] == n and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))) if n else not spans
    assert not by_doc
    assert sorted(by_seq) == list(range(len(by_seq)))
    return len(by_seq)


def test_packs_the_test_data(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sizes = {r["doc_id"]: len(r["text"].split()) for r in docs.collect()}
    for context, quantum, shard in ((2048, 16, 100_000), (128, 4, 3)):
        rows = packing.packed(docs, context, quantum, shard).collect()
        n = check(rows, sizes, context)
        pieces = [r["n_words"] + 1 for r in rows]
        rounded = sum(-(-p // quantum) * quantum for p in pieces)
        assert n <= np.ceil(rounded / context) * 1.05 + 2


def test_edges(spark, edge, none):
    rows = packing.packed(edge, 128, 8).collect()
    assert sum(r["doc_id"] == 2 for r in rows) == 2 and sum(r["doc_id"] is None for r in rows) == 1
    assert sum(r["n_words"] for r in rows) == sum(len(re.findall(r"[^ \t\n\r\f\v]+", r["text"] or "")) for r in edge.collect())
    assert len({(r["sequence_id"], r["position"]) for r in rows}) == len(rows)
    assert packing.packed(none).count() == 0 == packing.packed(frame(spark, [(1, None), (2, "  ")])).count()
    ties = frame(spark, [(i, "a b c") for i in range(50)])
    assert check(packing.packed(ties, 16, 4).collect(), {i: 3 for i in range(50)}, 16) == 13
