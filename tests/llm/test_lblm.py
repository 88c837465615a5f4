from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.conftest import SF

from vellumlake.llm import lblm
from vellumlake.llm.textvec import NORM, Powers, words


def model(size=60, width=6, head=10):
    rng = np.random.default_rng(1)
    counts = np.concatenate([np.arange(size)[::-1] + 1, np.full(256, 0.5)])
    return lblm.Model(np.sort(rng.integers(1, 2**63, size).astype(np.uint64)), counts, width, 2, head)


def softmax(x):
    p = np.exp(x - x.max())
    return p / p.sum()


def brute(m, ctx):
    """Probability of every outcome after two ids, level by level."""
    hat = m.r[ctx[0]] * m.c[0] + m.r[ctx[1]] * m.c[1]
    s = m.q @ hat + m.b
    first, out = softmax(s[: m.top]), []
    for i in range(m.size):
        if i < m.head:
            out.append(first[i])
            continue
        w = i - m.head
        sub = w // m.each
        g = sub // m.each
        subs = softmax(s[m.top + g * m.each : m.top + min(m.subs, (g + 1) * m.each)])
        base = m.top + m.subs
        leaves = softmax(s[base + sub * m.each : base + min(m.size - m.head, (sub + 1) * m.each)])
        out.append(first[m.head + g] * subs[sub - g * m.each] * leaves[w - sub * m.each])
    return np.array(out)


@pytest.mark.parametrize("head", [10, 1000])
def test_log_probs_equal_brute_force_and_are_normalised(head):
    m = model(head=head)
    rng = np.random.default_rng(3)
    ids, first = rng.integers(0, m.size, 90).astype(np.int32), np.array([0, 40, 40, 41, 90])
    got = lblm.log_probs(m, ids, first)
    for r in range(4):
        for i in range(first[r], first[r + 1]):
            back = lambda j: ids[i - j] if i - j >= first[r] else m.size
            p = brute(m, (back(1), back(2)))
            assert p.sum() == pytest.approx(1, abs=1e-5) and got[i] == pytest.approx(np.log(p[ids[i]]), abs=1e-3)


def test_gradient_of_noise_contrast():
    m = model(12, 3, head=1000)
    for k in ("r", "q", "c", "b"):
        setattr(m, k, getattr(m, k).astype(np.float64))
    s = np.array([2, 1, 4, 5, 1, m.size, m.size, 7, 4], np.int32)
    target = [i for i in range(2, len(s)) if s[i] < m.size]

    class Fixed:
        def random(self, n):
            return np.linspace(0.01, 0.99, n)

    t = lblm.Trainer(m, 0)
    t.rng, grads = Fixed(), {}
    t._step = lambda name, row, g: grads.setdefault(name, []).append((row, g))
    drawn = np.minimum(np.searchsorted(t.edges, Fixed().random(lblm.NOISE)), m.top - 1)

    def loss():
        out = 0
        for i in target:
            hat = m.r[s[i - 1]] * m.c[0] + m.r[s[i - 2]] * m.c[1]
            pos = m.q[s[i]] @ hat + m.b[s[i]] - t.log_noise[s[i]]
            out += np.log1p(np.exp(-pos)) + np.log1p(np.exp(m.q[drawn] @ hat + m.b[drawn] - t.log_noise[drawn])).sum()
        return out / len(target)

    t.batch(s)
    for name in "rqcb":
        p, total = getattr(m, name), np.zeros_like(getattr(m, name))
        for row, g in grads[name]:
            total[row] += g
        for at in ((4, 1), (1, 0), (int(drawn[0]), 2)) if name in "rq" else ((1, 1), (0, 2)) if name == "c" else ((5,), (int(drawn[0]),)):
            old = p[at]
            p[at] = old + 1e-5
            up = loss()
            p[at] = old - 1e-5
            down = loss()
            p[at] = old
            assert total[at] == pytest.approx((up - down) / 2e-5, rel=5e-3, abs=1e-5), (name, at)


def test_vocabulary_counts_all_words(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    hashes, counts = lblm.vocabulary(docs, 0, 3)
    total = Counter()
    for r in docs.select("text").collect():
        total.update("".join(c if c.isalnum() or not c.isascii() else " " for c in r["text"].lower()).split())
    often = sorted((n for n in total.values() if n >= 3), reverse=True)
    assert len(hashes) == len(often) and counts[:-256].tolist() == often and counts.sum() == sum(total.values())
    last = Counter()
    for w, n in total.items():
        if n < 3:
            last[w.encode()[-1]] += n
    assert {i: n for i, n in enumerate(counts[-256:].tolist()) if n} == last


def test_beats_unigrams_on_held_out_texts(spark):
    """Texts with word order: each word calls for the next."""
    rng = np.random.default_rng(5)
    names = [f"w{i}" for i in range(40)]

    def text():
        at, out = 0, []
        for _ in range(400):
            at = (at * 3 + int(rng.integers(0, 3))) % 40
            out.append(names[at])
        return " ".join(out)

    docs = spark.createDataFrame([(i, text()) for i in range(240)], "doc_id long, text string").repartition(3)
    m = lblm.train(docs.where("doc_id >= 40"), rounds=1, passes=6, batch_words=256)
    got = lblm.scores(docs.where("doc_id < 40"), m).toPandas()
    unigram = float((m.noise[m.noise > 0] * np.log(m.noise[m.noise > 0])).sum())
    assert got.model_log_prob.sum() / got.tokens.sum() > unigram + 0.3


def test_defaults_beat_unigrams_on_held_out_documents(spark):
    """The registered parameters, on documents that were not trained on; by 0.3 nats a word at least."""
    docs = spark.read.parquet(f"{SF.replace('sf0.001', 'sf0.01')}/documents.parquet")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(10)) == 0
    m = lblm.train(docs.where(~held))
    got = lblm.scores(docs.where(held), m).toPandas()
    m.r[:] = 0
    m.b = np.log(np.concatenate([m.first, *m.inner])).astype(np.float32)
    plain = lblm.scores(docs.where(held), m).toPandas()
    assert got.model_log_prob.sum() / got.tokens.sum() > plain.model_log_prob.sum() / plain.tokens.sum() + 0.3


def test_edges(spark, edge, none):
    m = lblm.train(edge)
    got = lblm.scores(edge, m).toPandas()
    assert len(got) == edge.count()
    void = got[got.tokens == 0]
    assert len(void) == 6 and void.perplexity.isna().all() and (void.log_prob == 0).all()
    twice = got[got.doc_id == 2].log_prob
    assert len(twice) == 2 and twice.round(9).nunique() == 1 and (got[got.tokens > 0].mean_log_prob < 0).all()
    empty = lblm.train(none)
    assert lblm.scores(none, empty).count() == 0 and lblm.scores(edge, empty).count() == edge.count()


def test_words_outside_the_vocabulary_take_the_outcome_of_their_last_byte():
    m = model()
    h, *_ = words(np.frombuffer(b"zig zag", np.uint8), np.array([0, 7]), NORM, Powers())
    assert m.ids(h, np.array([103, 103], np.uint8)).tolist() == [60 + 103] * 2 and m.ids(m.sorted, np.zeros(60, np.uint8)).tolist() == m.order.tolist()


def test_vocabulary_grows_with_the_corpus_and_rare_words_differ(spark):
    text = " ".join(f"w{i}" for i in range(3000))
    docs = spark.createDataFrame([(i, text if i < 12 else "w7 w8 aaa" if i == 12 else "w7 w8 zqx") for i in range(14)], "doc_id long, text string")
    m = lblm.train(docs)
    assert m.words == 3000 and lblm.train(docs.where("doc_id >= 12")).words == 2
    got = lblm.scores(docs, m).toPandas().set_index("doc_id")
    assert got.unknown_share[0] == 0 and got.unknown_share[12] == pytest.approx(1 / 3)
    more = docs.union(spark.createDataFrame([(20, "w7 w8 aaab")], "doc_id long, text string"))
    got = lblm.scores(more, m).toPandas().set_index("doc_id").log_prob
    assert len({got[12], got[13], got[20]}) == 3 and np.isfinite(got).all()


def test_memory_equals_brute_force(spark):
    """Counts of what follows a triple in other documents, with the model as their prior."""
    rng = np.random.default_rng(9)
    base = [f"w{i}" for i in rng.integers(0, 12, 60)]
    texts = [" ".join(base[i : i + 30]) for i in (0, 5, 5, 20)] + [" ".join(f"w{i}" for i in rng.integers(0, 12, 50)), None, "w1"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    m = lblm.train(docs)
    got = lblm.scores(docs, m, every=1, mu=2.0).toPandas().set_index("doc_id")
    split = [(t or "").split() for t in texts]
    uses = [Counter((tuple(w[i : i + 3]), w[i + 3]) for i in range(len(w) - 3)) for w in split]
    for d, w in enumerate(split):
        if not w:
            continue
        h, _, ends, _ = words(np.frombuffer(texts[d].encode(), np.uint8), np.array([0, len(texts[d])]), NORM, Powers())
        ids = m.ids(h, np.array([ord(x[-1]) for x in w], np.uint8))
        lp, gain = lblm.log_probs(m, ids, np.array([0, len(w)])), 0.0
        for i in range(len(w) - 3):
            key, out = tuple(w[i : i + 3]), w[i + 3]
            both = sum(u[key, out] for e, u in enumerate(uses) if e != d)
            every = sum(n for e, u in enumerate(uses) if e != d for (k, _), n in u.items() if k == key)
            gain += np.log((both + 2 * np.exp(lp[i + 3])) / (every + 2)) - lp[i + 3]
        assert got.log_prob[d] - got.model_log_prob[d] == pytest.approx(gain, abs=1e-2)


def test_defaults_remember_every_triple(spark):
    """Each text's first half is another's too, so by the defaults each row's uses are its words but three, and its gain that of all its triples."""
    rng = np.random.default_rng(11)
    names = [f"w{i}" for i in range(500)]
    halves = [" ".join(rng.choice(names, 8)) for _ in range(20)]
    docs = spark.createDataFrame([(i, halves[i // 2] + " " + " ".join(rng.choice(names, 8))) for i in range(40)], "doc_id long, text string")
    m = lblm.train(docs)
    got, all_ = (x.toPandas().set_index("doc_id").sort_index() for x in (lblm.scores(docs, m), lblm.scores(docs, m, every=1)))
    assert (got.memory_gain > 0).all() and np.allclose(got.log_prob, all_.log_prob, atol=1e-9)
    assert np.allclose((got.log_prob - got.model_log_prob) / got.memory_gain, 13, atol=1e-6)


def test_memory_is_the_same_in_any_chunks_and_buckets(spark, edge, monkeypatch):
    more = spark.createDataFrame([(100 + i, "spam ham eggs " * 50 + f"end{i % 3}") for i in range(30)], "doc_id long, text string")
    docs = edge.select("doc_id", "text").union(more).repartition(2).localCheckpoint()
    m = lblm.train(docs)
    rows = lambda: sorted(map(repr, lblm.scores(docs, m).collect()))
    want = rows()
    monkeypatch.setattr(lblm, "_HELD", 400)
    assert len(want) == docs.count() and rows() == want


@pytest.mark.parametrize("most", [1, 2, 50, 2**63, 2**64 - 1])
def test_order_is_stable_and_blocks_are_read_as_packed(most):
    rng = np.random.default_rng(4)
    k = rng.integers(0, most, 3000, np.uint64, endpoint=True)
    k[::7] = k[0]
    k[1::7] = k[1::7] >> np.uint64(60) | k[0] & ~np.uint64(15)  # differ in their last bits only
    for x in (k, k[:1], k[:0]):
        assert lblm._order(x).tolist() == np.argsort(x, kind="stable").tolist()
        assert [y.tolist() for y in lblm._unpack(lblm._pack(x, x >> np.uint64(40)))] == [x.tolist(), (x >> np.uint64(40)).tolist()]


def test_sums_of_runs_and_ids_and_normalisers_equal_the_plain_forms():
    rng = np.random.default_rng(8)
    for most in (2, 300, 5000):  # long, short and mostly single runs
        at = np.sort(rng.integers(0, most, 2000))
        x, begin = rng.random((2000, 5)), np.flatnonzero(np.diff(at, prepend=-1))
        assert np.allclose(lblm._sums(x, begin), np.add.reduceat(x, begin, axis=0))
    m = model()
    near = m.sorted + np.uint64(1)  # in the same places of the table
    assert m.ids(near, np.full(60, 7, np.uint8)).tolist() == [60 + 7] * 60
    ends = np.array([0, 2**64 - 1], np.uint64)
    assert m.ids(ends, np.zeros(2, np.uint8)).tolist() == [60, 60]
    crowd = lblm.Model(np.arange(50, dtype=np.uint64), np.ones(50 + 256), 4, 1)  # all with the same leading bits
    assert crowd.ids(np.arange(52, dtype=np.uint64), np.full(52, 9, np.uint8)).tolist() == [*range(50), 59, 59]
    for low, high in ((-3, 3), (-500, -400), (-500, 3), (90, 300), (-90, 300)):
        s = rng.uniform(low, high, (40, 6))
        s[:, 5] = -np.inf
        s[:20, 0] = low
        want = np.log(np.exp(s - s.max(1, keepdims=True)).sum(1)) + s.max(1)
        assert np.allclose(lblm._lse(s.astype(np.float32)), want, rtol=1e-5, atol=1e-4)


def test_texts_are_scored_once_for_any_number_of_actions(spark, edge):
    got = lblm.scores(edge, lblm.train(edge))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and got.count() == edge.count()
