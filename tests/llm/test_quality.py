import numpy as np
import pyarrow as pa
import pytest

from vellumlake.llm import quality
from vellumlake.llm.textvec import Powers, slices

DATA = "/root/testdata/sf0.01"  # smaller tables label too few bad rows


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")


def brute_statistics(text):
    words = text.split()
    n = len(words)
    chars = sum(1 for c in text if not c.isspace()) or 1
    grams = [" ".join(words[i : i + 4]) for i in range(n - 3)]
    lines = [" ".join(x.split()) for x in text.split("\n") if x.split()]
    return {
        "capitals": sum("A" <= c <= "Z" for c in text) / max(1, sum(c.isascii() and c.isalpha() or not c.isascii() for c in text)),
        "bars": text.count("|") / n,
        "digits": sum("0" <= c <= "9" for c in text) / chars,
        "repeats": sum(a == b for a, b in zip(words, words[1:])) / n,
        "top_word": max(map(words.count, set(words))) / n,
        "distinct": np.log(1 + len(set(words))) / np.log(1 + n),
        "same_grams": (len(grams) - len(set(grams))) / n,
        "same_lines": (len(lines) - len(set(lines))) / max(1, len(lines)),
    }


def test_statistics_equal_brute_force():
    texts = ["One two two.\nOne two two.\n| a | b 12", "x", "DER DER DER !! DER", "é É b\n\nc\nc", "a b c d a b c d a b c d"]
    for _, data, off in slices(pa.array(texts)):
        n, s = quality.statistics(data, off, Powers())
        assert n.tolist() == [len(t.split()) for t in texts]
        for t, row in zip(texts, s):
            got = dict(zip(quality.STATS, row))
            for k, v in brute_statistics(t).items():
                assert got[k] == pytest.approx(v), (t, k)


def brute_path(tree, x):
    feature, split, left, length = tree
    node = 0
    while feature[node] >= 0:
        node = left[node] + int(x[feature[node]] >= split[node])
    return length[node]


def test_scores_are_path_lengths():
    rng = np.random.default_rng(0)
    x, n = rng.normal(size=(400, len(quality.STATS))), np.full(400, 200.0)
    f = quality.Forest(n, x, 20, 64, 1)
    odd = np.vstack([x[:50], x[:5] + 9])
    z = f.excess(n[:55], odd)
    want = [2 ** (-np.mean([brute_path(t, r) for t in f.trees]) / f.c) for r in z]
    got = f.score(n[:55], odd)
    assert np.allclose(got, want) and got[50:].min() > got[:50].max()
    assert all((t[3][t[0] < 0] >= 0).all() for t in f.trees)


def test_threshold():
    good, bad = np.linspace(0.3, 0.5, 100), np.linspace(0.45, 0.9, 50)
    t = quality.threshold(good, bad, 0.05)
    assert (good > t).mean() <= 0.05 and (bad > t).mean() > 0.85
    assert quality.threshold(good, bad[:0], 0.05) == good.max() and quality.threshold(good[:0], bad, 0.05) == np.inf


def test_rejects_labelled_bad_and_keeps_good(spark, tables):
    docs, labels = tables
    rows = quality.scored(docs, labels).join(labels, "doc_id").toPandas()
    assert rows[rows.quality == 1].keep.mean() >= 0.97 and rows[rows.quality == 0].keep.mean() <= 0.1
    again = quality.scored(docs.repartition(3), labels.repartition(2)).join(labels, "doc_id").toPandas()
    assert dict(zip(rows.doc_id, rows.score)) == dict(zip(again.doc_id, again.score))


def test_held_out(spark, tables):
    docs, labels = tables
    labels = labels.where("quality is not null")
    fit, test = labels.randomSplit([0.6, 0.4], 7)
    rows = quality.scored(docs, fit).join(test, "doc_id").toPandas()
    assert rows[rows.quality == 1].keep.mean() >= 0.9 and rows[rows.quality == 0].keep.mean() <= 0.25


def test_edges(spark, edge, none, tables):
    docs, labels = tables
    own = spark.createDataFrame([(1, 1, 0), (4, 1, 0), (13, 1, 1), (9, 1, 0), (11, 0, 0), (11, 1, 0), (None, 1, 0), (99, 0, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.scored(edge, own)
    assert got.count() == edge.count()
    flags = {(r["doc_id"], r["n_words"]): (r["keep"], r["score"]) for r in got.collect()}
    assert flags[5, 0] == flags[6, 0] == flags[7, 0] == (False, 1.0) and flags[1, 120][0]
    kept = quality.kept(edge, own)
    assert kept.schema == edge.schema and kept.count() == got.where("keep").count()
    assert kept.where("doc_id = 2").count() == 2
    assert quality.kept(none, own).count() == 0 and quality.kept(edge, own.limit(0)).count() == got.where("n_words > 0").count()
    bad = own.where("quality = 0")
    assert quality.kept(edge, bad).count() == got.where("n_words > 0").count()
