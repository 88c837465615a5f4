import random

import pytest
from tests.conftest import SF

from vellumlake.llm import tokentree as tt

from .conftest import frame, prose


@pytest.fixture(scope="module")
def counter():
    return tt.Counter(tt.tokenizer_dir())


def test_counts_are_the_tokenizers(counter):
    for text in ("Hello, world! It's 2024\n\n  two", prose(1, 300), "é漢字 'll", "", " ", "\n\n \t x  ", "a" * 5000):
        assert tt.TokenTree(counter, text).total == len(counter.encoding.encode_ordinary(text))


def test_edits_equal_full_encoding(counter):
    r = random.Random(2)
    letters = "ab 'sl re\n\t 1é.!  d漢"
    for i in range(4000):
        text = "".join(r.choice(letters) for _ in range(r.randint(0, 60))) if i % 4 else prose(i, r.randint(0, 700))
        edits = []
        for _ in range(r.randint(1, 5)):
            s = r.randint(0, len(text))
            edits.append((s, min(len(text), s + r.choice((0, 0, 1, 2, 10, 400))), "".join(r.choice(letters) for _ in range(r.randint(0, 6)))))
        tree = tt.TokenTree(counter, text)
        tree.apply(edits)
        full = tt.TokenTree(counter, tree.text)
        assert tree.total == full.total and sum(tree.lengths, []) == sum(full.lengths, []), (text, edits)
        assert tree.chars[1] == len(tree.text) and tree.chars[tree.width :][: len(tree.lengths)] == list(map(sum, tree.lengths))
        again = tt.TokenTree(counter, *(tree.state()[c] for c in ("text", "lengths", "counts", "blocks", "char_sums", "token_sums")))
        again.edit(0, 0, "x ")
        assert again.total == len(counter.encoding.encode_ordinary("x " + tree.text)) and again.chars[1] == len(again.text)


def test_only_touched_regions_are_encoded(counter):
    text = prose(3, 5000)
    tree = tt.TokenTree(counter, text)
    tree.edit(len(text) // 2, len(text) // 2 + 5, "new words")
    assert 0 < tree.encoded < 15 and tree.total == len(counter.encoding.encode_ordinary(tree.text))


def test_many_edits_of_a_long_text_take_linear_time(counter):
    import time

    text = prose(8, 60_000)
    edits = [(i, i + 1, "#") for i in range(0, len(text), 40)]
    tree = tt.TokenTree(counter, text)
    began = time.perf_counter()
    assert tree.apply(edits) == len(edits) and time.perf_counter() - began < 5
    assert tree.total == len(counter.encoding.encode_ordinary(tree.text))


def test_long_insertions_are_split(counter):
    tree = tt.TokenTree(counter, prose(5, 500))
    tree.edit(100, 100, prose(6, 3000))
    assert max(map(len, tree.lengths)) < 3 * tt.BLOCK and tree.total == len(counter.encoding.encode_ordinary(tree.text))


def test_ties_do_not_hang_on_row_order(spark, counter):
    docs = frame(spark, [(1, "hello big world"), (2, "hello big world")])
    rows = [(1, 6, 6, "B ", None), (1, 6, 6, "A ", None), (1, 10, 15, "moon", None), (1, 10, 15, "earth", None), (2, 6, 6, "B ", 1), (2, 6, 6, "A ", 2), (2, 0, 5, "x", 9), (2, 0, 5, "y", 4)]
    for order in (rows, rows[::-1]):
        edits = spark.createDataFrame(order, "doc_id long, start int, end int, replacement string, seq long")
        assert sorted(r["text"] for r in tt.apply_edits(tt.token_trees(docs), edits).collect()) == ["hello A B big earth", "y B A big world"]


def test_overlaps_and_bounds(counter):
    tree = tt.TokenTree(counter, "one two three")
    assert tree.apply([(0, 3, "1"), (2, 6, "x"), (-5, 0, ""), (None, 3, "x"), (8, 99, None)]) >= 2
    assert tree.text == "1 two "
    assert tree.total == len(counter.encoding.encode_ordinary("1 two "))


def test_stored_trees(spark, counter):
    docs = frame(spark, [(1, "one two three"), (2, prose(4, 400)), (3, None), (4, ""), (None, "x"), (2, prose(4, 400))])
    trees = tt.token_trees(docs)
    edits = spark.createDataFrame([(1, 0, 3, "1"), (2, 10, 20, "zzz"), (2, 50, 60, None), (3, 0, 1, "x"), (9, 0, 1, "x"), (None, 0, 1, "x"), (4, 0, 0, "new")], "doc_id long, start int, end int, replacement string")
    got = tt.apply_edits(trees, edits).collect()
    assert len(got) == 6
    for r in got:
        if r["text"] is None:
            assert r["tokens"] is None
        else:
            assert r["tokens"] == sum(r["counts"]) == len(counter.encoding.encode_ordinary(r["text"])) and sum(r["lengths"]) == len(r["text"])
    assert {r["text"] for r in got if r["doc_id"] in (1, 4)} == {"1 two three", "new"}


def test_query_equals_brute_force(spark, counter):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r["doc_id"]: r for r in tt.edit_counts(docs).collect()}
    for d in docs.collect():
        text = d["text"]
        for a, b, new in reversed(tt.redactions(text)):
            text = text[:a] + new + text[b:]
        r = got[d["doc_id"]]
        assert r["tokens_before"] == len(counter.encoding.encode_ordinary(d["text"])) and r["tokens_after"] == len(counter.encoding.encode_ordinary(text))
    assert any(r["edits"] for r in got.values())


def test_edges(edge, none):
    got = tt.edit_counts(edge).collect()
    assert len(got) == edge.count() and all((r["tokens_before"] is None) == (r["pretokens"] is None) for r in got)
    assert sum(r["tokens_before"] is None for r in got) == 3 and sum(r["tokens_before"] == 0 for r in got) == 1
    assert tt.edit_counts(none).count() == 0 == tt.token_trees(none).count()
