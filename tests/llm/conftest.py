import random

import pytest

WORDS = "ab bel cor dun eft fen gar hob ink jut kel lom mun nor oak pim qua rin sol tev".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, keep boolean, node long, label string, kind string, windows int, __text string, __search string, __id long, __node_of string"


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    out = []
    for i in range(n):
        w = "".join(r.choice(WORDS) for _ in range(r.choice((1, 1, 2, 3))))
        out.append(w.capitalize() if i % 9 == 0 else w + ("." if i % 9 == 8 else ""))
    return " ".join(out)


def changed(text: str, seed: int, share: float) -> str:
    r = random.Random(seed)
    return " ".join(w if r.random() > share else r.choice(("zyx", "wvu", "")) for w in text.split())


def frame(spark, rows):
    """Documents with columns whose names the operators use themselves."""
    full = [(i, t, "en", "s", None if t is None else len(t), 0.5, None, 1, "x", "y", 3, "a", "b", 7, "c") for i, t in rows]
    return spark.createDataFrame(full, SCHEMA)


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls, empties, blanks, a very long text, ties, repeated rows and null ids among ordinary texts."""
    a, b, long_ = prose(1, 120), prose(2, 120), prose(3, 25_000)
    rows = [(1, a), (2, a), (2, a), (3, changed(a, 4, 0.05)), (4, b), (5, None), (5, None), (6, ""), (7, " \n\t "), (8, "!!! ???"), (9, long_), (10, long_ + " end"), (None, b), (None, None), (11, "one"), (12, "one two"), (13, prose(5, 300)), (14, "É ß 漢字   x")]
    return frame(spark, rows)


@pytest.fixture(scope="session")
def none(spark):
    return frame(spark, [])
