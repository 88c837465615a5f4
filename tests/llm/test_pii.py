import re

from vellumlake.llm import pii


def found(text):
    return [(s, k) for _, _, s, _, k in pii.mentions(text)]


def test_candidates_and_seeds():
    t = 'call +1 (123) 555-0101 or x.12@mail.example.com, 10.2.3.4 and 4012888888881881; 1234567890123456 token = "' + "0a" * 20 + '" v1.2 2024 300.1.1.1'
    assert found(t) == [
        ("+1 (123) 555-0101", "phone"), ("x.12@mail.example.com", "email"), ("10.2.3.4", "ip"), ("4012888888881881", "card"),
        ("1234567890123456", ""), ("0a" * 20, "secret"), ("300.1.1.1", ""),
    ]
    assert found("plain words only") == [] == found("")
    assert found("+1 (826) 555-4081 190.137.1.2") == [("+1 (826) 555-4081", "phone"), ("190.137.1.2", "ip")]
    for a, b, s, _, _ in pii.mentions(t):
        assert t[a:b] == s


def brute(rows, rounds, least):
    """The graph scored with dictionaries."""
    edges, seeds = set(), {}
    for text in rows:
        for _, _, s, pats, kind in pii.mentions(text or ""):
            edges |= {(s, p) for p in pats}
            if kind:
                seeds[s] = min(kind, seeds.get(s, kind))
    size = {}
    for _, p in edges:
        size[p] = size.get(p, 0) + 1
    scores = {(s, k): 1.0 for s, k in seeds.items()}
    for _ in range(rounds):
        mass = {}
        for s, p in edges:
            for k in pii.KINDS:
                if (s, k) in scores:
                    mass[p, k] = mass.get((p, k), 0) + scores[s, k]
        patterns = {(p, k): m / (size[p] + 0.5) for (p, k), m in mass.items() if size[p] >= least}
        new = {(s, k): 1.0 for s, k in seeds.items()}
        for s, p in edges:
            for k in pii.KINDS:
                c = patterns.get((p, k), 0)
                if c >= 0.3:
                    new.setdefault((s, k), 0.0)
        for s, k in list(new):
            doubt = 1.0
            for s2, p in edges:
                if s2 == s and patterns.get((p, k), 0) >= 0.3:
                    doubt *= max(1e-9, 1 - patterns[p, k] ** 2)
            new[s, k] = max(new[s, k] if s in seeds and seeds[s] == k else 0.0, 1 - doubt)
        scores = new
    return patterns


def rows():
    out = [f"mail a{i}.1{i}@mail{i % 3}.example.com now" for i in range(8)]
    out += [f'the token = "{i:02d}{"ab" * 19}" here' for i in range(9)]
    out += ['TOKEN = "' + "A1" * 20 + '"!!', "the 1234567890123456 here", "see 4012888888881881 and 4111111111111111", None, ""]
    return out


def test_bootstrap_equals_brute_force(spark):
    docs = spark.createDataFrame(list(enumerate(rows())), "doc_id long, text string")
    got = {(r["pattern"], r["kind"]): r["confidence"] for r in pii.bootstrap(pii.candidates(docs)).collect()}
    want = brute(rows(), pii.ROUNDS, pii.LEAST_INSTANCES)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_patterns_discover_unseen_and_leave_decoys(spark):
    docs = spark.createDataFrame(list(enumerate(rows())), "doc_id long, text string")
    got = {(r["instance"], r["kind"], r["seeded"]) for r in pii.extracted(docs).collect()}
    assert ("A1" * 20, "secret", False) in got
    assert not any(s == "1234567890123456" for s, _, _ in got)
    assert sum(k == "email" for _, k, _ in got) == 8 and ("4012888888881881", "card", True) in got
    seeds = spark.createDataFrame([("1234567890123456", "account"), (None, "x")], "instance string, kind string")
    assert {r["kind"] for r in pii.extracted(docs, seeds).where("instance = '1234567890123456'").collect()} <= {"account"}


def test_both_ways_of_masking_agree(spark):
    docs = spark.createDataFrame([(i, t, None if t is None else len(t)) for i, t in enumerate(rows())], "doc_id long, text string, n_chars int")
    a = sorted(map(str, pii.masked(docs).collect()))
    b = sorted(map(str, pii.masked(docs, broadcast_patterns=-1).collect()))
    assert a == b
    for r in pii.masked(docs).collect():
        if r["text"]:
            assert r["n_chars"] == len(r["text"]) and "@" not in r["text"] and not re.search(r"(ab){9}|4012", r["text"])
    assert any("1234567890123456" in (r["text"] or "") for r in pii.masked(docs).collect())


def test_edges(edge, none):
    out = pii.masked(edge)
    assert out.columns == edge.columns and out.count() == edge.count()
    assert sorted(str(r["text"]) for r in out.collect()) == sorted(str(r["text"]) for r in edge.collect())
    assert pii.extracted(edge).count() == 0 == pii.extracted(none).count() == pii.masked(none).count()


def test_null_ids_and_repeated_rows(spark):
    t = "a.1@mail.example.com x"
    docs = spark.createDataFrame([(1, t), (1, t), (None, t), (2, "b.2@mail.example.com")], "doc_id long, text string")
    got = pii.extracted(docs)
    assert sorted(r["doc_id"] for r in got.collect()) == [1, 2]
    assert [r["text"].count("[EMAIL]") for r in pii.masked(docs).collect()] == [1] * 4


def test_context_is_whole_words():
    long_ = "k" * 300
    ((*_, pats, _),) = pii.mentions(f"x {long_}  :\n 1234567 , {long_}")
    assert pats[1:] == [f"left {long_} : _ 9{{7}}", f"right 9{{7}} _ {long_}"]
    ((*_, pats, _),) = pii.mentions(f"{long_} ={' ' * 90}\"abc123456\" {long_}")
    assert pats[1:] == [f'cue {long_} = " _ a9']
    ((*_, pats, _),) = pii.mentions(f"12345678 {long_}")
    assert pats[1:] == ["left ^ _ 9{8}", f"right 9{{8}} _ {long_}"]


def test_contexts_are_linear():
    import time

    for part in ("a1b2c3d4,", "a1b2c3d4 ", "12345678" + "-" * 50, "x" * 3000 + " 12345678 "):
        began = time.perf_counter()
        assert sum(1 for _ in pii.mentions(part * (2_000_000 // len(part))))
        assert time.perf_counter() - began < 15
