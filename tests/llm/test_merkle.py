import pytest
from tests.conftest import SF, rows_of_duck, rows_of_spark

from vellumlake.llm import merkle, registry

SCHEMA = "page_id long, url string, html string, hash string, bytes int"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)


def brute(a, b):
    """Differing records by id, with their offsets in the concatenated records."""

    def laid(rows):
        import hashlib

        recs = []
        for i, u, h in rows:
            t = "WARC/1.1\r\nWARC-Type: resource\r\n" + (f"WARC-Record-ID: <urn:id:{i}>\r\n" if i is not None else "") + (f"WARC-Target-URI: {u}\r\n" if u is not None else "")
            t += f"Content-Length: {len(h.encode())}\r\n\r\n{h}\r\n\r\n" if h is not None else "\r\n\r\n"
            recs.append((i is not None, i or 0, hashlib.sha256(t.encode()).hexdigest(), i, len(t.encode())))
        out, at, copies = {}, 0, {}
        for _, _, digest, i, n in sorted(recs, key=lambda r: r[:3]):
            copies[i, digest] = copies.get((i, digest), 0) + 1
            out[i, digest, copies[i, digest]] = (at, n)
            at += n
        return out

    x, y = laid(a), laid(b)
    left, right = {}, {}
    for k in sorted(x.keys() - y.keys(), key=lambda k: (str(k[0]), k[1:])):
        left.setdefault(k[0], []).append(x[k])
    for k in sorted(y.keys() - x.keys(), key=lambda k: (str(k[0]), k[1:])):
        right.setdefault(k[0], []).append(y[k])
    rows = []
    for i in left.keys() | right.keys():
        p, q = left.get(i, []), right.get(i, [])
        for j in range(max(len(p), len(q))):
            u, v = p[j] if j < len(p) else (None, None), q[j] if j < len(q) else (None, None)
            rows.append((i, "missing" if v[0] is None else "extra" if u[0] is None else "changed", *u, *v))
    return sorted(rows, key=str)


BASE = [(i, f"http://h/{i}", "é" * (i % 7) + f"<p>{i}") for i in range(0, 700, 3)]
CASES = {
    "equal": (BASE, BASE),
    "changed": (BASE, [(i, u, h + "!" if i in (3, 300, 699) else h) for i, u, h in BASE]),
    "missing": (BASE, [r for r in BASE if r[0] not in (0, 333)]),
    "extra beyond the range": (BASE, [*BASE, (10**7, "u", "h"), (-5, "u", "h")]),
    "nulls": ([*BASE, (None, "u", None), (None, None, "x"), (5, None, "")], [*BASE, (None, "u", ""), (None, None, "x"), (5, "", "")]),
    "repeated": ([*BASE, BASE[4], BASE[4]], [*BASE, BASE[4]]),
    "hot ids": ([*BASE, *[(6, "u", f"h{i % 50}") for i in range(400)], *[(None, "u", f"n{i}") for i in range(300)]], [*BASE, *[(6, "u", f"h{i % 50}") for i in range(7, 380)], *[(None, "u", f"n{i}") for i in range(20, 330)]]),
    "copies lost": ([*BASE, *[(9, "u", "h")] * 70], [*BASE, *[(9, "u", "h")] * 20]),
    "empty replica": (BASE[:5], []),
    "empty both": ([], []),
    "empty base": ([], BASE[:2]),
    "apart": ([(1, "a", "b")], [(10**6, "a", "b")]),
}


@pytest.mark.parametrize("name", CASES)
def test_audit_equals_brute_force(spark, name):
    a, b = CASES[name]
    got = merkle.audit(pages(spark, a), pages(spark, b)).select("page_id", "fault", "offset_a", "bytes_a", "offset_b", "bytes_b")
    assert sorted(map(tuple, got.collect()), key=str) == brute(a, b)


def test_order_of_rows_does_not_matter(spark):
    a = pages(spark, BASE)
    assert merkle.audit(a, pages(spark, BASE[::-1]).repartition(5)).count() == 0


def test_query_equals_sql(spark, duck):
    got = registry.op5_merkle_audit(spark, SF)
    assert rows_of_spark(got) == rows_of_duck(duck, registry.SQL["op5_merkle_audit"])


def test_copies_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(merkle, "_CHUNK", 7)
    a, b = CASES["copies lost"]
    assert sorted(map(tuple, merkle.audit(pages(spark, a), pages(spark, b)).collect()), key=str) == brute(a, b)


def test_no_leaf_is_collected(spark):
    """Rows of one leaf reach a task in partial sums."""
    plan = merkle._leaves(merkle.records(pages(spark, BASE)))._jdf.queryExecution().toString()
    assert "collect_list" not in plan
