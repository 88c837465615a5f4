"""Merkle fixity audit of WARC records: two replicas' hash trees are compared from the root, and only mismatching branches descended.

A record is one WARC block: header lines and payload.  Records lie in order of record id; equal ids in order of their hash.
A leaf is the ordered range of ids that share `id >> BITS`; its hash is taken over sums of its records' hashes by limbs, their number and
bytes, which partial aggregation adds up, so that no leaf, however many copies of an id or null ids it holds, is collected.  A node is
hashed over its children of the level below, FANOUT at most.  Every level keeps its byte length, from which offsets follow on the way down: a child begins where its
parent begins plus the lengths of the siblings before it, so no pass over the whole order is needed.  Trees of both
replicas are written to the shared folder, as sites that hold replicas would publish them.

Ids far apart make levels with as many nodes as records, of about 100 bytes each.  In mismatching leaves equal records are counted, and records
of one id are ranked by slots of their hash, so that no id is ranked in one task.

Defined cases: null ids form a range of their own at the front of the order; null urls or payloads hash as absent, unlike empty
ones; repeated records count, and a replica that holds a record more or fewer times mismatches; a replica without records
mismatches at the root with every record of the other; extra columns are ignored; equal replicas give an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import written

BITS = 6
LEAF = FANOUT = 1 << BITS
_ZERO = (1 << 57) + (1 << 12)  # the leaf of id 0: leaves of negative ids are positive too, and 0 is left for null ids


def record_bytes(record_id: Column, uri: Column, payload: Column) -> Column:
    """The text of a WARC record; absent fields leave their line out."""
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\n"),
        F.coalesce(F.concat(F.lit("WARC-Record-ID: <urn:id:"), record_id.cast("string"), F.lit(">\r\n")), F.lit("")),
        F.coalesce(F.concat(F.lit("WARC-Target-URI: "), uri, F.lit("\r\n")), F.lit("")),
        F.coalesce(F.concat(F.lit("Content-Length: "), F.octet_length(payload).cast("string"), F.lit("\r\n\r\n"), payload, F.lit("\r\n\r\n")), F.lit("\r\n\r\n")),
    )


def records(pages: DataFrame) -> DataFrame:
    """(page_id, leaf, bytes, hash) of each record; the text is hashed where it is read and goes no further."""
    text = record_bytes(F.col("page_id"), F.col("url"), F.col("html"))
    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), F.octet_length(text).cast("long").alias("bytes"), F.sha2(text, 256).alias("hash"))
    return slim.withColumn("leaf", F.coalesce(F.expr(f"shiftright(page_id, {BITS}) + {_ZERO}L"), F.lit(0).cast("long")))


_LIMBS = 9  # of 28 bits of a SHA-256 each, so that sums of 2 ** 35 records fit
_CHUNK = 10_000


def _leaves(recs: DataFrame) -> DataFrame:
    limbs = [F.conv(F.substring("hash", 1 + 7 * i, 7), 16, 10).cast("long").alias(f"l{i}") for i in range(_LIMBS)]
    sums = recs.select("leaf", "bytes", *limbs).groupBy(F.col("leaf").alias("node")).agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("n"), *[F.sum(f"l{i}").alias(f"l{i}") for i in range(_LIMBS)])
    return sums.select("node", "bytes", F.sha2(F.concat_ws(",", "n", "bytes", *[f"l{i}" for i in range(_LIMBS)]), 256).alias("hash"))


def _parents(children: DataFrame) -> DataFrame:
    inner = F.sort_array(F.collect_list(F.struct("node", "hash", "bytes")))  # FANOUT at most
    return children.groupBy(F.expr(f"shiftright(node, {BITS})").alias("node")).agg(F.sum("bytes").alias("bytes"), F.sha2(F.to_json(inner), 256).alias("hash"))


def tree(recs: DataFrame, what: str) -> list[DataFrame]:
    """Levels from leaves to root, each (node, bytes, hash); the lowest is written, and those above from it."""
    levels = [written(_leaves(recs), f"{what}-leaves")]
    least, most = levels[0].agg(F.min("node"), F.max("node")).first()
    while least != most:
        levels.append(written(_parents(levels[-1]), f"{what}-level{len(levels)}"))
        least, most = least // FANOUT, most // FANOUT
    return levels


def _side_by_side(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key, F.col("bytes").alias("bytes_a"), F.col("hash").alias("hash_a")).join(b.select(key, F.col("bytes").alias("bytes_b"), F.col("hash").alias("hash_b")), key, "full_outer")


def _ahead(rows: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """rows with the sum of `value` over those of less hash with equal `by`, taken by slots of the hash."""
    rows = rows.withColumn("slot", F.substring("hash", 1, 3))
    before = F.coalesce(F.sum("part").over(Window.partitionBy(*by).orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    slots = rows.groupBy(*by, "slot").agg(F.sum(value).alias("part")).select(*by, "slot", before.alias("before"))  # 4,096 an id at most
    inner = F.coalesce(F.sum(value).over(Window.partitionBy(*by, "slot").orderBy("hash").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn(name, inner).join(slots, [*by, "slot"]).withColumn(name, F.col(name) + F.col("before")).drop("slot", "before")


def _within(recs: DataFrame, bad: DataFrame, side: str) -> DataFrame:
    """Distinct records of mismatching leaves: known, pid, hash, bytes, their copies n and where the first copy begins."""
    here = recs.join(bad.select(F.col("node").alias("leaf"), F.col(f"start_{side}").alias("start")), "leaf")
    keys = [F.col("page_id").isNotNull().alias("known"), F.coalesce("page_id", F.lit(0)).alias("pid")]
    same = here.groupBy("leaf", "start", *keys, "hash", "bytes").agg(F.count(F.lit(1)).alias("n")).withColumn("all", F.col("n") * F.col("bytes"))
    same = written(same, "warc-within")
    before = F.coalesce(F.sum("size").over(Window.partitionBy("leaf").orderBy("known", "pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ids = same.groupBy("leaf", "known", "pid").agg(F.sum("all").alias("size")).select("known", "pid", before.alias("ahead"))  # a leaf has FANOUT ids at most
    ranked = _ahead(same, ["known", "pid"], "all", "inside").join(ids, ["known", "pid"])
    return ranked.select("known", "pid", "hash", F.col("n").alias(f"n_{side}"), F.col("bytes").alias(f"bytes_{side}"), (F.col("start") + F.col("ahead") + F.col("inside")).alias(f"offset_{side}"))


def _excess(both: DataFrame, side: str, other: str) -> DataFrame:
    """One row a copy that only `side` has: known, pid, its rank nth among those of its id, offset and bytes."""
    mine, theirs = F.coalesce(f"n_{side}", F.lit(0)), F.coalesce(f"n_{other}", F.lit(0))
    rows = both.withColumn("more", mine - theirs).where("more > 0").withColumn("shared", theirs)
    rows = _ahead(rows.select("known", "pid", "hash", "more", "shared", f"offset_{side}", f"bytes_{side}"), ["known", "pid"], "more", "rank")
    # in chunks, so that no row of very many copies makes one array
    rows = rows.withColumn("begin", F.explode(F.sequence(F.lit(0).cast("long"), F.col("more") - 1, F.lit(_CHUNK).cast("long"))))
    rows = rows.withColumn("copy", F.explode(F.sequence("begin", F.least(F.col("begin") + _CHUNK, F.col("more")) - 1)))
    return rows.select("known", "pid", (F.col("rank") + F.col("copy")).alias("nth"), (F.col(f"offset_{side}") + (F.col("shared") + F.col("copy")) * F.col(f"bytes_{side}")).alias(f"offset_{side}"), f"bytes_{side}")


def audit(a: DataFrame, b: DataFrame) -> DataFrame:
    """Records at fault between replicas a and b of (page_id, url, html): one row a record id and side by side fault.

    page_id; fault: 'changed', 'missing' (b lacks it) or 'extra' (only b has it); offset_a, bytes_a, offset_b, bytes_b: where the
    record lies in each replica, null where it doesn't.  See the module for the defined cases.
    """
    ra, rb = written(records(a), "warc-a"), written(records(b), "warc-b")
    ta, tb = tree(ra, "warc-a"), tree(rb, "warc-b")
    while len(ta) < len(tb) or len(tb) < len(ta):  # replicas of different span: the lower tree gets higher roots
        low = ta if len(ta) < len(tb) else tb
        low.append(_parents(low[-1]))
    bad = None
    for la, lb in zip(reversed(ta), reversed(tb)):
        if bad is None:
            level = _side_by_side(la, lb, "node").withColumn("parent", F.lit(0).cast("long")).withColumn("start_a", F.lit(0).cast("long")).withColumn("start_b", F.lit(0).cast("long"))
        else:
            up = F.expr(f"shiftright(node, {BITS})")
            asked = bad.select(F.col("node").alias("parent"), "start_a", "start_b")
            inner = [x.withColumn("parent", up).join(asked.select("parent"), "parent", "left_semi") for x in (la, lb)]
            level = _side_by_side(*(x.select("node", "bytes", "hash") for x in inner), "node").withColumn("parent", up).join(asked, "parent")
        before = Window.partitionBy("parent").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
        level = level.withColumns({f"start_{s}": F.col(f"start_{s}") + F.coalesce(F.sum(f"bytes_{s}").over(before), F.lit(0)) for s in "ab"})
        bad = written(level.where(~F.col("hash_a").eqNullSafe(F.col("hash_b"))).select("node", "start_a", "start_b"), "warc-bad")
        if not bad.limit(1).count():
            break
    ia, ib = _within(ra, bad, "a"), _within(rb, bad, "b")
    both = written(ia.join(ib, ["known", "pid", "hash"], "full_outer").where("not (n_a <=> n_b)"), "warc-faults")
    found = _excess(both, "a", "b").join(_excess(both, "b", "a"), ["known", "pid", "nth"], "full_outer")
    fault = F.when(F.col("offset_b").isNull(), "missing").when(F.col("offset_a").isNull(), "extra").otherwise("changed")
    return found.select(F.when(F.col("known"), F.col("pid")).alias("page_id"), fault.alias("fault"), "offset_a", "bytes_a", "offset_b", "bytes_b")
