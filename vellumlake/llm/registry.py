"""The operators' queries, each over its whole table, and their SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import htmlscore, lblm, merkle, omh, packing, pii, quality, substrings, tokentree, wumanber


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_forest(spark, sf_dir):
    return quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).where("keep")


def op2_bootstrapped_pii(spark, sf_dir):
    return pii.extracted(table(spark, sf_dir, "documents"))


def op3_log_bilinear_scores(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return lblm.scores(docs, lblm.train(docs))


def op4_order_minhash(spark, sf_dir):
    return omh.near_duplicates(table(spark, sf_dir, "documents"))


def faulty_replica(pages: DataFrame) -> DataFrame:
    """The replica that op5 audits: pages of second listings have lost their last character on .org hosts, and are lost on .net hosts."""
    second = F.coalesce(F.col("url").contains("?page=2"), F.lit(False))
    cut = second & F.col("url").contains(".org/")
    html = F.when(cut, F.expr("substr(html, 1, length(html) - 1)")).otherwise(F.col("html"))
    return pages.where(~(second & F.col("url").contains(".net/"))).withColumn("html", html)


def op5_merkle_audit(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return merkle.audit(pages, faulty_replica(pages))


def op6_html_main_text(spark, sf_dir):
    return htmlscore.extracted(table(spark, sf_dir, "pages"))


def op7_column_packing(spark, sf_dir):
    return packing.packed(table(spark, sf_dir, "documents"))


def op8_benchmark_leaks(spark, sf_dir):
    return wumanber.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_edit_token_counts(spark, sf_dir):
    return tokentree.edit_counts(table(spark, sf_dir, "documents"))


def op10_repeated_spans(spark, sf_dir):
    return substrings.repeated_spans(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_forest,
        op2_bootstrapped_pii,
        op3_log_bilinear_scores,
        op4_order_minhash,
        op5_merkle_audit,
        op6_html_main_text,
        op7_column_packing,
        op8_benchmark_leaks,
        op9_edit_token_counts,
        op10_repeated_spans,
    )
}

SQL = {
    "op5_merkle_audit": r"""
WITH r AS (SELECT page_id, url, html, url LIKE '%?page=2%' AND url LIKE '%.org/%' AS cut, url LIKE '%?page=2%' AND url LIKE '%.net/%' AS gone FROM pages),
s AS (SELECT *, 54 + octet_length(encode(CAST(page_id AS VARCHAR))) + 21 + octet_length(encode(url)) AS head, CASE WHEN cut THEN substr(html, 1, length(html) - 1) ELSE html END AS other FROM r),
t AS (SELECT page_id, cut, gone, octet_length(encode(html)) AS la, octet_length(encode(other)) AS lb, head FROM s),
u AS (SELECT page_id, cut, gone, head + length(CAST(la AS VARCHAR)) + la + 26 AS bytes_a, CASE WHEN NOT gone THEN head + length(CAST(lb AS VARCHAR)) + lb + 26 END AS bytes_b FROM t),
v AS (SELECT *, sum(bytes_a) OVER w - bytes_a AS offset_a, sum(bytes_b) OVER w - bytes_b AS offset_b FROM u WINDOW w AS (ORDER BY page_id ROWS UNBOUNDED PRECEDING))
SELECT page_id, CASE WHEN gone THEN 'missing' ELSE 'changed' END AS fault, CAST(offset_a AS BIGINT) AS offset_a, CAST(bytes_a AS BIGINT) AS bytes_a, CAST(offset_b AS BIGINT) AS offset_b, CAST(bytes_b AS BIGINT) AS bytes_b
FROM v WHERE cut OR gone
""",
    "op8_benchmark_leaks": r"""
WITH b AS (SELECT item_id, list_filter(string_split(regexp_replace(lower(text), '[\x00-/:-@\[-`{-\x7f]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM benchmark),
i AS (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM b WHERE len(w) >= 5),
p AS (SELECT DISTINCT item_id, ' ' || array_to_string(w[k:k + 9], ' ') || ' ' AS pattern FROM i),
d AS (SELECT doc_id, ' ' || trim(regexp_replace(lower(text), '[\x00-/:-@\[-`{-\x7f]+', ' ', 'g')) || ' ' AS t FROM documents)
SELECT doc_id, item_id, CAST(count(*) AS INTEGER) AS windows FROM d JOIN p ON contains(t, pattern) GROUP BY doc_id, item_id
""",
    "op10_repeated_spans": r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \t\n\x0b\x0c\r]+'), lambda x: x <> '') AS a FROM documents),
p AS (SELECT doc_id, a, unnest(range(0, greatest(len(a) - 49, 0))) AS pos FROM w),
x AS (SELECT doc_id, pos, md5(array_to_string(a[pos + 1:pos + 50], ' ')) AS h FROM p),
c AS (SELECT doc_id, pos, count(*) OVER (PARTITION BY h) AS n FROM x),
f AS (SELECT DISTINCT doc_id, pos, n FROM c WHERE n > 1 AND doc_id IS NOT NULL),
g AS (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) <= 50 THEN 0 ELSE 1 END AS s FROM f),
i AS (SELECT *, sum(s) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS part FROM g)
SELECT doc_id, CAST(min(pos) AS INTEGER) AS start_word, CAST(max(pos) + 50 AS INTEGER) AS end_word, CAST(count(DISTINCT pos) AS INTEGER) AS windows, max(n) AS copies
FROM i GROUP BY doc_id, part
""",
}
