"""Registered queries: every operator over whole tables, with its SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import functions as fn
from ..operators import membership, merge, stats, vector
from ..operators.index import build_index, index_diff, matching_ids, postings
from ..operators.search import Query, get_by_key
from ..sources import corpus as src
from ..sources.files import ndjson_lines, zip_names

NOW = 1_735_689_600
FILTERS = {"size": ["short", "long"], "tag": ["en", "fr"]}

QUERIES: dict = {}
SQL: dict[str, str] = {}

_AZ = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_LANG = "CASE d.lang WHEN 'en' THEN 'en_US' WHEN 'de' THEN 'de_DE' WHEN 'fr' THEN 'fr_FR' ELSE 'es_ES' END"
CORPUS = f"""
corpus AS (
  SELECT d.source AS collection, 'Doc-' || d.doc_id AS key, {_LANG} AS lang, {_AZ.format(f"d.source || '|Doc-' || d.doc_id || '|' || {_LANG}")} AS id,
    d.text AS content_md, d.lang AS short_lang, CASE WHEN length(d.text) < 1024 THEN 'short' WHEN length(d.text) < 10240 THEN 'medium' ELSE 'long' END AS size,
    l.quality, l.toxic, d.doc_id AS n, l.doc_id IS NOT NULL AS labelled,
    1704067200 + d.doc_id * 60 AS added_at, 1704067200 + d.doc_id * 60 + (d.doc_id % 7) * 3600 AS updated_at
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""
IDX = (
    CORPUS
    + """,
idx AS (
  SELECT DISTINCT * FROM (
    SELECT collection, 'size' AS meta_key, size AS meta_value, id AS doc_id FROM corpus
    UNION ALL SELECT collection, 'lang', short_lang, id FROM corpus
    UNION ALL SELECT collection, 'tag', collection, id FROM corpus
    UNION ALL SELECT collection, 'tag', short_lang, id FROM corpus
    UNION ALL SELECT collection, 'tag', 'table', id FROM corpus WHERE contains(content_md, '|')
    UNION ALL SELECT collection, 'tag', 'lines', id FROM corpus WHERE contains(content_md, chr(10))
    UNION ALL SELECT collection, 'quality', CAST(quality AS VARCHAR), id FROM corpus WHERE quality IS NOT NULL
    UNION ALL SELECT collection, 'toxic', CAST(toxic AS VARCHAR), id FROM corpus WHERE toxic IS NOT NULL))"""
)
EDITS = (
    CORPUS
    + f""",
edits AS (
  SELECT collection, key, lang, id, content_md || ' (edited)' AS content_md, n AS seq, 'state' AS mk, 'edited' AS mv, true AS save FROM corpus WHERE labelled
  UNION ALL SELECT 'pages', 'Page-' || page_id, 'en_US', {_AZ.format("'pages|Page-' || page_id || '|en_US'")}, html, page_id, 'url', url, false FROM pages
  UNION ALL SELECT 'pages', 'Item-' || item_id, '', {_AZ.format("'pages|Item-' || item_id || '|'")}, text, item_id, NULL, NULL, false FROM benchmark)"""
)
REVS = """
revs AS (SELECT 'talk' AS collection, 'talk|conv-' || conv_id || '|en_us' AS doc_id, 1704067200 + turn AS ts, text AS content_md, role FROM conversations)"""
CHANGES = """
changes AS (SELECT user_id AS entity, CAST(floor(epoch(ts)) AS BIGINT) AS ts, event_id AS seq, CASE event_type WHEN 'error' THEN 'delete' ELSE 'upsert' END AS op, event_type AS value FROM events)"""
DOC_COLS = "collection, id, key, lang, content_md, added_at, updated_at"


def query(sql: str | None = None):
    """Register a query, with its SQL."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def flat(docs):
    """Documents without their map."""
    return docs.select(*[c for c in DOC_COLS.split(", ")])


# scans, search, pages


@query(f"WITH {CORPUS} SELECT {DOC_COLS} FROM corpus WHERE collection = 'src3'")
def scan_collection(spark, sf_dir):
    return flat(Query("src3").matches(src.corpus(spark, sf_dir)))


@query(f"WITH {CORPUS} SELECT {DOC_COLS} FROM corpus WHERE size IN ('short', 'long') AND short_lang IN ('en', 'fr')")
def search_meta_and_or(spark, sf_dir):
    """AND over keys, OR over values, in every collection."""
    docs = src.corpus(spark, sf_dir)
    for k, v in FILTERS.items():
        docs = docs.where(F.coalesce(F.arrays_overlap(F.col("meta")[k], F.array(*map(F.lit, v))), F.lit(False)))
    return flat(docs)


@query(f"WITH {IDX} SELECT {DOC_COLS} FROM corpus WHERE collection = 'src3' AND id IN (SELECT doc_id FROM idx WHERE collection = 'src3' AND (meta_key = 'size' AND meta_value IN ('short', 'long') OR meta_key = 'tag' AND meta_value IN ('en', 'fr')) GROUP BY doc_id HAVING count(DISTINCT meta_key) = 2)")
def search_index_form(spark, sf_dir):
    docs = src.corpus(spark, sf_dir)
    return flat(Query("src3", FILTERS).matches(docs, build_index(docs)))


@query(f"WITH {CORPUS} SELECT {DOC_COLS} FROM corpus WHERE collection = 'src3' AND size IN ('short', 'long') AND short_lang IN ('en', 'fr')")
def search_map_form(spark, sf_dir):
    return flat(Query("src3", FILTERS).matches(src.corpus(spark, sf_dir)))


@query(f"WITH {CORPUS} SELECT {DOC_COLS} FROM corpus WHERE false")
def search_empty_values(spark, sf_dir):
    """A key without values matches nothing."""
    return flat(Query("src3", {"size": []}).matches(src.corpus(spark, sf_dir)))


def _page(name: str, sort: str, column: str, asc: bool) -> None:
    order = f"{column} {'ASC' if asc else 'DESC'}, " if column else ""

    def run(spark, sf_dir):
        return flat(Query("src3", {}, sort, asc, 5, 10).of(src.corpus(spark, sf_dir)))

    run.__name__ = name
    query(f"WITH {CORPUS} SELECT {DOC_COLS} FROM corpus WHERE collection = 'src3' ORDER BY {order}id LIMIT 5 OFFSET 10")(run)


for _sort, _column in (("addedAt", "added_at"), ("updatedAt", "updated_at"), ("key", "key")):
    for _asc in (True, False):
        _page(f"page_sorted_{_column.removesuffix('_at')}_{'asc' if _asc else 'desc'}", _sort, _column, _asc)
_page("page_unsorted", "", "", False)


@query(f"WITH {CORPUS}, m AS (SELECT *, count(*) OVER () AS total FROM corpus WHERE collection = 'src3' AND size IN ('short', 'long')) SELECT {DOC_COLS}, total FROM m ORDER BY updated_at DESC, id LIMIT 50 OFFSET 2")
def search_total(spark, sf_dir):
    """Number of matches before paging; limit 0 is the default page."""
    found = Query("src3", {"size": ["short", "long"]}, "updatedAt", False, 0, 2).of(src.corpus(spark, sf_dir), total=True)
    return found.select(*DOC_COLS.split(", "), "total")


@query(f"WITH {CORPUS} SELECT count(*) AS n FROM corpus WHERE false")
def page_past_end(spark, sf_dir):
    return Query("src3", {}, "key", True, 50, 10**9).of(src.corpus(spark, sf_dir)).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {CORPUS} SELECT c.collection, c.id, c.key, c.content_md FROM corpus c WHERE labelled")
def get_by_key_labelled(spark, sf_dir):
    """Point lookups of every labelled document by its exact spelling."""
    docs = src.corpus(spark, sf_dir)
    labels = src.table(spark, sf_dir, "labels").select(F.concat(F.lit("Doc-"), "doc_id").alias("key")).distinct()
    wanted = docs.select("collection", "key", "lang").join(labels, "key", "left_semi")
    return get_by_key(docs, src.aliases(docs), wanted).select("collection", "id", "key", "content_md")


@query(f"WITH {CORPUS} SELECT id, key FROM corpus WHERE false")
def get_alias_miss(spark, sf_dir):
    """A spelling that was never written finds nothing, though the id exists."""
    docs = src.corpus(spark, sf_dir)
    wanted = docs.select("collection", F.upper("key").alias("key"), "lang")
    return get_by_key(docs, src.aliases(docs), wanted).select("id", "key")


# scalar functions


@query("SELECT doc_id, replace(replace('Hi %%name%% of %%site%%, %%other%%: ' || text, '%%name%%', 'Ann'), '%%site%%', 'here') AS content FROM documents")
def template_apply(spark, sf_dir):
    text = F.concat(F.lit("Hi %%name%% of %%site%%, %%other%%: "), "text")
    return src.table(spark, sf_dir, "documents").select("doc_id", fn.apply_env(text, {"site": "here", "name": "Ann"}).alias("content"))


@query("SELECT doc_id, replace(replace('%%lang%% %%source%%: ' || text, '%%lang%%', lang), '%%source%%', source) AS content FROM documents")
def template_apply_rows(spark, sf_dir):
    """A template environment for each row."""
    env = F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source"))
    return src.table(spark, sf_dir, "documents").select("doc_id", fn.apply_env(F.concat(F.lit("%%lang%% %%source%%: "), "text"), env).alias("content"))


@query(f"WITH {CORPUS} SELECT n AS doc_id, id FROM corpus")
def doc_id(spark, sf_dir):
    return src.corpus(spark, sf_dir).select(F.substring_index("key", "-", -1).cast("long").alias("doc_id"), "id")


@query("SELECT page_id, regexp_replace(url, '[^a-zA-Z0-9_-]', '-', 'g') AS name FROM pages")
def safe_filename(spark, sf_dir):
    return src.table(spark, sf_dir, "pages").select("page_id", fn.safe_name("url").alias("name"))


@query("SELECT page_id, regexp_replace(regexp_replace(regexp_replace(translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]', '-', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM pages")
def slug(spark, sf_dir):
    return src.table(spark, sf_dir, "pages").select("page_id", fn.slugify(F.concat("url", F.lit(".md"))).alias("slug"))


@query("SELECT p_partkey, k AS meta_key, v AS meta_value FROM (SELECT p_partkey, 'brand' AS k, unnest([p_brand, 'x']) AS v FROM part UNION ALL SELECT p_partkey, 'size', CAST(p_size AS VARCHAR) FROM part)")
def parse_meta(spark, sf_dir):
    """The command line's mini-syntax; the first size is overridden."""
    text = F.concat(F.lit("size=0,brand="), "p_brand", F.lit("|x,junk,size="), "p_size")
    return src.table(spark, sf_dir, "part").select("p_partkey", F.explode(fn.parse_meta(text)).alias("meta_key", "vs")).select("p_partkey", "meta_key", F.explode("vs").alias("meta_value"))


@query("SELECT p_partkey, unnest(['brand', 'eq']) AS k, unnest([p_brand, 'a=b']) AS v FROM part")
def parse_env(spark, sf_dir):
    text = F.concat(F.lit("brand="), "p_brand", F.lit(",junk,eq=a=b"))
    return src.table(spark, sf_dir, "part").select("p_partkey", F.explode(fn.parse_env(text)).alias("k", "v"))


@query("SELECT doc_id, unnest(['title', 'tags', 'lang']) AS k, unnest(['Doc ' || doc_id, source || ', b', lang]) AS v FROM documents")
def frontmatter(spark, sf_dir):
    head = F.concat(F.lit('---\ntitle: "Doc '), "doc_id", F.lit('"\ntags: '), "source", F.lit(", b\nno colon\nlang: '"), "lang", F.lit("'\n---\n"), "text")
    return src.table(spark, sf_dir, "documents").select("doc_id", F.explode(fn.frontmatter(head)).alias("k", "v"))


@query(f"WITH {REVS} SELECT doc_id, ts, lpad(CAST(ts AS VARCHAR), 20, '0') AS padded FROM revs")
def zero_pad_ts(spark, sf_dir):
    return src.revisions(spark, sf_dir).select("doc_id", "ts", fn.zero_pad("ts").alias("padded"))


@query(f"WITH {CORPUS} SELECT id, split_part(id, '|', 1) AS p0, split_part(id, '|', 3) AS p2, CAST(NULL AS VARCHAR) AS p3, instr(id, '|') - 1 AS first_bar, length(id) - instr(reverse(id), '|') AS last_bar, CASE WHEN id < key THEN -1 WHEN id > key THEN 1 ELSE 0 END AS cmp, starts_with(id, 'src1') AS has_prefix FROM corpus")
def byte_string_functions(spark, sf_dir):
    c = src.corpus(spark, sf_dir)
    return c.select(
        "id", fn.nth_part("id", "|", 0).alias("p0"), fn.nth_part("id", "|", 2).alias("p2"), fn.nth_part("id", "|", 3).alias("p3"), fn.index_of("id", "|").cast("long").alias("first_bar"),
        fn.last_index_of("id", "|").cast("long").alias("last_bar"), fn.compare("id", "key").alias("cmp"), F.startswith("id", F.lit("src1")).alias("has_prefix"),
    )


@query()
def checksums(spark, sf_dir):
    """CRC-32 and FNV-1a of every text's bytes."""
    return src.table(spark, sf_dir, "documents").select("doc_id", F.crc32(F.encode("text", "UTF-8")).alias("crc"), fn.fnv1a32(F.col("text")).alias("fnv32"), fn.fnv1a64(F.col("text")).alias("fnv64"))


@query("SELECT event_id, strftime(to_timestamp(floor(epoch(ts))) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS at FROM events")
def iso_times(spark, sf_dir):
    return src.table(spark, sf_dir, "events").select("event_id", fn.iso_time(F.unix_timestamp("ts")).alias("at"))


@query("SELECT doc_id, CASE WHEN b = 0 THEN '0 B' WHEN b < 1024 THEN b || ' B' WHEN b < 1048576 THEN regexp_replace(printf('%.2f', round(b / 1024.0, 2)), '\\.?0+$', '') || ' KB' ELSE regexp_replace(printf('%.2f', round(b / 1048576.0, 2)), '\\.?0+$', '') || ' MB' END AS shown FROM (SELECT doc_id, octet_length(encode(text)) AS b FROM documents)")
def human_sizes(spark, sf_dir):
    return src.table(spark, sf_dir, "documents").select("doc_id", fn.human_bytes(F.octet_length("text")).alias("shown"))


@query()
def delta_roundtrip(spark, sf_dir):
    """Delta of each document against a longer one and back: sizes, and whether the round trip is exact."""
    d = src.table(spark, sf_dir, "documents").select("doc_id", "text", F.concat("text", F.lit(" tail")).alias("new"))
    d = d.withColumn("delta", fn.delta_encode("text", "new"))
    return d.select("doc_id", F.octet_length("delta").alias("delta_bytes"), F.octet_length("new").alias("full_bytes"), (fn.delta_decode("text", "delta") == F.col("new")).alias("exact"))


@query()
def compression_ratio(spark, sf_dir):
    return src.table(spark, sf_dir, "documents").select("doc_id", fn.storage_tier("text").alias("tier"), fn.zstd_ratio("text").alias("ratio"))


# sinks


@query()
def ndjson(spark, sf_dir):
    return ndjson_lines(src.corpus(spark, sf_dir))


@query(f"WITH {CORPUS} SELECT id, regexp_replace(key, '[^a-zA-Z0-9_-]', '-', 'g') || '.' || regexp_replace(lang, '[^a-zA-Z0-9_-]', '-', 'g') || '.md' AS file_name FROM corpus")
def zip_manifest(spark, sf_dir):
    return zip_names(src.corpus(spark, sf_dir))


# index and sets


@query(f"WITH {IDX} SELECT * FROM idx")
def index_build(spark, sf_dir):
    return build_index(src.corpus(spark, sf_dir))


_AFTER = "after AS (SELECT * FROM idx WHERE doc_id NOT IN (SELECT id FROM edits) UNION ALL SELECT DISTINCT collection, mk, mv, id FROM edits WHERE lang <> '' AND mk IS NOT NULL)"
_BOTH = IDX + EDITS.replace(CORPUS, "")


@query(f"WITH {_BOTH}, {_AFTER} SELECT *, 'del' AS op FROM (SELECT * FROM idx EXCEPT SELECT * FROM after) UNION ALL SELECT *, 'put' FROM (SELECT * FROM after EXCEPT SELECT * FROM idx)")
def index_diff_after_batch(spark, sf_dir):
    docs = src.corpus(spark, sf_dir)
    after = merge.upsert_batch(docs, src.edits(spark, sf_dir), NOW).state
    return index_diff(build_index(docs), build_index(after))


@query(f"WITH {IDX} SELECT DISTINCT doc_id FROM idx")
def distinct_ids(spark, sf_dir):
    return build_index(src.corpus(spark, sf_dir)).select("doc_id").distinct()


@query(f"WITH {IDX} SELECT doc_id FROM idx WHERE collection = 'src3' AND meta_key = 'tag' AND meta_value = 'en' UNION SELECT doc_id FROM idx WHERE collection = 'src3' AND meta_key = 'size' AND meta_value IN ('short', 'long')")
def union_postings(spark, sf_dir):
    index = build_index(src.corpus(spark, sf_dir))
    return postings(index, "src3", "tag", ["en"]).union(postings(index, "src3", "size", ["short", "long"])).distinct()


@query(f"WITH {IDX} SELECT doc_id FROM idx WHERE collection = 'src3' AND meta_key = 'tag' AND meta_value IN ('en', 'fr') INTERSECT SELECT doc_id FROM idx WHERE collection = 'src3' AND meta_key = 'size' AND meta_value IN ('short', 'long')")
def intersect_postings(spark, sf_dir):
    return matching_ids(build_index(src.corpus(spark, sf_dir)), "src3", FILTERS)


@query(f"WITH {IDX} SELECT doc_id FROM idx WHERE collection = 'src3' AND meta_key = 'size' AND meta_value IN ('short', 'long') EXCEPT SELECT doc_id FROM idx WHERE collection = 'src3' AND meta_key = 'tag' AND meta_value = 'en'")
def except_postings(spark, sf_dir):
    index = build_index(src.corpus(spark, sf_dir))
    return postings(index, "src3", "size", ["short", "long"]).subtract(postings(index, "src3", "tag", ["en"]))


@query(f"WITH {EDITS} SELECT c.id, true AS changed FROM corpus c JOIN edits e ON c.id = e.id AND c.collection = e.collection UNION ALL SELECT id, false FROM corpus WHERE NOT labelled")
def meta_changed(spark, sf_dir):
    """Whether a batch changes a document's metadata."""
    docs = src.corpus(spark, sf_dir)
    after = merge.upsert_batch(docs, src.edits(spark, sf_dir), NOW).state.select("collection", "id", F.col("meta").alias("new_meta"))
    return docs.join(after, ["collection", "id"]).select("id", fn.meta_changed("meta", "new_meta").alias("changed"))


# writes

_UPSERTED = f"""
  SELECT collection, id, key, lang, content_md, added_at, updated_at FROM corpus WHERE NOT labelled
  UNION ALL SELECT e.collection, e.id, e.key, e.lang, e.content_md, coalesce(c.added_at, {NOW}), {NOW} FROM edits e LEFT JOIN corpus c ON c.id = e.id AND c.collection = e.collection WHERE e.lang <> ''"""


@query(f"WITH {EDITS} {_UPSERTED}")
def upsert_batch_state(spark, sf_dir):
    return flat(merge.upsert_batch(src.corpus(spark, sf_dir), src.edits(spark, sf_dir), NOW).state)


@query(f"WITH {EDITS} SELECT count(*) FILTER (lang <> '' AND id NOT IN (SELECT id FROM corpus)) AS added, count(*) FILTER (lang <> '' AND id IN (SELECT id FROM corpus)) AS updated, count(*) FILTER (lang = '') AS failed FROM edits")
def upsert_batch_counts(spark, sf_dir):
    return merge.upsert_batch(src.corpus(spark, sf_dir), src.edits(spark, sf_dir), NOW).counts


@query(f"WITH {EDITS} SELECT key || ': missing key or lang' AS error FROM edits WHERE lang = ''")
def upsert_batch_errors(spark, sf_dir):
    return merge.upsert_batch(src.corpus(spark, sf_dir), src.edits(spark, sf_dir), NOW).errors


@query(f"SELECT 'talk' AS collection, 'talk|conv-' || conv_id || '|en_us' AS id, arg_max(text, turn) AS content_md, CAST({NOW} AS BIGINT) AS added_at FROM conversations GROUP BY conv_id")
def upsert_duplicates_last_wins(spark, sf_dir):
    empty = src.corpus(spark, sf_dir).where(F.lit(False))
    return merge.upsert_batch(empty, src.turns(spark, sf_dir), NOW).state.select("collection", "id", "content_md", "added_at")


@query("SELECT count(*) AS added, CAST(0 AS BIGINT) AS updated, CAST(0 AS BIGINT) AS failed FROM conversations")
def upsert_duplicates_counts(spark, sf_dir):
    """Duplicates of one batch all count by the state before it."""
    empty = src.corpus(spark, sf_dir).where(F.lit(False))
    return merge.upsert_batch(empty, src.turns(spark, sf_dir), NOW).counts


@query(f"WITH {EDITS} SELECT collection, id, key, lang, CASE WHEN labelled THEN content_md || ' (edited)' ELSE content_md END AS content_md, added_at, CASE WHEN labelled THEN {NOW} ELSE updated_at END AS updated_at FROM corpus")
def update_batch_state(spark, sf_dir):
    return flat(merge.update_batch(src.corpus(spark, sf_dir), src.edits(spark, sf_dir), NOW).state)


@query(f"WITH {EDITS} SELECT count(*) FILTER (lang <> '' AND id IN (SELECT id FROM corpus)) AS updated, count(*) FILTER (lang <> '' AND id NOT IN (SELECT id FROM corpus)) AS not_found, count(*) FILTER (lang = '') AS failed FROM edits")
def update_batch_counts(spark, sf_dir):
    return merge.update_batch(src.corpus(spark, sf_dir), src.edits(spark, sf_dir), NOW).counts


@query(f"WITH {CORPUS} SELECT {DOC_COLS} FROM corpus WHERE NOT labelled")
def delete_batch_state(spark, sf_dir):
    return flat(merge.delete_batch(src.corpus(spark, sf_dir), src.edits(spark, sf_dir)).state)


@query(f"WITH {EDITS} SELECT count(*) FILTER (lang <> '' AND id IN (SELECT id FROM corpus)) AS deleted, count(*) FILTER (lang <> '' AND id NOT IN (SELECT id FROM corpus)) AS not_found, count(*) FILTER (lang = '') AS failed FROM edits")
def delete_batch_counts(spark, sf_dir):
    return merge.delete_batch(src.corpus(spark, sf_dir), src.edits(spark, sf_dir)).counts


@query(f"WITH {CORPUS} SELECT {DOC_COLS} FROM corpus WHERE collection <> 'src3'")
def delete_collection(spark, sf_dir):
    return flat(merge.delete_collection(src.corpus(spark, sf_dir), "src3").state)


@query(f"WITH {CORPUS} SELECT count(*) AS deleted FROM corpus WHERE collection = 'src3'")
def delete_collection_count(spark, sf_dir):
    return merge.delete_collection(src.corpus(spark, sf_dir), "src3").counts


# revisions


@query(f"WITH {REVS}, w AS (SELECT doc_id, 1704067200 AS ts, arg_max(content_md, ts) AS content_md FROM revs GROUP BY doc_id) SELECT 'talk' AS collection, doc_id, ts, content_md FROM revs WHERE ts <> 1704067200 UNION ALL SELECT 'talk', doc_id, ts, content_md FROM w")
def revision_append(spark, sf_dir):
    """New revisions of the same second replace those of before."""
    old = src.revisions(spark, sf_dir)
    written = merge.upsert_batch(src.corpus(spark, sf_dir).where(F.lit(False)), src.turns(spark, sf_dir), src.T0).revisions
    return merge.append_revisions(old, written).select("collection", "doc_id", "ts", "doc.content_md")


def _truncate(name: str, keep: int) -> None:
    def run(spark, sf_dir):
        return merge.truncate(src.revisions(spark, sf_dir), src.talk_docs(spark, sf_dir), "talk", keep).select("collection", "doc_id", "ts", "doc.content_md")

    run.__name__ = name
    alive = "SELECT 'talk|conv-' || conv_id || '|en_us' FROM conversations WHERE turn = 0 AND role = 'user'"
    where = "true" if keep < 0 else f"nth <= {keep} OR doc_id NOT IN ({alive})"
    query(f"WITH {REVS}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ts DESC) AS nth FROM revs) SELECT collection, doc_id, ts, content_md FROM r WHERE {where}")(run)


_truncate("truncate_keep_3", 3)
_truncate("truncate_keep_0", 0)
_truncate("truncate_keep_all", -1)


@query(f"WITH {REVS} SELECT collection, doc_id, max(ts) AS ts, arg_max(content_md, ts) AS content_md FROM revs WHERE ts <= 1704067201 GROUP BY collection, doc_id")
def asof_read(spark, sf_dir):
    return merge.as_of(src.revisions(spark, sf_dir), src.T0 + 1).select("collection", "doc_id", "ts", "doc.content_md")


@query(f"WITH {REVS}, r AS (SELECT *, max(ts) OVER (PARTITION BY doc_id) AS newest FROM revs) SELECT doc_id, ts FROM r WHERE ts >= 1704067202 OR ts = newest")
def retention_by_age(spark, sf_dir):
    return merge.drop_older(src.revisions(spark, sf_dir), ["collection", "doc_id"], "ts", src.T0 + 2).select("doc_id", "ts")


@query(f"WITH {CHANGES}, r AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY ts DESC, seq DESC) AS nth FROM changes) SELECT entity, ts, seq, value FROM r WHERE nth = 1 AND op <> 'delete'")
def changelog_fold(spark, sf_dir):
    return merge.fold_changes(src.changes(spark, sf_dir), ["entity"]).select("entity", "ts", "seq", "value")


@query(f"WITH {CHANGES}, r AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY ts DESC, seq DESC) AS nth FROM changes WHERE ts <= 1705276800) SELECT entity, ts, seq, value FROM r WHERE nth = 1 AND op <> 'delete'")
def changelog_fold_asof(spark, sf_dir):
    return merge.fold_changes(src.changes(spark, sf_dir), ["entity"], F.col("ts") <= 1_705_276_800).select("entity", "ts", "seq", "value")


@query(f"WITH {CHANGES}, r AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY seq DESC) AS nth FROM changes WHERE value <> 'view' AND seq <= 5000) SELECT entity, seq AS txn_id, value FROM r WHERE nth = 1 AND op <> 'delete'")
def snapshot_isolation_read(spark, sf_dir):
    """Each key's newest visible version at a transaction, deletes included; views are not visible."""
    v = src.changes(spark, sf_dir).select("entity", F.col("seq").alias("txn_id"), "value", (F.col("op") == "delete").alias("deleted"), (F.col("value") != "view").alias("visible"))
    return merge.snapshot_read(v, "entity", 5000).select("entity", "txn_id", "value")


# statistics

_STATS = """t AS (SELECT collection, 0 AS k FROM corpus UNION ALL SELECT collection, 1 FROM revs UNION ALL SELECT collection, 2 FROM idx),
s AS (SELECT collection, count(*) FILTER (k = 0) AS document_count, count(*) FILTER (k = 1) AS revision_count, count(*) FILTER (k = 2) AS meta_index_count FROM t GROUP BY collection)"""


@query(f"WITH {IDX}, {REVS}, {_STATS} SELECT * FROM s")
def stats_by_collection(spark, sf_dir):
    docs = src.corpus(spark, sf_dir)
    return stats.collection_stats(docs, src.revisions(spark, sf_dir), build_index(docs))


@query(f"WITH {IDX}, {REVS}, {_STATS} SELECT count(*) AS collections, CAST(sum(document_count) AS BIGINT) AS total_document_count, CAST(sum(revision_count) AS BIGINT) AS total_revision_count, CAST(sum(meta_index_count) AS BIGINT) AS total_meta_index_count FROM s")
def stats_totals(spark, sf_dir):
    docs = src.corpus(spark, sf_dir)
    return stats.totals(stats.collection_stats(docs, src.revisions(spark, sf_dir), build_index(docs)))


@query("SELECT CASE WHEN b < 1024 THEN 'none' WHEN b < 10240 THEN 'snappy' ELSE 'zstd' END AS tier, count(*) AS documents, CAST(sum(b) AS BIGINT) AS bytes FROM (SELECT octet_length(encode(text)) AS b FROM documents) GROUP BY 1")
def compression_tier(spark, sf_dir):
    return stats.tiers(src.corpus(spark, sf_dir))


@query("""
WITH q AS (SELECT event_type AS collection, CAST(user_id AS VARCHAR) AS pattern, CAST(floor(epoch(ts)) AS BIGINT) AS t, event_id AS seq, CAST(floor(value) AS BIGINT) AS n, value / 20 AS ms FROM events),
p AS (SELECT collection, pattern, count(*) AS c, avg(ms) AS ms, arg_max(n, t * 1000000000 + n) AS n FROM q GROUP BY collection, pattern),
v AS (SELECT collection, CASE WHEN c < 10 OR ms >= 10 THEN 'hash' WHEN n = 0 THEN 'bloom' WHEN n = 1 THEN 'hash' WHEN n < 100 THEN 'btree' WHEN n < 10000 THEN 'bitmap' ELSE 'full' END AS index_type, count(*) AS votes FROM p GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY collection ORDER BY votes DESC, index_type) AS nth FROM v)
SELECT collection, index_type, votes FROM r WHERE nth = 1""")
def index_advisor(spark, sf_dir):
    e = src.table(spark, sf_dir, "events")
    log = e.select(F.col("event_type").alias("collection"), F.col("user_id").cast("string").alias("pattern"), F.unix_timestamp("ts").alias("ts"), F.floor("value").cast("long").alias("rows"), (F.col("value") / 20).alias("millis"))
    return stats.index_advice(log)


_FNV = "list_reduce(list_prepend(CAST(2166136261 AS BIGINT), list_transform(string_split({}, ''), lambda c: CAST(ord(c) AS BIGINT))), lambda a, b: (xor(a, b) * 16777619) & 4294967295)"


@query(f"""
WITH n AS (SELECT s, v, {_FNV.format("s || '-' || v")} AS h FROM range(4) AS a(s), range(150) AS b(v)),
ring AS (SELECT h, max(s) AS s FROM n GROUP BY h),
k AS (SELECT c_name AS key, {_FNV.format('c_name')} AS hash FROM customer)
SELECT key, hash, CAST(coalesce(r.s, (SELECT s FROM ring ORDER BY h LIMIT 1)) AS INTEGER) AS shard FROM k ASOF LEFT JOIN ring r ON k.hash <= r.h
""")
def shard_ring_assign(spark, sf_dir):
    found = vector.assign_shards(src.table(spark, sf_dir, "customer"), "c_name", {s: 1 for s in range(4)}, replicas=2)
    return found.select("key", "hash", F.col("shards")[0].alias("shard"))


@query(f"""
WITH n AS (SELECT s, v, {_FNV.format("s || '-' || v")} AS h FROM range(4) AS a(s), range(150) AS b(v)),
ring AS (SELECT h, max(s) AS s FROM n GROUP BY h),
k AS (SELECT c_name AS key, {_FNV.format('c_name')} AS hash FROM customer),
a AS (SELECT key, coalesce(r.s, (SELECT s FROM ring ORDER BY h LIMIT 1)) AS s FROM k ASOF LEFT JOIN ring r ON k.hash <= r.h)
SELECT CAST(g.s AS INTEGER) AS shard, count(a.key) AS owned FROM range(4) AS g(s) LEFT JOIN a ON a.s = g.s GROUP BY 1
""")
def shard_ring_stats(spark, sf_dir):
    found = vector.assign_shards(src.table(spark, sf_dir, "customer"), "c_name", {s: 1 for s in range(4)}, replicas=4)
    return vector.shard_stats(found).select("shard", "owned")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT user_id FROM events)")
def bloom_semi_join(spark, sf_dir):
    """Customers with events, others dropped by a Bloom filter before the join."""
    return membership.semi_join(src.table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey", src.table(spark, sf_dir, "events"), "user_id")


# whole-column operators


@query("SELECT l_orderkey, CAST(pos AS INTEGER) AS pos FROM (SELECT l_orderkey, x, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, x) - 1 AS pos FROM (SELECT l_orderkey, l_linenumber, l_returnflag AS x FROM lineitem)) WHERE x = 'R'")
def vec_compare(spark, sf_dir):
    items = src.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag"))).alias("xs"))
    return vector.positions_equal(items.select("l_orderkey", F.col("xs.l_returnflag").alias("flags")), "l_orderkey", "flags", "R")


@query("SELECT doc_id, (length(text) - length(replace(text, 'the', ''))) // 3 AS n FROM documents")
def vec_search(spark, sf_dir):
    return src.table(spark, sf_dir, "documents").select("doc_id", vector.count_occurrences("text", "the").alias("n"))


@query("SELECT CAST(sum(n_chars) AS BIGINT) AS total FROM documents")
def vec_sum(spark, sf_dir):
    return vector.total(src.table(spark, sf_dir, "documents"), "n_chars")


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 45 AND l_returnflag = 'R'")
def vec_filter(spark, sf_dir):
    return src.table(spark, sf_dir, "lineitem").where("l_quantity > 45 and l_returnflag = 'R'").select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT l_orderkey, l_linenumber, l_quantity * 2 + 1 AS y FROM lineitem")
def vec_map(spark, sf_dir):
    return src.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") * 2 + 1).alias("y"))


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS rank FROM orders")
def vec_sort(spark, sf_dir):
    return vector.sorted_with_rank(src.table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), F.col("o_totalprice"), F.col("o_orderkey")).select("o_orderkey", "rank")


def flagship(spark, sf_dir):
    """A page of a filtered, sorted collection."""
    return flat(Query("src3", FILTERS, "updatedAt", False, 20, 0).of(src.corpus(spark, sf_dir)))

