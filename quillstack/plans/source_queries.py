"""Registered source and table queries (A1-A11) and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstack.operators import prep
from quillstack.plans.prep_queries import split_sql
from quillstack.sources import corpus, files, search_log, tables
from quillstack.session import new_path, read_documents, read_table

PREFIX = "https://m."
PAGE_SIZE = 20


def text_files(spark, folder):
    """A1: one file per document, written and read back; writing ends each file with a line break."""
    path = new_path(spark, "texts")
    docs = read_documents(spark, folder)
    name = F.concat(F.lit("doc="), F.coalesce(prep.zero_padded(F.col("doc_id")), F.lit("none")))
    corpus.write_text_files(docs.select("text", name.alias("name")), path)
    return corpus.read_text_files(spark, path, r"/doc=([0-9]+)-", recursive=True)


def metadata_csv(spark, folder):
    """A2, A4"""
    path = new_path(spark, "meta")
    docs = read_table(spark, folder, "documents")
    title = F.substring_index("text", "\n", 1).alias("case_name")
    meta = docs.select("doc_id", "lang", "source", "n_chars", title)
    corpus.write_metadata(meta, path)
    return corpus.read_metadata(spark, path, meta.schema)


def code_names(spark, folder):
    """A3: the info file holds one map per dictionary, keys as strings."""
    path = new_path(spark, "info")
    nation = read_table(spark, folder, "nation")
    entries = F.collect_list(F.struct(F.col("n_nationkey").cast("string"), F.col("n_name")))
    info = nation.agg(F.map_from_entries(entries).alias("issue_area_codes"))
    info.select(F.to_json(F.struct("issue_area_codes")).alias("value")).write.text(path)
    return corpus.read_code_names(spark, path, "issue_area_codes")


def snapshot_roundtrip(spark, folder):
    """A4"""
    path = new_path(spark, "snapshot")
    docs = read_table(spark, folder, "documents")
    split = prep.stratified_split(docs, "lang", "doc_id").select("doc_id", "split")
    tables.write_snapshot(docs.join(split, "doc_id"), path)
    return tables.read_snapshot(spark, path).select("doc_id", "text", "lang", "source", "split")


def stored_pages(spark, folder):
    pages = read_table(spark, folder, "pages")
    return pages.select(
        F.col("url").alias("key"),
        F.timestamp_seconds(F.col("page_id") * 60).alias("last_modified"),
        F.octet_length("html").cast("long").alias("size"),
        F.col("html").cast("binary").alias("content"),
    )


def _listing(page):
    return page.select("key", F.unix_seconds("last_modified").alias("last_modified"), "size")


def list_files(spark, folder):
    """A5: all files under a prefix"""
    return _listing(files.list_files(stored_pages(spark, folder), PREFIX))


def list_files_page(spark, folder):
    """A5: the second page, empty where the first was the last"""
    stored = stored_pages(spark, folder)
    _, token = files.list_page(stored, PREFIX, PAGE_SIZE)
    return _listing(files.list_page(stored, PREFIX, PAGE_SIZE, token)[0])


def list_files_token(spark, folder):
    """A5: the first page with the token for the next"""
    page, token = files.list_page(stored_pages(spark, folder), PREFIX, PAGE_SIZE)
    return _listing(page).withColumn("next_token", F.lit(token).cast("string"))


def bulk_load(spark, folder):
    """A6"""
    return files.load_files(stored_pages(spark, folder), PREFIX)


def turns(spark, folder):
    """Conversations as files, turns as their versions."""
    rows = read_table(spark, folder, "conversations")
    return rows.select(
        F.col("conv_id").cast("string").alias("key"),
        F.format_string("v%03d", "turn").alias("version_id"),
        F.timestamp_seconds(F.col("turn") * 60).alias("last_modified"),
        F.octet_length("text").cast("long").alias("size"),
        F.lit(False).alias("deleted"),
        F.col("text").cast("binary").alias("content"),
    )


def _delete_requests(versions):
    """Keys with more than four versions as a whole; elsewhere the newest version."""
    per_key = versions.groupBy("key").agg(
        F.count("*").alias("n"), F.max_by("version_id", "last_modified").alias("last"))
    return per_key.select("key", F.when(F.col("n") <= 4, F.col("last")).alias("version_id"))


def _deleted(spark, folder):
    versions = turns(spark, folder)
    when = F.timestamp_seconds(F.lit(10_000_000))
    return files.delete_files(versions, _delete_requests(versions), when)


def versions_latest(spark, folder):
    """A7"""
    listed = turns(spark, folder).select("key", "version_id", "last_modified", "size")
    return files.latest_versions(listed).select("key", "version_id", "size")


def versions_upload(spark, folder):
    """Benchmark items uploaded as new versions of the conversations of that number"""
    old = turns(spark, folder)
    items = read_table(spark, folder, "benchmark")
    new = items.select(
        F.col("item_id").cast("string").alias("key"),
        F.lit("upload").alias("version_id"),
        F.timestamp_seconds(F.lit(9_000_000)).alias("last_modified"),
        F.octet_length("text").cast("long").alias("size"),
        F.lit(False).alias("deleted"),
        F.col("text").cast("binary").alias("content"),
    )
    listed = files.list_versions(files.add_versions(old, new))
    return listed.select("key", "version_id", "is_latest", "size")


def versions_list(spark, folder):
    """A7"""
    return files.list_versions(turns(spark, folder)).select("key", "version_id", "is_latest", "size")


def version_read(spark, folder):
    """After the deletions, every key without and with its first version"""
    versions = _deleted(spark, folder)
    keys = turns(spark, folder).select("key").distinct()
    plain = keys.withColumn("version_id", F.lit(None).cast("string"))
    first = keys.withColumn("version_id", F.lit("v000"))
    answers = files.read_files(versions, plain.unionByName(first))
    return answers.select(
        "key",
        F.coalesce("version_id", F.lit("")).alias("version_id"),
        "status",
        F.coalesce("text", F.lit("")).alias("text"),
    )


def version_delete(spark, folder):
    """A7"""
    return files.list_versions(_deleted(spark, folder)).select("key", "version_id", "is_latest")


def corpus_table(spark, folder):
    """Create, keep an existing table, then replace it"""
    path = new_path(spark, "corpus")
    docs = read_table(spark, folder, "documents").withColumn("case_name", F.substring_index("text", "\n", 1))
    tables.set_up_table(docs.limit(0), path)
    tables.set_up_table(docs, path, "ignore")
    stored = tables.set_up_table(docs, path, "overwrite")
    return stored.select("doc_id", "case_name", "text", F.col("topics").isNull().alias("no_topics"))


def upsert(spark, folder):
    """A9"""
    table = read_table(spark, folder, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    updates = read_table(spark, folder, "orders").select(
        F.col("o_custkey").alias("c_custkey"),
        F.col("o_totalprice").alias("c_acctbal"),
        F.col("o_orderpriority").alias("c_mktsegment"),
        "o_orderkey",
    )
    return tables.upsert(table, updates, "c_custkey", "o_orderkey")


def insert_only(spark, folder):
    """A10"""
    table = read_table(spark, folder, "labels").select("doc_id")
    stored, rejected = tables.insert_only(
        table, read_table(spark, folder, "documents").select("doc_id"), "doc_id"
    )
    return stored.withColumn("status", F.lit("stored")).unionByName(
        rejected.withColumn("status", F.lit("rejected"))
    )


def _searches(spark, folder):
    events = read_table(spark, folder, "events")
    return events.select(
        F.col("ts").cast(T.TimestampType()).alias("search_time"),
        F.concat_ws(" ", "event_type", F.col("user_id").cast("string")).alias("search_text"),
    )


def search_history(spark, folder):
    """A11"""
    path = new_path(spark, "log")
    search_log.append_searches(_searches(spark, folder), path)
    log = search_log.search_texts(search_log.read_searches(spark, path))
    return log.select(F.unix_micros("search_time").alias("search_time"), "search_text")


QUERIES = {
    f.__name__: f
    for f in (
        text_files, metadata_csv, code_names, snapshot_roundtrip, list_files, list_files_page,
        list_files_token, bulk_load, versions_latest, versions_list, versions_upload, version_read, version_delete, corpus_table,
        upsert, insert_only, search_history,
    )
}

# --- the same results in SQL -------------------------------------------------

_TURNS = """t AS (SELECT conv_id::VARCHAR AS key,
  'v' || lpad(turn::VARCHAR, greatest(3, length(turn::VARCHAR))::INT, '0') AS version_id,
  turn, strlen(text) AS size, text FROM conversations),
k AS (SELECT key, count(*) AS n, arg_max(version_id, turn) AS last FROM t GROUP BY 1),
kept AS (SELECT t.*, n FROM t JOIN k USING (key) WHERE n > 4 OR version_id <> last),
alive AS (SELECT *, n <= 4 AND turn = max(turn) OVER (PARTITION BY key) AS is_latest FROM kept)"""

SQL = {
    "text_files": "SELECT doc_id, text || chr(10) AS text FROM documents",
    "metadata_csv": """SELECT doc_id, lang, source, n_chars, split_part(text, chr(10), 1) AS case_name
  FROM documents""",
    "code_names": "SELECT n_nationkey AS code, n_name AS name FROM nation",
    "snapshot_roundtrip": "WITH "
    + split_sql("documents", "lang", "doc_id")
    + " SELECT doc_id, text, d.lang, source, split FROM documents d JOIN split USING (doc_id)",
    "list_files": f"""SELECT url AS key, page_id * 60 AS last_modified, strlen(html) AS size
  FROM pages WHERE starts_with(url, '{PREFIX}')""",
    "list_files_page": f"""SELECT url AS key, page_id * 60 AS last_modified, strlen(html) AS size
  FROM pages WHERE starts_with(url, '{PREFIX}') ORDER BY url LIMIT {PAGE_SIZE} OFFSET {PAGE_SIZE}""",
    "list_files_token": f"""WITH p AS (SELECT url AS key, page_id * 60 AS last_modified, strlen(html) AS size,
    row_number() OVER (ORDER BY url) AS n FROM pages WHERE starts_with(url, '{PREFIX}'))
SELECT key, last_modified, size, CASE WHEN (SELECT count(*) FROM p) > {PAGE_SIZE}
    THEN (SELECT key FROM p WHERE n = {PAGE_SIZE}) END AS next_token FROM p WHERE n <= {PAGE_SIZE}""",
    "bulk_load": f"SELECT url AS key, html AS text FROM pages WHERE starts_with(url, '{PREFIX}')",
    "versions_latest": f"""WITH {_TURNS} SELECT t.key, version_id, size FROM t JOIN k ON t.key = k.key
  AND version_id = last""",
    "versions_list": f"""WITH {_TURNS} SELECT t.key, version_id, version_id = last AS is_latest, size
  FROM t JOIN k ON t.key = k.key""",
    "versions_upload": f"""WITH {_TURNS}, b AS (SELECT item_id::VARCHAR AS key, strlen(text) AS size FROM benchmark)
SELECT t.key, version_id, version_id = last AND b.key IS NULL AS is_latest, t.size
  FROM t JOIN k ON t.key = k.key LEFT JOIN b ON b.key = t.key
UNION ALL SELECT key, 'upload', true, size FROM b""",
    "version_read": f"""WITH {_TURNS}
SELECT k.key, coalesce(version_id, '') AS version_id,
  CASE WHEN version_id IS NULL THEN 'missing' ELSE 'ok' END AS status, coalesce(text, '') AS text
FROM k LEFT JOIN alive ON alive.key = k.key AND is_latest
UNION ALL
SELECT k.key, 'v000', CASE WHEN text IS NULL THEN 'missing' ELSE 'ok' END, coalesce(text, '')
FROM k LEFT JOIN kept ON kept.key = k.key AND version_id = 'v000'""",
    "version_delete": f"WITH {_TURNS} SELECT key, version_id, is_latest FROM alive",
    "corpus_table": """SELECT doc_id, split_part(text, chr(10), 1) AS case_name, text, true AS no_topics
  FROM documents""",
    "upsert": """SELECT c_custkey, o_totalprice AS c_acctbal, o_orderpriority AS c_mktsegment FROM (
  SELECT o_custkey AS c_custkey, * FROM orders QUALIFY row_number() OVER (
    PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1)
UNION ALL SELECT c_custkey, c_acctbal, c_mktsegment FROM customer
  WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""",
    "insert_only": """SELECT doc_id, 'stored' AS status FROM documents
UNION ALL SELECT doc_id, 'rejected' FROM labels""",
    "search_history": """SELECT epoch_us(ts) AS search_time, event_type || ' ' || user_id AS search_text FROM events""",
}
