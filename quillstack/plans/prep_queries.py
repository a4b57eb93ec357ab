"""Registered preparation queries (B1-B14) and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstack.operators import prep
from quillstack.session import materialise, read_table


def _labelled(spark, folder):
    docs = read_table(spark, folder, "documents")
    return docs.join(read_table(spark, folder, "labels"), "doc_id", "left")


def _split(spark, folder):
    return prep.stratified_split(read_table(spark, folder, "documents"), "lang", "doc_id")


def _split_docs(spark, folder):
    return read_table(spark, folder, "documents").join(
        _split(spark, folder).select("doc_id", "split"), "doc_id"
    )


def prep_filter(spark, folder):
    """B1"""
    return prep.usable(_labelled(spark, folder), "quality").select("doc_id", "quality", "toxic")


def drop_rare(spark, folder):
    """B2"""
    orders = read_table(spark, folder, "orders")
    return prep.drop_rare_labels(orders, "o_custkey", "o_orderkey", min_docs=8).select(
        "o_orderkey", "o_custkey"
    )


def fill_sentinels(spark, folder):
    """B3"""
    customers = read_table(spark, folder, "customer")
    orders = read_table(spark, folder, "orders").withColumnRenamed("o_custkey", "c_custkey")
    joined = customers.join(orders, "c_custkey", "left")
    filled = prep.fill_sentinels(
        joined.withColumn("day", F.to_date("o_orderdate")),
        {"o_orderkey": -1, "o_orderpriority": "None", "day": "1900-01-01"},
    )
    return filled.select(
        "c_custkey", "o_orderkey", "o_orderpriority", F.col("day").cast("string").alias("day")
    )


def fill_labels(spark, folder):
    """B3"""
    filled = prep.fill_sentinels(_labelled(spark, folder), {"quality": -1, "toxic": -1})
    return filled.select(
        "doc_id", F.col("quality").cast("int").alias("quality"), F.col("toxic").cast("int").alias("toxic")
    )


def project_fields(spark, folder):
    """B4"""
    return prep.result_fields(read_table(spark, folder, "documents"), ("doc_id", "lang", "source", "n_chars"))


def dense_number(spark, folder):
    """B5"""
    numbered = prep.dense_numbers(read_table(spark, folder, "labels"), "doc_id")
    return numbered.select("doc_id", "doc_num", "file_name")


def join_meta(spark, folder):
    """B6"""
    docs = read_table(spark, folder, "documents").select("doc_id", "source", "n_chars")
    return prep.with_metadata(docs, read_table(spark, folder, "labels")).select(
        "doc_id", "source", "n_chars", F.col("quality").cast("int"), F.col("toxic").cast("int")
    )


def label_decode(spark, folder):
    """B7"""
    names = read_table(spark, folder, "nation").select(
        F.col("n_nationkey").alias("code"), F.col("n_name").alias("name")
    )
    customers = read_table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    return prep.decode_label(customers, names, "c_nationkey", "nation", "c_custkey").select(
        "c_custkey", "nation"
    )


def stratified_split(spark, folder):
    """B8"""
    return _split(spark, folder)


def stratified_split_parts(spark, folder):
    """B8 with many labels"""
    return prep.stratified_split(read_table(spark, folder, "part"), "p_brand", "p_partkey")


def split_balance(spark, folder):
    """B9"""
    docs = _split_docs(spark, folder).withColumn("title", F.substring_index("text", "\n", 1))
    balance = prep.split_balance(docs, "lang", "title")
    return balance.select(
        "lang", *[F.round(c, 6).alias(c) for c in ("all_pct", "train_pct", "test_pct")], "balanced"
    )


def completeness(spark, folder):
    """B10"""
    return prep.completeness(read_table(spark, folder, "documents"), _split(spark, folder), "doc_id")


LOOKED_UP = 17


def doc_lookup(spark, folder):
    """B11 on a stored snapshot"""
    stored = materialise(_split_docs(spark, folder).drop("text"), "split")
    sides = [prep.document_metadata(stored, "doc_id", LOOKED_UP, s) for s in ("train", "test")]
    return sides[0].unionByName(sides[1]).select("doc_id", "lang", "source", "n_chars", "split")


def split_metadata(spark, folder):
    """B12"""
    return prep.split_part(_split_docs(spark, folder), "test", ("doc_id", "lang", "source"))


def corpus_facts(spark, folder):
    """B13"""
    facts = prep.corpus_facts(read_table(spark, folder, "orders"), "o_orderpriority", "o_orderdate")
    return facts.select(
        F.array_join("categories", "|").alias("categories"),
        F.date_format("first_date", "yyyy-MM-dd").alias("first_date"),
        F.date_format("last_date", "yyyy-MM-dd").alias("last_date"),
    )


def sample_docs(spark, folder):
    """B14"""
    return prep.sample_documents(read_table(spark, folder, "documents"), "doc_id", 10).select(
        "doc_id", "lang"
    )


QUERIES = {
    f.__name__: f
    for f in (
        prep_filter, drop_rare, fill_sentinels, fill_labels, project_fields, dense_number,
        join_meta, label_decode, stratified_split, stratified_split_parts, split_balance,
        completeness, doc_lookup, split_metadata, corpus_facts, sample_docs,
    )
}

# --- the same results in SQL -------------------------------------------------


def split_sql(table: str, label: str, key: str) -> str:
    return f"""per_label AS (SELECT {label} AS label, count(*) AS n FROM {table} GROUP BY 1),
tot AS (SELECT sum(n)::BIGINT AS total, ceil(sum(n)::DECIMAL(18, 0) * 0.2)::BIGINT AS n_test FROM per_label),
shares AS (SELECT label, n * n_test // total AS base, n * n_test % total AS rest, n_test FROM per_label, tot),
quotas AS (SELECT label, base + (row_number() OVER (ORDER BY rest DESC, label)
  <= n_test - sum(base) OVER ())::INT AS quota FROM shares),
ranked AS (SELECT {key}, {label}, row_number() OVER (PARTITION BY {label}
  ORDER BY md5({key}::VARCHAR || '-42'), {key}) AS place FROM {table}),
split AS (SELECT {key}, {label}, CASE WHEN place <= quota THEN 'test' ELSE 'train' END AS split
  FROM ranked JOIN quotas ON label = {label})"""


_SPLIT = "WITH " + split_sql("documents", "lang", "doc_id")

SQL = {
    "prep_filter": """SELECT doc_id, quality, toxic FROM documents JOIN labels USING (doc_id)
  WHERE quality IS NOT NULL AND text <> ''""",
    "drop_rare": """SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (
  SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) >= 8)""",
    "fill_sentinels": """SELECT c_custkey, coalesce(o_orderkey, -1) AS o_orderkey,
  coalesce(o_orderpriority, 'None') AS o_orderpriority,
  strftime(coalesce(o_orderdate::DATE, DATE '1900-01-01'), '%Y-%m-%d') AS day
  FROM customer LEFT JOIN orders ON o_custkey = c_custkey""",
    "fill_labels": """SELECT doc_id, coalesce(quality, -1)::INT AS quality, coalesce(toxic, -1)::INT AS toxic
  FROM documents LEFT JOIN labels USING (doc_id)""",
    "project_fields": "SELECT doc_id, lang, source, n_chars FROM documents",
    "dense_number": """SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS doc_num,
  lpad(n::VARCHAR, greatest(6, length(n::VARCHAR))::INT, '0') AS file_name
FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS n FROM labels)""",
    "join_meta": """SELECT doc_id, source, n_chars, quality::INT AS quality, toxic::INT AS toxic
  FROM documents JOIN labels USING (doc_id)""",
    "label_decode": """SELECT c_custkey, n_name AS nation FROM customer
  LEFT JOIN nation ON n_nationkey = c_nationkey""",
    "stratified_split": _SPLIT + " SELECT * FROM split",
    "stratified_split_parts": "WITH " + split_sql("part", "p_brand", "p_partkey") + " SELECT * FROM split",
    "split_balance": _SPLIT
    + """, named AS (SELECT split.*, split_part(text, chr(10), 1) AS title
    FROM split JOIN documents USING (doc_id)),
counts AS (SELECT lang, count(DISTINCT title) AS a,
    count(DISTINCT CASE WHEN split = 'train' THEN title END) AS tr,
    count(DISTINCT CASE WHEN split = 'test' THEN title END) AS te FROM named GROUP BY 1),
percents AS (SELECT lang, a * 100.0::DOUBLE / sum(a) OVER () AS pa, tr * 100.0::DOUBLE / sum(tr) OVER () AS ptr,
    te * 100.0::DOUBLE / sum(te) OVER () AS pte FROM counts)
SELECT lang, round(pa, 6) AS all_pct, round(ptr, 6) AS train_pct, round(pte, 6) AS test_pct,
  abs(pa - ptr) <= 0.25 + 0.1 * ptr AND abs(pa - pte) <= 0.25 + 0.1 * pte AS balanced FROM percents""",
    "completeness": _SPLIT
    + """ SELECT count(d.doc_id) AS n_corpus, count(*) FILTER (split = 'train') AS n_train,
  count(*) FILTER (split = 'test') AS n_test, count(*) FILTER (split IS NULL) AS n_missing,
  count(d.doc_id) = count(*) FILTER (split IN ('train', 'test'))
    AND count(*) FILTER (split IS NULL) = 0 AS complete
FROM documents d FULL JOIN split s ON d.doc_id = s.doc_id""",
    "doc_lookup": _SPLIT
    + f""" SELECT doc_id, d.lang, source, n_chars, split FROM documents d JOIN split USING (doc_id)
  WHERE doc_id = {LOOKED_UP}""",
    "split_metadata": _SPLIT
    + """ SELECT doc_id, d.lang, source FROM documents d JOIN split USING (doc_id) WHERE split = 'test'""",
    "corpus_facts": """SELECT string_agg(DISTINCT o_orderpriority, '|' ORDER BY o_orderpriority) AS categories,
  strftime(min(o_orderdate), '%Y-%m-%d') AS first_date, strftime(max(o_orderdate), '%Y-%m-%d') AS last_date
  FROM orders""",
    "sample_docs": """SELECT doc_id, lang FROM documents
  ORDER BY md5(doc_id::VARCHAR || '-42'), doc_id LIMIT 10""",
}
