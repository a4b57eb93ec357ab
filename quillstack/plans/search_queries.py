"""Registered search queries (G1-G19) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstack.operators import search
from quillstack.operators.highlight import answer_fragments, highlights
from quillstack.operators.search_index import CELL, SearchIndex
from quillstack.operators.suggest import suggestions
from quillstack.session import read_documents, read_table, stored_once

FIELDS = ("text", "title")

WORDS = {"w1": "with that", "w2": "the ring of", "w3": "les des dans", "w4": "tion the tion"}
TITLE_WORDS = {"t1": "the of", "t2": "la de", "t3": "and"}
PATTERNS = {"p1": "thr*ing", "p2": "?nter", "p3": "*auou", "p4": "eau*eux", "p5": "The*"}
MISTYPED = {"f1": "wiht thaat", "f2": "tehre", "f3": "woth erinng"}
UNKNOWN = {"s1": "thatx whihc", "s2": "erestt lesz dansx", "s3": "with that"}


def documents(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_documents(spark, folder)
    return docs.withColumn("title", F.substring_index("text", "\n", 1))


def index(spark: SparkSession, folder: str) -> SearchIndex:
    """The index of a folder, built and stored at first use in this application."""
    docs = documents(spark, folder)
    return SearchIndex.open(
        spark, stored_once(spark, folder, "search-index", lambda p: SearchIndex.build(docs, "doc_id", FIELDS, p)))


def literal_queries(spark: SparkSession, texts: dict[str, str]) -> DataFrame:
    return spark.createDataFrame(list(texts.items()), "query_id string, query_text string")


def benchmark_queries(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "benchmark").select(
        F.col("item_id").cast("string").alias("query_id"), F.col("text").alias("query_text")
    )


def _hits(hits: DataFrame) -> DataFrame:
    return hits.select("query_id", "doc_id", "score", "rank")


def _searched(mode: str, texts: dict[str, str], fields, any_field: bool):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        matches = search.match(
            index(spark, folder), literal_queries(spark, texts), mode, fields, any_field
        )
        return _hits(search.top_hits(matches))

    return run


def _phrases(any_field: bool):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        matches = search.match_phrase(
            index(spark, folder), benchmark_queries(spark, folder), ("text",), any_field
        )
        return _hits(search.top_hits(matches))

    return run


def postings(spark, folder):
    """G1"""
    return _flat_postings(index(spark, folder))


def _flat_postings(index: SearchIndex) -> DataFrame:
    return index.postings(positions=True).select(
        "field", "term", "doc_id", "tf", F.col("len").cast("long").alias("len"),
        F.array_join(F.col("positions").cast("array<string>"), " ").alias("positions"),
    )


def grown_index(spark: SparkSession, folder: str) -> SearchIndex:
    """The documents in three additions, of which the second replaces older versions
    that the first brought, and then those marked toxic removed."""
    docs = documents(spark, folder)
    gone = read_table(spark, folder, "labels").filter(F.col("toxic") == 1).select("doc_id")
    second = F.coalesce(F.col("lang").isin("fr", "de"), F.lit(False))
    first = F.coalesce(F.col("lang") == "en", F.lit(False))
    older = docs.filter(second).withColumn("text", F.concat("title", F.lit(" older "), F.reverse("title")))

    def write(path):
        index = SearchIndex.build(docs.filter(first).unionByName(older), "doc_id", FIELDS, path)
        index = index.add(docs.filter(second)).add(docs.filter(~first & ~second))
        index.add(removed=gone)

    return SearchIndex.open(spark, stored_once(spark, folder, "grown-search-index", write))


def grown_postings(spark, folder):
    """Additions, replacements and removals"""
    return _flat_postings(grown_index(spark, folder))


def grown_hits(spark, folder):
    """Statistics of the grown index"""
    matches = search.match_normal(grown_index(spark, folder), literal_queries(spark, WORDS), FIELDS)
    return _hits(search.top_hits(matches))


def merged_postings(spark, folder):
    """G1: the grown index in one segment again"""
    def write(path):
        grown = grown_index(spark, folder)
        merged = SearchIndex.build(grown.docs.drop(CELL).limit(0), "doc_id", FIELDS, path).add(grown.docs.drop(CELL))
        merged.merge()

    return _flat_postings(SearchIndex.open(spark, stored_once(spark, folder, "merged-search-index", write)))


def best_hits(spark, folder):
    """G2, G14 by block bounds"""
    return _hits(search.best_normal(index(spark, folder), literal_queries(spark, WORDS), FIELDS).hits)


SOURCES = ["src1", "src2", "src3", "src5", "src8"]
SIZES = {"gte": 300, "lt": 6000}


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """Normal search with a filter, ten best per query."""
    idx = index(spark, folder)
    few = search.allowed(idx, search.terms_filter("source", SOURCES))
    matches = search.match_normal(idx, literal_queries(spark, WORDS), docs=few)
    return _hits(search.top_hits(matches))


def filters(spark, folder):
    """G10, G11, B4"""
    idx = index(spark, folder)
    request = search.SearchRequest(
        filters=(
            search.terms_filter("source", SOURCES),
            search.terms_filter("lang", ["en", "fr"]),
            search.range_filter("n_chars", **SIZES),
        ),
        columns=("lang", "source", "n_chars"),
    )
    return search.run(idx, literal_queries(spark, WORDS), request).hits


def date_range(spark, folder):
    """G11 with bare years"""
    orders = read_table(spark, folder, "orders")
    kept = orders.filter(search.range_filter("o_orderdate", gte="1995", lte="1996"))
    return kept.select(
        "o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("order_day")
    )


def sort(spark, folder):
    """G12"""
    idx = index(spark, folder)
    request = search.SearchRequest(sort_by=("-n_chars", "source"), columns=("n_chars", "source"))
    return search.run(idx, literal_queries(spark, WORDS), request).hits.drop("score")


def terms_aggregation(spark, folder):
    """G13"""
    idx = index(spark, folder)
    request = search.SearchRequest(count_by="source")
    return search.run(idx, literal_queries(spark, WORDS), request).counts


def total(spark, folder):
    """G17"""
    queries = literal_queries(spark, WORDS | {"w5": "absentword the"})
    return search.run(index(spark, folder), queries, search.SearchRequest()).total


def empty_query(spark, folder):
    """Only filter, sort and value counts apply."""
    idx = index(spark, folder)
    request = search.SearchRequest(
        filters=(search.terms_filter("lang", ["fr", "de"]),), sort_by=("lang", "-n_chars"), columns=("lang", "n_chars")
    )
    return search.run(idx, literal_queries(spark, {"all": ""}), request).hits


def empty_query_counts(spark, folder):
    """G19, G13"""
    idx = index(spark, folder)
    return search.value_counts(idx, search.match_all(idx, "all"), "lang").select(
        "query_id", "value", "n", "rank"
    )


def _fragments(spark, folder):
    idx = index(spark, folder)
    queries = literal_queries(spark, WORDS)
    hits = search.top_hits(search.match_normal(idx, queries))
    return highlights(idx, hits, search.query_words(queries))


def highlight(spark, folder):
    """G15"""
    return _fragments(spark, folder).select("query_id", "doc_id", "fragment_no", "fragment")


def fragments(spark, folder):
    """G18"""
    return answer_fragments(_fragments(spark, folder))


def suggest(spark, folder):
    """G16"""
    return suggestions(index(spark, folder), literal_queries(spark, UNKNOWN))


QUERIES = {
    "search_filtered_bm25": flagship,
    "search_postings": postings,
    "search_normal_any": _searched("normal", WORDS, FIELDS, True),
    "search_normal_all": _searched("normal", TITLE_WORDS, FIELDS, False),
    "search_phrase_any": _phrases(True),
    "search_phrase_all": _phrases(False),
    "search_wildcard_any": _searched("wildcard", PATTERNS, FIELDS, True),
    "search_wildcard_all": _searched("wildcard", PATTERNS, FIELDS, False),
    "search_fuzzy_any": _searched("fuzzy", MISTYPED, FIELDS, True),
    "search_fuzzy_all": _searched("fuzzy", MISTYPED, FIELDS, False),
    "search_filters": filters,
    "search_date_range": date_range,
    "search_sort": sort,
    "search_terms_agg": terms_aggregation,
    "search_total": total,
    "search_empty_query": empty_query,
    "search_empty_query_counts": empty_query_counts,
    "search_highlight": highlight,
    "search_fragments": fragments,
    "search_suggest": suggest,
    "search_grown_postings": grown_postings,
    "search_grown_hits": grown_hits,
    "search_merged_postings": merged_postings,
    "search_best_hits": best_hits,
}

# --- the same results in SQL -------------------------------------------------

WORD = r"[\p{L}\p{N}_]+(?:[''.’][\p{L}\p{N}_]+)*"
FIELD_LIST = "('text', 'title')"


def _values(texts: dict[str, str]) -> str:
    rows = ", ".join(f"('{k}', '{v}')" for k, v in texts.items())
    return f"(SELECT * FROM (VALUES {rows}) AS v(query_id, query_text))"


BENCHMARK = "(SELECT item_id::VARCHAR AS query_id, text AS query_text FROM benchmark)"

_INDEX = f"""
docs AS (SELECT *, split_part(text, chr(10), 1) AS title FROM documents),
analysed AS (
  SELECT doc_id, 'text' AS field, regexp_extract_all(lower(text), '{WORD}') AS terms FROM docs
  UNION ALL
  SELECT doc_id, 'title', regexp_extract_all(lower(title), '{WORD}') FROM docs),
tok AS (SELECT doc_id, field, len(terms) AS len, unnest(terms) AS term, generate_subscripts(terms, 1) - 1 AS at_ FROM analysed),
post AS (SELECT field, term, doc_id, count(*) AS tf, any_value(len) AS len,
  string_agg(at_::VARCHAR, ' ' ORDER BY at_) AS positions FROM tok GROUP BY field, term, doc_id),
words AS (SELECT field, term, count(*) AS df FROM post GROUP BY ALL),
stats AS (SELECT field, count(*) AS n, avg(len(terms)) AS al FROM analysed WHERE len(terms) > 0 GROUP BY 1),
known AS (SELECT field, term, df, al, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf
          FROM words JOIN stats USING (field))"""


def _query_ctes(queries: str) -> str:
    return f"""
q AS {queries},
qw AS (SELECT query_id, unnest(regexp_extract_all(lower(query_text), '{WORD}')) AS term FROM q),
qt AS (SELECT query_id, term, count(*) AS copies FROM qw GROUP BY ALL),
qn AS (SELECT query_id, count(*) AS n_terms FROM qt GROUP BY 1)"""


_BM25 = "idf * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len / al))"


def _normal(queries: str, fields: str, any_field: bool) -> str:
    return f"""WITH {_INDEX}, {_query_ctes(queries)},
per AS (SELECT query_id, doc_id, field, count(*) AS m, sum(copies * {_BM25}) AS score
        FROM post JOIN qt USING (term) JOIN known USING (field, term)
        WHERE field IN {fields} GROUP BY 1, 2, 3),
full_fields AS (SELECT per.* FROM per JOIN qn USING (query_id) WHERE m = n_terms),
{_matches(fields.count("'") // 2, any_field, best=True)}"""


def _matches(n_fields: int, any_field: bool, best: bool) -> str:
    total = "max" if any_field and best else "sum"
    having = "" if any_field else f" HAVING count(*) = {n_fields}"
    return f"""matches AS (SELECT query_id, doc_id, {total}(score) AS score
  FROM full_fields GROUP BY 1, 2{having})"""


_TOP = """, ranked AS (SELECT query_id, doc_id, round(score, 6) AS score,
  row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id)::INT AS rank FROM {src})
SELECT {cols} FROM ranked {join} WHERE rank <= 10"""


def _top(src: str = "matches", cols: str = "query_id, doc_id, score, rank", join: str = "") -> str:
    return _TOP.format(src=src, cols=cols, join=join)


def _phrase(fields: str, any_field: bool) -> str:
    """Words are fenced, so a phrase is a substring of the fenced field."""
    return f"""WITH {_INDEX},
q AS {BENCHMARK},
qp AS (SELECT query_id, regexp_extract_all(lower(query_text), '{WORD}') AS words FROM q),
qo AS (SELECT query_id, unnest(words) AS term FROM qp),
qi AS (SELECT query_id, field, sum(idf) AS idf, any_value(al) AS al
       FROM qo JOIN known USING (term) GROUP BY 1, 2),
fenced AS (SELECT doc_id, field, len(terms) AS len, '|' || array_to_string(terms, '||') || '|' AS s
           FROM analysed WHERE len(terms) > 0),
qf AS (SELECT query_id, '|' || array_to_string(words, '||') || '|' AS p FROM qp WHERE len(words) > 0),
found AS (SELECT query_id, doc_id, field, len, (length(s) - length(replace(s, p, ''))) // length(p) AS tf
          FROM fenced JOIN qf ON contains(s, p)),
full_fields AS (SELECT query_id, doc_id, field, {_BM25} AS score
                FROM found JOIN qi USING (query_id, field) WHERE field IN {fields}),
{_matches(fields.count("'") // 2, any_field, best=False)}{_top()}"""


def _wildcard(any_field: bool) -> str:
    return f"""WITH {_INDEX},
q AS {_values(PATTERNS)},
expanded AS (SELECT query_id, field, term FROM words JOIN q
  ON regexp_full_match(term, replace(replace(query_text, '*', '.*'), '?', '.'))),
full_fields AS (SELECT DISTINCT query_id, doc_id, field, 1.0::DOUBLE AS score
                FROM post JOIN expanded USING (field, term)),
{_matches(2, any_field, best=False)}{_top()}"""


def _fuzzy(any_field: bool) -> str:
    return f"""WITH {_INDEX}, {_query_ctes(_values(MISTYPED))},
asked AS (SELECT DISTINCT term AS asked,
  CASE WHEN length(term) <= 2 THEN 0 WHEN length(term) <= 5 THEN 1 ELSE 2 END AS k FROM qt),
near AS (SELECT field, asked, term, damerau_levenshtein(asked, term) AS d
  FROM words JOIN asked ON abs(length(term) - length(asked)) <= k
  WHERE damerau_levenshtein(asked, term) <= k),
parts AS (SELECT query_id, doc_id, field, asked,
    max(copies * (1 - d::DOUBLE / least(length(asked), length(post.term))) * {_BM25}) AS part
  FROM post JOIN near USING (field, term) JOIN known USING (field, term)
  JOIN qt ON qt.term = asked GROUP BY 1, 2, 3, 4),
per AS (SELECT query_id, doc_id, field, count(*) AS m, sum(part) AS score FROM parts GROUP BY 1, 2, 3),
full_fields AS (SELECT per.* FROM per JOIN qn USING (query_id) WHERE m = n_terms),
{_matches(2, any_field, best=True)}{_top()}"""


_SOURCES = "(" + ", ".join(f"'{s}'" for s in SOURCES) + ")"
_TEXT = "('text')"
_NORMAL = _normal(_values(WORDS), _TEXT, True)

_HIGHLIGHT = _NORMAL + r""", hits AS (SELECT * FROM (SELECT query_id, doc_id,
  row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM matches)
  WHERE rank <= 10),
pieces AS (SELECT query_id, doc_id, rank, unnest(ps) AS piece, generate_subscripts(ps, 1) AS i
  FROM (SELECT query_id, doc_id, rank,
    regexp_extract_all(text, '%s|[^\p{L}\p{N}_]+') AS ps FROM hits JOIN docs USING (doc_id))),
placed AS (SELECT *, sum(length(piece)) OVER w - length(piece) AS start,
    coalesce(lead(piece) OVER w, '') AS gap FROM pieces
  WINDOW w AS (PARTITION BY query_id, doc_id ORDER BY i)),
checked AS (SELECT p.*, (p.start // 50) AS cell, qt.term IS NOT NULL AS marked, lower(piece) AS term
  FROM placed p LEFT JOIN qt ON qt.query_id = p.query_id AND qt.term = lower(p.piece)
  WHERE regexp_matches(piece, '^[\p{L}\p{N}_]')),
shown AS (SELECT *, CASE WHEN marked THEN '**' || piece || '**' ELSE piece END AS word,
    row_number() OVER (PARTITION BY query_id, doc_id, cell ORDER BY start DESC) AS from_end FROM checked),
cells AS (SELECT query_id, doc_id, rank, cell,
    string_agg(word || CASE WHEN from_end > 1 THEN gap ELSE '' END, '' ORDER BY start) AS fragment,
    count(DISTINCT CASE WHEN marked THEN term END) AS n_terms, sum(marked::INT) AS n_marked
  FROM shown GROUP BY 1, 2, 3, 4 HAVING sum(marked::INT) > 0),
frags AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id
    ORDER BY n_terms DESC, n_marked DESC, cell)::INT AS fragment_no FROM cells)
""" % WORD

SQL = {
    "search_filtered_bm25": _NORMAL
    + f""", kept AS (SELECT matches.* FROM matches JOIN docs USING (doc_id) WHERE source IN {_SOURCES})"""
    + _top("kept"),
    "search_postings": f"WITH {_INDEX} SELECT field, term, doc_id, tf, len, positions FROM post",
    "search_normal_any": _normal(_values(WORDS), FIELD_LIST, True) + _top(),
    "search_normal_all": _normal(_values(TITLE_WORDS), FIELD_LIST, False) + _top(),
    "search_phrase_any": _phrase(FIELD_LIST, True),
    "search_phrase_all": _phrase(_TEXT, False),
    "search_wildcard_any": _wildcard(True),
    "search_wildcard_all": _wildcard(False),
    "search_fuzzy_any": _fuzzy(True),
    "search_fuzzy_all": _fuzzy(False),
    "search_filters": _NORMAL
    + f""", kept AS (SELECT matches.* FROM matches JOIN docs USING (doc_id)
  WHERE source IN {_SOURCES} AND lang IN ('en', 'fr') AND n_chars >= 300 AND n_chars < 6000)"""
    + _top("kept", "query_id, doc_id, score, rank, lang, source, n_chars", "JOIN docs USING (doc_id)"),
    "search_date_range": """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS order_day FROM orders
WHERE o_orderdate::DATE >= DATE '1995-01-01' AND o_orderdate::DATE <= DATE '1996-12-31'""",
    "search_sort": _NORMAL
    + """ SELECT query_id, doc_id, n_chars, source, rank FROM (
  SELECT query_id, doc_id, n_chars, source, row_number() OVER (PARTITION BY query_id
    ORDER BY n_chars DESC NULLS LAST, source, doc_id)::INT AS rank FROM matches JOIN docs USING (doc_id))
WHERE rank <= 10""",
    "search_terms_agg": _NORMAL
    + """, counts AS (SELECT query_id, source AS value, count(*) AS n
    FROM matches JOIN docs USING (doc_id) GROUP BY 1, 2)
SELECT query_id, value, n, rank FROM (SELECT *, row_number() OVER (
  PARTITION BY query_id ORDER BY n DESC, value)::INT AS rank FROM counts) WHERE rank <= 10""",
    "search_total": _normal(_values(WORDS | {"w5": "absentword the"}), _TEXT, True)
    + """ SELECT query_id, count(doc_id) AS total FROM q LEFT JOIN matches USING (query_id) GROUP BY 1""",
    "search_empty_query": """SELECT 'all' AS query_id, doc_id, 1.0::DOUBLE AS score, lang, n_chars, rank FROM (
  SELECT *, row_number() OVER (ORDER BY lang, n_chars DESC, doc_id)::INT AS rank
  FROM documents WHERE lang IN ('fr', 'de')) WHERE rank <= 10""",
    "search_empty_query_counts": """SELECT 'all' AS query_id, lang AS value, count(*) AS n,
  row_number() OVER (ORDER BY count(*) DESC, lang)::INT AS rank FROM documents GROUP BY lang
  QUALIFY rank <= 10""",
    "search_highlight": _HIGHLIGHT
    + "SELECT query_id, doc_id, fragment_no, fragment FROM frags WHERE fragment_no <= 5",
    "search_fragments": _HIGHLIGHT
    + """SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rank, fragment_no)::INT AS place,
  fragment FROM frags WHERE fragment_no <= 5""",
    "search_suggest": f"""WITH {_INDEX}, {_query_ctes(_values(UNKNOWN))},
vocab AS (SELECT term, df FROM words WHERE field = 'text'),
unknown AS (SELECT query_id, term AS asked FROM qt WHERE length(term) >= 4
  AND term NOT IN (SELECT term FROM vocab)),
near AS (SELECT asked, term, df,
    1 - damerau_levenshtein(asked, term)::DOUBLE / least(length(asked), length(term)) AS sim
  FROM (SELECT DISTINCT asked FROM unknown) JOIN vocab
    ON abs(length(asked) - length(term)) <= 2 AND asked[1] = term[1]
  WHERE damerau_levenshtein(asked, term) <= 2),
best AS (SELECT *, row_number() OVER (PARTITION BY asked ORDER BY round(sim, 6) DESC, df DESC, term)::INT AS rank
  FROM near WHERE sim >= 0.5)
SELECT query_id, asked, rank, term, df FROM unknown JOIN best USING (asked) WHERE rank <= 5""",
}

# An index that grew and one merged from it are those of the documents that are left.
_GROWN = ("FROM documents)", "FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1))")
SQL["search_grown_postings"] = SQL["search_merged_postings"] = SQL["search_postings"].replace(*_GROWN)
SQL["search_grown_hits"] = SQL["search_normal_any"].replace(*_GROWN)
SQL["search_best_hits"] = SQL["search_normal_any"]


def normal_text_sql() -> str:
    """G2 over the text alone: the ten best of WORDS."""
    return _NORMAL + _top()
