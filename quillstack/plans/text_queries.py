"""Registered text and feature queries (C1-C13, D1-D5) and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstack.functions import text as tx
from quillstack.functions.tokens import model_tokens, word_ngrams
from quillstack.operators import features
from quillstack.session import materialise, read_documents, read_table


def _on_documents(column, out: str = "result"):
    def run(spark, folder):
        return read_documents(spark, folder).select("doc_id", column(F.col("text")).alias(out))

    return run


def _on_pages(column):
    def run(spark, folder):
        return read_table(spark, folder, "pages").select("page_id", column(F.col("html")).alias("result"))

    return run


def _halves(spark, folder):
    """C12"""
    t = F.col("text")
    return read_documents(spark, folder).select(
        "doc_id", tx.first_half(t).alias("first_half"), tx.second_half(t).alias("second_half")
    )


def _decode(spark, folder):
    """C13 on Latin-1 bytes: every accented letter is an invalid UTF-8 byte."""
    docs = read_documents(spark, folder)
    return docs.select("doc_id", tx.decode_utf8(F.encode("text", "ISO-8859-1")).alias("result"))


def _together(spark, folder, together):
    docs = read_documents(spark, folder).select("doc_id", "text")
    return features.by_key(docs, "doc_id") if together else docs


def topic_words(spark, folder, together=False):
    words = model_tokens(F.col("text"))
    return _together(spark, folder, together).select("doc_id", words.alias("tokens"))


def _term_counts(spark, folder):
    """D1"""
    return features.term_counts(topic_words(spark, folder), "doc_id", F.col("tokens"))


def _ngrams(spark, folder):
    """D2"""
    words = model_tokens(F.col("text"), lowercase=False)
    docs = read_documents(spark, folder).select("doc_id", words.alias("words"))
    grams = docs.select("doc_id", F.explode_outer(word_ngrams("words")).alias("gram"))
    return grams.filter(F.col("gram").isNotNull())


def classifier_grams(spark, folder, together=False):
    words = model_tokens(F.col("text"), lowercase=False)
    docs = _together(spark, folder, together).select("doc_id", words.alias("words"))
    return docs.select("doc_id", word_ngrams("words").alias("tokens"))


def _vocabulary(tokenised, bounds):
    def run(spark, folder):
        docs = tokenised(spark, folder)
        totals = features.term_totals(docs, F.col("tokens"))
        return features.vocabulary(totals, docs.count(), **bounds)

    return run


def _tfidf(tokenised, bounds, sublinear):
    def run(spark, folder):
        docs = tokenised(spark, folder, together=True)
        n_docs = read_documents(spark, folder).count()
        counts = features.term_counts(docs, "doc_id", F.col("tokens"))
        found = features.vocabulary(features.document_frequencies(counts), n_docs, **bounds)
        vocab = materialise(found, "vocabulary")
        counts = features.term_counts(docs, "doc_id", F.col("tokens"), vocab)
        weights = features.tfidf(counts, vocab, n_docs, "doc_id", sublinear)
        return weights.select("doc_id", "term", F.round("weight", 6).alias("weight"))

    return run


QUERIES = {
    "lower_and_fold": _on_documents(lambda t: tx.fold_accents(F.lower(t))),  # C1, C2
    "strip_tags": _on_pages(tx.strip_tags),  # C3
    "punctuation_to_space": _on_documents(tx.punctuation_to_space),  # C4
    "squeeze_whitespace": _on_documents(tx.squeeze_whitespace),  # C5
    "drop_digits": _on_documents(tx.drop_digits),  # C6
    "clean_text_nostem": _on_documents(lambda t: tx.clean_text(t, stem=False)),  # C1-C8, C10
    "clean_pages_nostem": _on_pages(lambda t: tx.clean_text(t, stem=False)),  # C1-C8, C10
    "clean_text": _on_documents(tx.clean_text),  # C9, C10
    "snippet": _on_documents(tx.snippet),  # C11
    "halves": _halves,  # C12
    "decode_bytes": _decode,  # C13
    "tokens": _term_counts,  # D1
    "ngrams": _ngrams,  # D2
    "vocabulary": _vocabulary(topic_words, features.TOPIC_BOUNDS),  # D3
    "ngram_vocabulary": _vocabulary(classifier_grams, features.CLASSIFIER_BOUNDS),  # D2, D3
    "tfidf": _tfidf(topic_words, features.TOPIC_BOUNDS, False),  # D4
    "tfidf_sublinear": _tfidf(classifier_grams, features.CLASSIFIER_BOUNDS, True),  # D5
}

# --- the same results in SQL -------------------------------------------------

_STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in tx.STOP_WORDS)


def _fold(t: str) -> str:
    return rf"regexp_replace(strip_accents({t}), '[^\x00-\x7F]', '', 'g')"


def _tags(t: str) -> str:
    return f"regexp_replace({t}, '<[^>]+>', '', 'g')"


def _punct(t: str) -> str:
    return f"regexp_replace({t}, '[[:punct:]]+', ' ', 'g')"


def _space(t: str) -> str:
    return rf"regexp_replace({t}, '[\t-\r\x1c-\x20]+', ' ', 'g')"


def _digits(t: str) -> str:
    return f"regexp_replace({t}, '[0-9]+', '', 'g')"


def clean_sql(t: str) -> str:
    words = f"string_split({_digits(_space(_punct(_tags(_fold(f'lower({t})')))))}, ' ')"
    return (
        f"array_to_string(list_filter({words}, lambda w: length(w) >= 3 AND NOT list_contains([{_STOP}], w)), ' ')"
    )


_WORDS = r"regexp_extract_all({0}, '[\p{{L}}\p{{N}}_]{{2,}}')"
_TOPIC_COUNTS = f"""counts AS (SELECT doc_id, term, count(*) AS tf FROM (
  SELECT doc_id, unnest({_WORDS.format('lower(text)')}) AS term FROM documents) GROUP BY ALL)"""


def _grams(table: str, key: str) -> str:
    words = _WORDS.format("text")
    return f"""words AS (SELECT {key}, {words} AS w FROM {table}),
grams AS (SELECT {key}, unnest(w) AS term FROM words
  UNION ALL SELECT {key}, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM words
  UNION ALL SELECT {key}, unnest(list_transform(range(1, len(w) - 1),
    lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM words)"""


_GRAM_COUNTS = (
    _grams("documents", "doc_id")
    + ", counts AS (SELECT doc_id, term, count(*) AS tf FROM grams GROUP BY ALL)"
)


def _vocab(bounds: dict) -> str:
    return f"""vocab AS (SELECT term, count(*) AS df, sum(tf)::BIGINT AS total FROM counts GROUP BY term
  HAVING count(*) >= {bounds['min_df']} AND count(*) <= {bounds['max_df']} * (SELECT count(*) FROM documents)
  ORDER BY total DESC, term LIMIT {bounds['max_terms']})"""


def _weights(tf: str) -> str:
    return f""", weighted AS (SELECT doc_id, term,
  {tf} * (ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1) AS w
  FROM counts JOIN vocab USING (term))
SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM weighted"""


def _doc(expression: str) -> str:
    return f"SELECT doc_id, {expression} AS result FROM documents"


SQL = {
    "lower_and_fold": _doc(_fold("lower(text)")),
    "strip_tags": f"SELECT page_id, {_tags('html')} AS result FROM pages",
    "punctuation_to_space": _doc(_punct("text")),
    "squeeze_whitespace": _doc(_space("text")),
    "drop_digits": _doc(_digits("text")),
    "clean_text_nostem": _doc(clean_sql("text")),
    "clean_pages_nostem": f"SELECT page_id, {clean_sql('html')} AS result FROM pages",
    "snippet": _doc("substring(text, 1, 1000)"),
    "halves": """SELECT doc_id, substring(text, 1, length(text) // 2) AS first_half,
  substring(text, length(text) // 2 + 1) AS second_half FROM documents""",
    "decode_bytes": _doc(r"regexp_replace(text, '[^\x00-\x7F]', '', 'g')"),
    "tokens": f"WITH {_TOPIC_COUNTS} SELECT doc_id, term, tf FROM counts",
    "ngrams": f"WITH {_grams('documents', 'doc_id')} SELECT doc_id, term AS gram FROM grams",
    "vocabulary": f"WITH {_TOPIC_COUNTS}, {_vocab(features.TOPIC_BOUNDS)} SELECT * FROM vocab",
    "ngram_vocabulary": f"WITH {_GRAM_COUNTS}, {_vocab(features.CLASSIFIER_BOUNDS)} SELECT * FROM vocab",
    "tfidf": f"WITH {_TOPIC_COUNTS}, {_vocab(features.TOPIC_BOUNDS)}" + _weights("tf"),
    "tfidf_sublinear": f"WITH {_GRAM_COUNTS}, {_vocab(features.CLASSIFIER_BOUNDS)}"
    + _weights("(1 + ln(tf))"),
}
