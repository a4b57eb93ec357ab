"""Registered model queries (E1-E4, F1-F9) and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstack.functions.text import first_half, second_half
from quillstack.operators import classify, prep, similar, topics
from quillstack.plans.prep_queries import split_sql
from quillstack.session import new_path, read_documents, read_table, spread, stored_once


def _clean_documents(spark, folder):
    """Cleaned once and stored: the split, training and prediction all read it."""
    docs = read_documents(spark, folder)
    cleaned = classify.with_clean_text(docs).drop("text")
    path = stored_once(spark, folder, "clean", cleaned.write.parquet)
    return spread(spark.read.schema(cleaned.schema).parquet(path), "doc_id")


def labelled(spark, folder):
    """The cleaned documents with class number and split, and the class names."""
    docs = _clean_documents(spark, folder)
    names = classify.class_numbers(docs, "lang")
    split = prep.stratified_split(docs, "lang", "doc_id").select("doc_id", "split")
    coded = docs.join(names.select(F.col("code").alias("label"), F.col("name").alias("lang")), "lang")
    joined = coded.join(split, "doc_id")
    path = stored_once(spark, folder, "labelled", joined.write.parquet)
    return spread(spark.read.schema(joined.schema).parquet(path), "doc_id"), names


def classifier(spark, folder, docs):
    """Trained on the train side at first use, then loaded."""
    train = docs.filter(F.col("split") == "train")
    path = stored_once(
        spark, folder, "classifier", lambda p: classify.train(train, "label").save(spark, p)
    )
    return classify.TextClassifier.load(spark, path)


def _predicted(spark, folder):
    docs, names = labelled(spark, folder)
    model = classifier(spark, folder, docs)
    predicted = model.predict(docs.filter(F.col("split") == "test"))
    return prep.decode_label(predicted, names, "pred_label_num", "pred_label_str", "doc_id")


def classify_predict(spark, folder):
    """E1, E2, E4, B7"""
    return _predicted(spark, folder).select("doc_id", "lang", "pred_label_num", "pred_label_str")


def classify_evaluate(spark, folder):
    """E1-E3 on the test side"""
    return _rounded(classify.report(_predicted(spark, folder), "lang", "pred_label_str"))


def _rounded(report):
    return report.select(
        "class", *[F.round(m, 6).alias(m) for m in ("precision", "recall", "f1")], "support"
    )


def classify_report(spark, folder):
    """E3 on a prediction by fixed words"""
    docs = read_documents(spark, folder)
    padded = F.concat(F.lit(" "), F.lower("text"), F.lit(" "))
    rule = (
        F.when(padded.contains(" the "), "en")
        .when(padded.contains(" der "), "de")
        .when(padded.contains(" les "), "fr")
        .otherwise("es")
    )
    return _rounded(classify.report(docs.select("lang", rule.alias("pred")), "lang", "pred"))


def topic_model(kind):
    def run(spark, folder):
        docs, _ = labelled(spark, folder)
        train = docs.filter(F.col("split") == "train")
        path = stored_once(
            spark, folder, kind, lambda p: topics.train_topics(train, kind).save(spark, p)
        )
        return docs, topics.TopicModel.load(spark, path)

    return run


def _topic_mixes(kind):
    def run(spark, folder):
        docs, model = topic_model(kind)(spark, folder)
        mixed = model.mix(docs).select("doc_id", topics.top_topics(F.col("topics")).alias("t"))
        return mixed.select("doc_id", F.posexplode_outer("t").alias("place", "entry")).select(
            "doc_id", "place", "entry.topic", "entry.weight"
        )

    return run


def _model_words(kind):
    def run(spark, folder):
        _, model = topic_model(kind)(spark, folder)
        return topics.topic_words(model.word_weights(spark))

    return run


def _coherence(kind):
    def run(spark, folder):
        docs, model = topic_model(kind)(spark, folder)
        return topics.model_coherence(model, docs.filter(F.col("split") == "test"))

    return run


def _mix_check(kind):
    """No negative weight, LDA mixes add up to one (or are zero, without a known
    word), three topics for each document"""
    def run(spark, folder):
        docs, model = topic_model(kind)(spark, folder)
        mixed = model.mix(docs).select("topics", topics.top_topics(F.col("topics")).alias("best"))
        total = F.aggregate("topics", F.lit(0.0), lambda a, x: a + x)
        off = (total != 0) & (F.abs(total - 1) > 1e-6) if kind == "lda" else total < 0
        return mixed.agg(
            F.count("*").alias("n"),
            F.count_if(F.exists("topics", lambda x: x < 0)).alias("n_negative"),
            F.count_if(off).alias("n_off"),
            F.count_if(F.size("best") == 3).alias("n_three"),
        )

    return run


def classify_check(spark, folder):
    """Nine of ten test documents right, and the same from a model saved and loaded again"""
    docs, _ = labelled(spark, folder)
    test = docs.filter(F.col("split") == "test")
    model = classifier(spark, folder, docs)
    path = new_path(spark, "classifier-copy")
    model.save(spark, path)
    again = classify.TextClassifier.load(spark, path).predict(test)
    first = model.predict(test).select("doc_id", "label", F.col("pred_label_num").alias("first"))
    both = first.join(again.select("doc_id", F.col("pred_label_num").alias("second")), "doc_id")
    return both.agg(
        F.count("*").alias("n"),
        (F.avg((F.col("label") == F.col("first")).cast("double")) >= 0.9).alias("good"),
        F.count_if(~F.col("first").eqNullSafe(F.col("second"))).alias("n_different"),
    )


def topic_words(spark, folder):
    """F4 on given weights: word counts per language"""
    docs = read_documents(spark, folder)
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]{2,}"), 0)
    counts = docs.select(F.col("lang").alias("topic"), F.explode(words).alias("term"))
    weights = counts.groupBy("topic", "term").agg(F.count("*").cast("double").alias("weight"))
    return topics.topic_words(weights)


def _vectors(spark, folder):
    return read_table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("doc_id"), F.col("embedding").cast("array<double>").alias("vec"), "label"
    )


def top_topics(spark, folder):
    """F5 on given vectors, made non-negative"""
    mix = F.transform("vec", F.abs)
    best = _vectors(spark, folder).select("doc_id", topics.top_topics(mix).alias("t"))
    return best.select("doc_id", F.posexplode_outer("t").alias("place", "entry")).select(
        "doc_id", "place", "entry.topic", "entry.weight"
    )


def _similar(spark, folder, k):
    corpus = _vectors(spark, folder).select("doc_id", "vec")
    return similar.similar_documents(corpus.withColumnRenamed("doc_id", "query_id"), corpus, k)


def similar_docs(spark, folder):
    """F6"""
    return _similar(spark, folder, 10)


def similar_docs_blocks(spark, folder):
    """F6 with both sides in blocks"""
    corpus = _vectors(spark, folder).select("doc_id", "vec")
    queries = corpus.withColumnRenamed("doc_id", "query_id")
    return similar.similar_documents(queries, similar.SimilarIndex.build(corpus), 10)


def similar_response(spark, folder):
    """F8, C11, B7"""
    vectors = _vectors(spark, folder)
    texts = read_documents(spark, folder).select("doc_id", "text")
    docs = vectors.select("doc_id", "label").join(texts, "doc_id", "left")
    names = read_table(spark, folder, "nation").select(
        F.col("n_nationkey").alias("code"), F.col("n_name").alias("name")
    )
    mixes = vectors.select("doc_id", F.transform("vec", F.abs).alias("vec"))
    answers = similar.similar_response(_similar(spark, folder, 5), docs, mixes, names)
    entries = answers.select("query_id", F.inline("sim_docs_list"))

    def listed(pairs):
        return F.array_join(F.transform(pairs, lambda t: t["topic"].cast("string")), ",")

    return entries.select(
        "query_id",
        "rank",
        F.col("doc.doc_num").alias("doc_num"),
        F.coalesce("doc.text", F.lit("")).alias("text"),
        F.col("doc.actual_label_num").cast("int").alias("label_num"),
        F.col("doc.actual_label_str").alias("label_str"),
        listed(F.col("doc.doc_topics")).alias("doc_topics"),
        "score",
    )


def half_coherence(spark, folder):
    """F7 on given vectors, cut in the middle"""
    half = F.expr("size(vec) div 2").cast("int")
    pairs = _vectors(spark, folder).select(
        F.slice("vec", F.lit(1), half).alias("first"), F.slice("vec", half + 1, half).alias("second")
    )
    means = topics.half_coherence(pairs, "first", "second")
    return means.select(F.round("intra", 6).alias("intra"), F.round("inter", 6).alias("inter"))


def matrix_update(spark, folder):
    """documents marked toxic leave, documents of good quality get a new vector"""
    labels = read_table(spark, folder, "labels").withColumnRenamed("doc_id", "doc_id")
    matrix = _vectors(spark, folder).select("doc_id", "vec")
    added = matrix.join(labels.filter(F.col("quality") == 1), "doc_id").select(
        "doc_id", F.reverse("vec").alias("vec"), F.lit(1).alias("version")
    )
    removed = labels.filter(F.col("toxic") == 1)
    updated = similar.update_matrix(matrix, added, removed, "doc_id", "version")
    return updated.select("doc_id", F.round(F.get("vec", F.lit(0)), 6).alias("first"))


QUERIES = {
    "classify_predict": classify_predict,
    "classify_evaluate": classify_evaluate,
    "classify_report": classify_report,
    "lda_topics": _topic_mixes("lda"),  # F1, F3, F5
    "nmf_topics": _topic_mixes("nmf"),  # F2, F3, F5
    "lda_topic_words": _model_words("lda"),  # F1, F4
    "nmf_topic_words": _model_words("nmf"),  # F2, F4
    "lda_coherence": _coherence("lda"),  # F1, F7
    "nmf_coherence": _coherence("nmf"),  # F2, F7
    "topic_words": topic_words,
    "top_topics": top_topics,
    "similar_docs": similar_docs,
    "similar_docs_blocks": similar_docs_blocks,
    "similar_response": similar_response,
    "lda_check": _mix_check("lda"),
    "nmf_check": _mix_check("nmf"),
    "classify_check": classify_check,
    "half_coherence": half_coherence,
    "matrix_update": matrix_update,
}

# --- the same results in SQL -------------------------------------------------

_PAIRED = """v AS (SELECT vec_id, embedding::DOUBLE[] AS e, label FROM embeddings),
scored AS (SELECT q.vec_id AS query_id, c.vec_id AS doc_id,
  round(list_cosine_similarity(q.e, c.e), 6) AS score FROM v q CROSS JOIN v c),
hits AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank,
  doc_id, score FROM scored)"""

_TOPICS = """mixes AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: abs(x)) AS m FROM embeddings),
cells AS (SELECT vec_id, unnest(m) AS w, generate_subscripts(m, 1) - 1 AS topic, list_sum(m) AS total FROM mixes),
best AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY w DESC, topic) - 1 AS place FROM cells
  QUALIFY place < 3)"""

SQL = {
    "classify_report": """WITH p AS (SELECT lang AS label, CASE
    WHEN contains(' ' || lower(text) || ' ', ' the ') THEN 'en'
    WHEN contains(' ' || lower(text) || ' ', ' der ') THEN 'de'
    WHEN contains(' ' || lower(text) || ' ', ' les ') THEN 'fr' ELSE 'es' END AS pred FROM documents),
c AS (SELECT DISTINCT label FROM p),
m AS (SELECT label, (SELECT count(*) FROM p WHERE p.label = c.label) AS support,
  (SELECT count(*) FROM p WHERE p.pred = c.label) AS claimed,
  (SELECT count(*) FROM p WHERE p.pred = c.label AND p.label = c.label) AS tp FROM c),
r AS (SELECT label, support, tp, CASE WHEN claimed > 0 THEN tp / claimed ELSE 0 END AS p,
  CASE WHEN support > 0 THEN tp / support ELSE 0 END AS q FROM m),
f AS (SELECT *, CASE WHEN p + q > 0 THEN 2 * p * q / (p + q) ELSE 0 END AS f1 FROM r),
u AS (SELECT label AS class, p AS precision, q AS recall, f1, support FROM f
  UNION ALL SELECT 'accuracy', sum(tp) / sum(support), sum(tp) / sum(support), sum(tp) / sum(support), sum(support) FROM f
  UNION ALL SELECT 'macro avg', avg(p), avg(q), avg(f1), sum(support) FROM f
  UNION ALL SELECT 'weighted avg', sum(p * support) / sum(support), sum(q * support) / sum(support),
    sum(f1 * support) / sum(support), sum(support) FROM f)
SELECT class, round(precision::DOUBLE, 6) AS precision, round(recall::DOUBLE, 6) AS recall,
  round(f1::DOUBLE, 6) AS f1, support::BIGINT AS support FROM u""",
    "topic_words": r"""WITH w AS (SELECT lang AS topic, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS term
  FROM documents),
c AS (SELECT topic, term, row_number() OVER (PARTITION BY topic ORDER BY count(*) DESC, term) AS place
  FROM w GROUP BY 1, 2)
SELECT topic, string_agg(term, ' ' ORDER BY place) AS words FROM c WHERE place <= 10 GROUP BY 1""",
    "top_topics": f"""WITH {_TOPICS} SELECT vec_id AS doc_id, place::INT AS place, topic::INT AS topic,
  round_even(w / total, 2)::DOUBLE AS weight FROM best""",
    "similar_docs": f"WITH {_PAIRED} SELECT * FROM hits WHERE rank <= 10",
    "similar_docs_blocks": f"WITH {_PAIRED} SELECT * FROM hits WHERE rank <= 10",
    "similar_response": f"""WITH {_PAIRED}, {_TOPICS},
listed AS (SELECT vec_id, string_agg(topic::VARCHAR, ',' ORDER BY place) AS doc_topics FROM best GROUP BY 1)
SELECT query_id, rank, hits.doc_id AS doc_num, coalesce(substring(text, 1, 1000), '') AS text, label::INT AS label_num,
  n_name AS label_str, doc_topics, score
FROM hits LEFT JOIN documents d ON d.doc_id = hits.doc_id JOIN v ON v.vec_id = hits.doc_id
LEFT JOIN nation ON n_nationkey = label JOIN listed ON listed.vec_id = hits.doc_id WHERE rank <= 5""",
    "lda_check": "SELECT count(*) AS n, 0::BIGINT AS n_negative, 0::BIGINT AS n_off, count(*) AS n_three FROM documents",
    "nmf_check": "SELECT count(*) AS n, 0::BIGINT AS n_negative, 0::BIGINT AS n_off, count(*) AS n_three FROM documents",
    "classify_check": "WITH " + split_sql("documents", "lang", "doc_id")
    + " SELECT count(*) AS n, true AS good, 0::BIGINT AS n_different FROM split WHERE split = 'test'",
    "half_coherence": """WITH h AS (SELECT vec_id, embedding[1:len(embedding) // 2]::DOUBLE[] AS a,
  embedding[len(embedding) // 2 + 1:2 * (len(embedding) // 2)]::DOUBLE[] AS b FROM embeddings)
SELECT round((SELECT avg(list_cosine_similarity(a, b)) FROM h), 6) AS intra,
  round((SELECT avg(list_cosine_similarity(x.a, y.b)) FROM h x CROSS JOIN h y), 6) AS inter""",
    "matrix_update": """SELECT vec_id AS doc_id, round(embedding[1]::DOUBLE, 6) AS first FROM embeddings
  WHERE vec_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1 OR quality = 1)
UNION ALL SELECT vec_id, round(embedding[64]::DOUBLE, 6) FROM embeddings
  WHERE vec_id IN (SELECT doc_id FROM labels WHERE quality = 1)""",
}
