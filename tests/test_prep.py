import math

import pytest
from pyspark.sql import functions as F

from quillstack.functions.skew import salted_join
from quillstack.operators import features, prep


@pytest.fixture(scope="module")
def skewed(spark):
    """One label holds most rows."""
    return spark.range(2000).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 10 < 7, "hot").otherwise(F.concat(F.lit("l"), F.col("id") % 7)).alias("label"),
    )


def test_salted_join_keeps_meaning(spark, skewed):
    names = spark.createDataFrame([("hot", "Hot"), ("l1", "One"), ("zz", "None")], "label string, name string")
    for how in ("inner", "left", "left_semi", "left_anti"):
        plain = skewed.join(names, "label", how)
        salted = salted_join(skewed, names, ["label"], ["doc_id"], how).select(plain.columns)
        assert sorted(map(str, salted.collect())) == sorted(map(str, plain.collect()))


def test_split_quotas(spark, skewed):
    split = prep.stratified_split(skewed, "label", "doc_id").collect()
    assert len(split) == 2000
    n_test = sum(r["split"] == "test" for r in split)
    assert n_test == math.ceil(0.2 * 2000)
    for label in {r["label"] for r in split}:
        rows = [r for r in split if r["label"] == label]
        assert abs(sum(r["split"] == "test" for r in rows) - 0.2 * len(rows)) < 1
    again = prep.stratified_split(skewed.repartition(7), "label", "doc_id").collect()
    assert sorted(map(tuple, split)) == sorted(map(tuple, again))


def test_dense_numbers(spark):
    ids = [5, 1, 900, 17, 10**12, 3] + list(range(2000, 2600, 3))
    df = spark.createDataFrame([(i,) for i in ids], "doc_id long")
    rows = prep.dense_numbers(df, "doc_id", ranges=16).collect()
    assert {r["doc_id"]: r["doc_num"] for r in rows} == {v: i for i, v in enumerate(sorted(ids))}
    assert next(r for r in rows if r["doc_num"] == 7)["file_name"] == "000007"
    long = spark.range(1).select(prep.zero_padded(F.lit(1_234_567)).alias("n")).first()["n"]
    assert long == "1234567"


def test_usable_and_rare(spark):
    df = spark.createDataFrame(
        [(1, "a", "t"), (2, None, "t"), (3, "a", ""), (4, "b", "t"), (5, "a", "t")],
        "doc_id long, issue_area string, text string",
    )
    kept = prep.usable(df)
    assert [r["doc_id"] for r in kept.orderBy("doc_id").collect()] == [1, 4, 5]
    rare = prep.drop_rare_labels(kept, "issue_area", "doc_id")
    assert [r["doc_id"] for r in rare.orderBy("doc_id").collect()] == [1, 5]


def test_sentinels(spark):
    df = spark.createDataFrame([(None, None, None)], "issue_area int, decision_date date, case_name string")
    assert tuple(map(str, prep.fill_sentinels(df).first())) == ("-1", "1900-01-01", "")


def test_completeness(spark, skewed):
    split = prep.stratified_split(skewed, "label", "doc_id")
    assert prep.completeness(skewed, split, "doc_id").first()["complete"]
    partial = prep.completeness(skewed, split.filter("doc_id <> 3"), "doc_id").first()
    assert not partial["complete"] and partial["n_missing"] == 1


def test_tfidf_rows_have_unit_length(spark):
    docs = spark.createDataFrame(
        [(1, ["a", "b", "a"]), (2, ["a", "c"]), (3, ["b", "c", "c"]), (4, [])], "doc_id long, t array<string>"
    )
    counts = features.term_counts(docs, "doc_id", F.col("t"))
    assert sorted(map(tuple, features.term_totals(docs, F.col("t")).collect())) == [
        ("a", 2, 3), ("b", 2, 2), ("c", 2, 3)
    ]
    vocab = features.vocabulary(features.document_frequencies(counts), 4, 2, 0.95, 10)
    weights = features.tfidf(counts, vocab, 4, "doc_id")
    norms = weights.groupBy("doc_id").agg(F.sum(F.col("weight") ** 2).alias("n")).collect()
    assert all(r["n"] == pytest.approx(1) for r in norms)


def test_vector_weights_equal_relational(spark):
    docs = spark.createDataFrame(
        [(1, ["a", "b", "a"]), (2, ["a", "c"]), (3, ["b", "c", "c"]), (4, ["z"])], "doc_id long, t array<string>"
    )
    terms = features.fit_terms(docs, F.col("t"), 2, 0.95, 10)
    counts = features.term_counts(docs, "doc_id", F.col("t"))
    vocab = features.vocabulary(features.document_frequencies(counts), 4, 2, 0.95, 10)
    expected = {
        (r["doc_id"], r["term"]): r["weight"]
        for r in features.tfidf(counts, vocab, 4, "doc_id", sublinear=True).collect()
    }
    vectors = features.sublinear(features.count_vectors(docs, terms, "t"), "counts", "tf")
    rows = features.idf_weights(vectors, terms, "tf", "w").select("doc_id", "w").collect()
    got = {
        (r["doc_id"], terms.words[i]): v
        for r in rows
        for i, v in zip(r["w"].indices.tolist(), r["w"].values.tolist())
    }
    assert got == pytest.approx(expected)


def test_words_of_a_document_are_not_shuffled_for_its_weights(spark):
    docs = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["a", "c"]), (1, ["b"]), (None, ["c", "b"])], "doc_id long, t array<string>")
    vocab = spark.createDataFrame([("a", 2, 3), ("b", 2, 3)], "term string, df long, total long")
    together = features.by_key(docs, "doc_id")
    counts = features.term_counts(together, "doc_id", F.col("t"), vocab)
    weights = features.tfidf(counts, vocab, 3, "doc_id")
    plan = weights._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert sorted(map(tuple, counts.collect()), key=str) == [(1, "a", 2), (1, "b", 2), (2, "a", 1), (None, "b", 1)]
    plain = features.tfidf(features.term_counts(docs, "doc_id", F.col("t")), vocab, 3, "doc_id")
    assert sorted(map(str, weights.collect())) == sorted(map(str, plain.collect()))


def test_words_are_sorted_without_a_function_for_each_comparison(spark):
    docs = spark.createDataFrame([(1, ["b", "a", "b"])], "doc_id long, t array<string>")
    plan = features.term_totals(docs, F.col("t"))._jdf.queryExecution().optimizedPlan().toString()
    assert "sort_array(" in plan and "array_sort(" not in plan
