"""Vocabularies and TF-IDF weights, relational and as ML vectors."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Vocabulary bounds of the classifier and of the topic models.
CLASSIFIER_BOUNDS = {"min_df": 2, "max_df": 0.9, "max_terms": 30_000}
TOPIC_BOUNDS = {"min_df": 2, "max_df": 0.95, "max_terms": 1_000}


def term_counts(docs: DataFrame, key: str, tokens: Column, vocab: DataFrame | None = None) -> DataFrame:
    """(key, term, tf): one row per document and distinct term, of the terms of ``vocab``
    where it is given; its rows are bounded by ``max_terms`` and go to all tasks.

    The outer form of explode keeps the optimiser from adding a size test, which
    would split every text a second time.
    """
    terms = docs.select(key, F.explode_outer(tokens).alias("term")).filter(F.col("term").isNotNull())
    if vocab is not None:
        terms = terms.join(F.broadcast(vocab.select("term")), "term", "left_semi")
    return terms.groupBy(key, "term").agg(F.count("*").alias("tf"))


def by_key(docs: DataFrame, key: str) -> DataFrame:
    """Documents of a key in one partition, before they are split into words: no word is
    shuffled then to be counted in its document or to find the length of its row."""
    return docs.repartition(key)


def term_totals(docs: DataFrame, tokens: Column) -> DataFrame:
    """(term, df, total) in one shuffle: tokens are sorted inside their row, and
    the first of each run of equal ones counts as the document."""
    ordered = docs.select(F.sort_array(tokens).alias("ordered"))
    runs = F.transform(
        "ordered",
        lambda t, i: F.struct(
            t.alias("term"),
            F.when((i > 0) & (F.get("ordered", i - 1) == t), 0).otherwise(1).alias("is_first"),
        ),
    )
    spread = ordered.select(F.inline_outer(runs)).filter(F.col("term").isNotNull())
    return spread.groupBy("term").agg(
        F.sum("is_first").alias("df"), F.count("*").alias("total")
    )


def document_frequencies(counts: DataFrame) -> DataFrame:
    """(term, df, total) from term counts that are needed anyway."""
    return counts.groupBy("term").agg(
        F.count("*").alias("df"), F.sum("tf").cast("long").alias("total")
    )


def vocabulary(
    totals: DataFrame, n_docs: int, min_df: int, max_df: float, max_terms: int
) -> DataFrame:
    """D3: (term, df, total), the most frequent terms inside the document-frequency
    bounds; equal totals are ordered by term."""
    bounded = totals.filter((F.col("df") >= min_df) & (F.col("df") <= max_df * n_docs))
    return bounded.orderBy(F.col("total").desc(), "term").limit(max_terms)


def tfidf(
    counts: DataFrame, vocab: DataFrame, n: int, key: str, sublinear: bool = False
) -> DataFrame:
    """(key, term, weight), smooth idf plus one, rows of unit length."""
    tf = 1 + F.ln("tf") if sublinear else F.col("tf").cast("double")
    idf = F.ln((1 + F.lit(n)) / (1 + F.col("df"))) + 1
    # At most ``max_terms`` rows go to all tasks, and the counts of a document stay together.
    weighted = counts.join(F.broadcast(vocab.select("term", "df")), "term").select(
        key, "term", (tf * idf).alias("weight")
    )
    norm = F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(Window.partitionBy(key)))
    return weighted.withColumn("weight", F.col("weight") / norm)


@dataclass(frozen=True)
class Terms:
    """A fitted vocabulary on the driver: at most ``max_terms`` words."""

    words: tuple[str, ...]
    df: tuple[int, ...]
    n_docs: int

    def idf(self) -> list[float]:
        return [math.log((1 + self.n_docs) / (1 + d)) + 1 for d in self.df]


def fit_terms(
    docs: DataFrame, tokens: Column, min_df: int, max_df: float, max_terms: int
) -> Terms:
    """D3 as a list on the driver, bounded by ``max_terms`` and ordered by term so
    that feature numbers are stable."""
    n_docs = docs.count()
    vocab = vocabulary(term_totals(docs, tokens), n_docs, min_df, max_df, max_terms)
    rows = vocab.orderBy("term").collect()
    return Terms(tuple(r["term"] for r in rows), tuple(r["df"] for r in rows), n_docs)


def count_vectors(docs: DataFrame, terms: Terms, tokens: str, out: str = "counts") -> DataFrame:
    """Sparse term counts of a token column, row by row without a shuffle."""
    return CountVectorizerModel.from_vocabulary(list(terms.words), tokens, out).transform(docs)


_VECTOR = T.StructType([T.StructField("v", VectorUDT())])


def sublinear(vectors: DataFrame, inputs: str, out: str) -> DataFrame:
    """D5 on vectors: 1 + ln(tf) of the stored entries.

    MLlib has no such stage; the sparse vector is opened as a struct, its values
    are mapped, and JSON turns the struct back into a vector, all on the JVM.
    """
    opened = F.unwrap_udt(F.col(inputs))
    mapped = opened.withField("values", F.transform(opened["values"], lambda v: 1 + F.ln(v)))
    packed = F.to_json(F.struct(mapped.alias("v")))
    return vectors.withColumn(out, F.from_json(packed, _VECTOR)["v"])


def idf_weights(vectors: DataFrame, terms: Terms, inputs: str, out: str) -> DataFrame:
    """D4 on vectors: idf weights, then unit length; both are row-wise stages."""
    idf = ElementwiseProduct(
        scalingVec=Vectors.dense(terms.idf()), inputCol=inputs, outputCol="__weighted"
    )
    unit = Normalizer(p=2.0, inputCol="__weighted", outputCol=out)
    return unit.transform(idf.transform(vectors)).drop("__weighted")


def terms_table(spark: SparkSession, terms: Terms) -> DataFrame:
    """The vocabulary as a table (index, term, df)."""
    rows = [(i, w, d) for i, (w, d) in enumerate(zip(terms.words, terms.df))]
    return spark.createDataFrame(rows, "index int, term string, df long")


def save_terms(spark: SparkSession, terms: Terms, path: str) -> None:
    table = terms_table(spark, terms).withColumn("n_docs", F.lit(terms.n_docs))
    table.write.mode("overwrite").parquet(path)


def load_terms(spark: SparkSession, path: str) -> Terms:
    rows = spark.read.parquet(path).orderBy("index").collect()
    return Terms(
        tuple(r["term"] for r in rows), tuple(r["df"] for r in rows), rows[0]["n_docs"] if rows else 0
    )
