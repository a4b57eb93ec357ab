"""Topic models, topic words, topic mixes and the coherence test."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstack.functions.text import first_half, second_half
from quillstack.functions.tokens import model_tokens
from quillstack.operators import features
from quillstack.operators.lda import LdaModel, fit_lda
from quillstack.operators.nmf import NmfModel, fit_nmf
from quillstack.session import materialise, path_exists, spread

COMPONENTS = 30
TOP_WORDS = 10
TOP_TOPICS = 3
LDA_PASSES, LDA_OFFSET, LDA_DECAY, LDA_SEED = 25, 50.0, 0.7, 0
MODEL_TYPES = ("lda", "nmf")


def _counts(docs: DataFrame, terms: features.Terms, clean: str) -> DataFrame:
    tokenised = docs.withColumn("__tokens", model_tokens(F.col(clean)))
    return features.count_vectors(tokenised, terms, "__tokens", "__counts").drop("__tokens")


def _opened(vectors: DataFrame, column: str) -> DataFrame:
    """The entries of a sparse vector as index and value arrays in its place."""
    opened = F.unwrap_udt(column)
    return vectors.withColumns({"indices": opened["indices"], "values": opened["values"]}).drop(column)


def _count_rows(docs: DataFrame, terms: features.Terms, clean: str) -> DataFrame:
    """Term counts as index and value arrays."""
    return _opened(_counts(docs, terms, clean), "__counts")


def _rows(docs: DataFrame, terms: features.Terms, clean: str) -> DataFrame:
    """TF-IDF rows as index and value arrays."""
    weighted = features.idf_weights(_counts(docs, terms, clean), terms, "__counts", "__tfidf")
    return _opened(weighted, "__tfidf").drop("__counts")


@dataclass(frozen=True)
class TopicModel:
    kind: str
    terms: features.Terms
    lda: LdaModel | None = None
    nmf: NmfModel | None = None

    def mix(self, docs: DataFrame, clean: str = "clean_text", out: str = "topics") -> DataFrame:
        """adds the topic weights of each document as ARRAY<DOUBLE>."""
        model, of = (self.lda, _count_rows) if self.lda is not None else (self.nmf, _rows)
        rows = of(docs, self.terms, clean)
        return rows.withColumn(out, model.mix(F.col("indices"), F.col("values"))).drop("indices", "values")

    def save(self, spark: SparkSession, path: str) -> None:
        features.save_terms(spark, self.terms, f"{path}/terms")
        weights = self.nmf.h if self.lda is None else self.lda.weights
        rows = [(t, row.tolist()) for t, row in enumerate(weights)]
        table = spark.createDataFrame(rows, "topic int, weights array<double>")
        table.write.mode("overwrite").parquet(f"{path}/{self.kind}")

    @staticmethod
    def load(spark: SparkSession, path: str) -> TopicModel | None:
        """None when there is no model at the path."""
        for kind in MODEL_TYPES:
            if path_exists(spark, f"{path}/{kind}"):
                rows = spark.read.parquet(f"{path}/{kind}").orderBy("topic").collect()
                weights = np.array([r["weights"] for r in rows])
                model = {"lda": LdaModel(weights)} if kind == "lda" else {"nmf": NmfModel(weights, ())}
                return TopicModel(kind, features.load_terms(spark, f"{path}/terms"), **model)
        return None

    def word_weights(self, spark: SparkSession) -> DataFrame:
        """(topic, term, weight): at most components x vocabulary rows."""
        weights = self.nmf.h if self.lda is None else self.lda.weights / self.lda.weights.sum(axis=1, keepdims=True)
        cells = [(t, i, float(w)) for t, row in enumerate(weights) for i, w in enumerate(row)]
        pairs = spark.createDataFrame(cells, "topic int, index int, weight double")
        return pairs.join(features.terms_table(spark, self.terms), "index").select(
            "topic", "term", "weight"
        )


def train_topics(
    docs: DataFrame,
    kind: str,
    clean: str = "clean_text",
    components: int = COMPONENTS,
    passes: int = LDA_PASSES,
    subsampling: float = 0.25,
    rounds: int = 20,
) -> TopicModel:
    """F1 or F2. For LDA every pass over the corpus is ``1 / subsampling`` steps.
    The training matrix is stored once and read by every step."""
    if kind not in MODEL_TYPES:
        raise ValueError(f"unknown topic model: {kind}")
    source = docs.select(clean)
    tokenised = source.select(model_tokens(F.col(clean)).alias("tokens"))
    terms = features.fit_terms(tokenised, F.col("tokens"), **features.TOPIC_BOUNDS)
    if kind == "nmf":
        stored = materialise(_rows(source, terms, clean).select("indices", "values"), "tfidf-rows")
        model = fit_nmf(spread(stored), len(terms.words), components, rounds)
        return TopicModel(kind, terms, nmf=model)
    kept = spread(materialise(_count_rows(source, terms, clean).select("indices", "values"), "term-counts")).persist()
    try:
        steps = max(1, round(passes / subsampling))
        model = fit_lda(kept, len(terms.words), components, steps, subsampling, LDA_OFFSET, LDA_DECAY, LDA_SEED)
        return TopicModel(kind, terms, lda=model)
    finally:
        kept.unpersist()


def topic_words(weights: DataFrame, n: int = TOP_WORDS) -> DataFrame:
    """(topic, words), the heaviest words of each topic joined by spaces."""
    order = Window.partitionBy("topic").orderBy(F.round("weight", 6).desc(), "term")
    best = weights.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n)
    listed = F.array_sort(F.collect_list(F.struct("place", "term")))
    return best.groupBy("topic").agg(F.array_join(F.transform(listed, lambda w: w["term"]), " ").alias("words"))


def top_topics(weights: Column, n: int = TOP_TOPICS) -> Column:
    """the n largest shares of a topic mix as ARRAY<STRUCT<topic, weight>>."""
    total = F.aggregate(weights, F.lit(0.0), lambda a, w: a + F.abs(w))
    ranked = F.array_sort(
        F.transform(weights, lambda w, i: F.struct((-w).alias("key"), i.alias("topic"), w.alias("w")))
    )
    return F.transform(
        F.slice(ranked, 1, n),
        lambda t: F.struct(
            t["topic"].alias("topic"),
            F.when(total > 0, F.bround(t["w"] / total, 2)).otherwise(0.0).alias("weight"),
        ),
    )


def _unit(vector: Column) -> Column:
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(vector, lambda x: F.when(norm > 0, x / norm).otherwise(0.0))


def half_coherence(pairs: DataFrame, first: str, second: str) -> DataFrame:
    """mean cosine of same-document halves, and of all pairs of halves.

    The mean over all pairs equals the product of the two sums of unit vectors
    divided by n squared, so no pair is formed.
    """
    units = pairs.select(_unit(F.col(first)).alias("a"), _unit(F.col(second)).alias("b"))
    per_dimension = units.select(
        F.posexplode_outer(F.arrays_zip("a", "b")).alias("dimension", "x")
    ).groupBy("dimension").agg(
        F.sum("x.a").alias("sum_a"),
        F.sum("x.b").alias("sum_b"),
        F.sum(F.col("x.a") * F.col("x.b")).alias("dot"),
        F.count("*").alias("n"),
    )
    n = F.max("n")
    return per_dimension.agg(
        (F.sum("dot") / n).alias("intra"),
        (F.sum(F.col("sum_a") * F.col("sum_b")) / (n * n)).alias("inter"),
    )


def model_coherence(model: TopicModel, docs: DataFrame, clean: str = "clean_text") -> DataFrame:
    """F7 for a fitted model: C12 halves, F3 mixes, then the two means."""
    text = F.col(clean)
    halves = docs.select(first_half(text).alias("h1"), second_half(text).alias("h2"))
    mixed = model.mix(model.mix(halves, "h1", "first"), "h2", "second")
    return half_coherence(mixed, "first", "second")
