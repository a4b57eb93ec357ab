"""Linear classification of cleaned documents.

One linear machine per class with hinge loss and L2 penalty on sublinear TF-IDF
of word n-grams. The optimiser is MLlib's, so weights differ from those of a
stochastic solver of the same objective.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LinearSVC, OneVsRest, OneVsRestModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstack.functions.text import clean_text
from quillstack.functions.tokens import model_tokens, word_ngrams
from quillstack.operators import features
from quillstack.session import materialise, path_exists

ALPHA = 1e-5
EPOCHS = 50


def _features(docs: DataFrame, terms: features.Terms, clean: str) -> DataFrame:
    tokenised = _grams(docs, clean)
    counted = features.count_vectors(tokenised, terms, "__grams", "__counts")
    scaled = features.sublinear(counted, "__counts", "__tf")
    weighted = features.idf_weights(scaled, terms, "__tf", "features")
    return weighted.drop("__grams", "__counts", "__tf")


def _grams(docs: DataFrame, clean: str) -> DataFrame:
    words = docs.withColumn("__words", model_tokens(F.col(clean), lowercase=False))
    return words.withColumn("__grams", word_ngrams("__words")).drop("__words")


@dataclass(frozen=True)
class TextClassifier:
    terms: features.Terms
    model: OneVsRestModel

    def predict(self, docs: DataFrame, clean: str = "clean_text") -> DataFrame:
        """Adds ``pred_label_num``; the text must be cleaned like the training
        texts. Rows are scored one by one, without a shuffle."""
        scored = self.model.transform(_features(docs, self.terms, clean))
        number = F.col("prediction").cast("int")
        return scored.withColumn("pred_label_num", number).drop(
            "features", "rawPrediction", "prediction"
        )

    def save(self, spark: SparkSession, path: str) -> None:
        """E4"""
        features.save_terms(spark, self.terms, f"{path}/terms")
        self.model.write().overwrite().save(f"{path}/model")

    @staticmethod
    def load(spark: SparkSession, path: str) -> TextClassifier | None:
        """None when there is no model at the path."""
        if not path_exists(spark, f"{path}/model"):
            return None
        terms = features.load_terms(spark, f"{path}/terms")
        return TextClassifier(terms, OneVsRestModel.load(f"{path}/model"))


def with_clean_text(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.withColumn("clean_text", clean_text(F.col(text)))


def train(
    docs: DataFrame, label: str, clean: str = "clean_text", parallelism: int = 4
) -> TextClassifier:
    """``label`` holds class numbers from zero. The weighted vectors are
    stored once, since every pass of every class reads them again."""
    source = docs.select(F.col(label).cast("double").alias("label"), clean)
    grams = _grams(source, clean)
    terms = features.fit_terms(grams, F.col("__grams"), **features.CLASSIFIER_BOUNDS)
    vectors = _features(source, terms, clean).select("label", "features")
    stored = materialise(vectors, "classifier-features")
    machine = LinearSVC(regParam=ALPHA, maxIter=EPOCHS, standardization=False)
    return TextClassifier(terms, OneVsRest(classifier=machine, parallelism=parallelism).fit(stored))


def class_numbers(docs: DataFrame, name: str) -> DataFrame:
    """(code, name): class names numbered from zero in name order; one row per class."""
    names = docs.select(F.col(name).alias("name")).distinct()
    ordered = names.agg(F.array_sort(F.collect_list("name")).alias("names"))
    return ordered.select(F.posexplode("names").alias("code", "name"))


def report(predicted: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """Precision, recall, F1 and support per class, then accuracy, macro and
    weighted average. Documents are counted per (label, prediction) first."""
    cells = predicted.groupBy(F.col(label).alias("label"), F.col(pred).alias("pred")).agg(
        F.count("*").alias("n")
    )
    hit = F.when(F.col("label") == F.col("pred"), F.col("n")).otherwise(0)
    actual = cells.groupBy("label").agg(F.sum("n").alias("support"), F.sum(hit).alias("tp"))
    claimed = cells.groupBy(F.col("pred").alias("label")).agg(F.sum("n").alias("claimed"))
    joined = actual.join(claimed, "label", "full").na.fill(0)

    def ratio(top, bottom):
        return F.when(bottom > 0, top / bottom).otherwise(0.0)

    precision = ratio(F.col("tp"), F.col("claimed"))
    recall = ratio(F.col("tp"), F.col("support"))
    classes = joined.select(
        F.col("label").cast("string").alias("class"),
        precision.alias("precision"),
        recall.alias("recall"),
        ratio(2 * precision * recall, precision + recall).alias("f1"),
        F.col("support").cast("long").alias("support"),
        F.col("tp").cast("long").alias("tp"),
    )
    measures = ("precision", "recall", "f1")
    support = F.sum("support")
    macro = classes.agg(
        F.lit("macro avg").alias("class"), *[F.avg(m).alias(m) for m in measures], support.alias("support")
    )
    weighted = classes.agg(
        F.lit("weighted avg").alias("class"),
        *[(F.sum(F.col(m) * F.col("support")) / support).alias(m) for m in measures],
        support.alias("support"),
    )
    accuracy = F.sum("tp") / support
    overall = classes.agg(
        F.lit("accuracy").alias("class"), *[accuracy.alias(m) for m in measures], support.alias("support")
    )
    return classes.drop("tp").unionByName(overall).unionByName(macro).unionByName(weighted)
