"""Toxicity scores: gradient-boosted trees over dense features, calibrated.

The features are densities: words of a lexicon (whole words and word beginnings,
learned from the labels, so that inflected forms count), lexicon words near a second
person, capitals, punctuation, and words whose letters are
disguised. Trees are fitted by Spark ML and an isotonic regression on rows the trees
have not seen turns their margin into a probability.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstack.llm.common import WORD, rows
from quillstack.session import materialise

#: Second-person forms of English, German, French and Spanish.
SECOND_PERSON = frozenset(
    "you your yours yourself yourselves u ur du dich dir dein deine deinen deiner ihr euch euer "
    "tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros vuestro vuestra".split())
#: Characters that stand in for letters.
DISGUISE = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})
EDGE = re.compile(r"^[\W_]+|[\W_]+$")
NEAR = 5
BEGINNINGS = (4, 5, 6)
CACHE_LIMIT = 150_000
CACHE_LENGTH = 64
FEATURES = ("hit_rate", "log_hits", "weight", "strongest", "distinct_hits", "near_you", "you_rate",
            "caps_words", "capitals", "punctuation", "exclamations", "disguised", "disguised_hits",
            "log_words")
HIT, YOU, CAPS, DISGUISED = 1 << 12, 1 << 13, 1 << 14, 1 << 15


def core(word: str) -> str:
    """The word in lower case without symbols at its ends."""
    return EDGE.sub("", word).lower()


def units(word: str) -> list[str]:
    """What the lexicon may hold of a word: the word, and its beginnings."""
    return [word, *(f"{word[:k]}*" for k in BEGINNINGS if k <= len(word))]


def undisguised(word: str) -> str | None:
    """The letters meant by a word with digits or symbols between its letters, or None
    for a word that has none."""
    bare = EDGE.sub("", word)
    if bare.isalpha() or not any(c.isalpha() for c in bare) or bare.isdigit():
        return None
    plain = "".join(c for c in bare.lower().translate(DISGUISE) if c.isalpha())
    return plain or None


class Codes(dict):
    """Everything that the features need of a word, packed into one integer: lexicon
    place (12 bits), four flags, length, capitals and symbols (16 bits each)."""

    def __init__(self, lexicon: list[str]):
        super().__init__()
        self.place = {w: k + 1 for k, w in enumerate(lexicon)}  # the strongest first

    def find(self, word: str) -> int:
        return min((p for u in units(word) if (p := self.place.get(u))), default=0)

    def __missing__(self, word: str) -> int:
        plain = core(word)
        place, code = self.find(plain), 0
        if not place and (meant := undisguised(word)):
            code |= DISGUISED
            place = self.find(meant)
        if plain in SECOND_PERSON:
            code |= YOU
        if len(plain) > 1 and word.isupper():
            code |= CAPS
        letters = sum(map(str.isalpha, word))
        capitals = sum(map(str.isupper, word))
        code |= place | (HIT if place else 0)
        code |= min(letters, 0x7FFF) << 16 | min(capitals, 0x7FFF) << 32 | min(len(word) - letters, 0x7FFF) << 48
        if len(word) <= CACHE_LENGTH:
            if len(self) >= CACHE_LIMIT:
                self.clear()
            self[word] = code
        return code


def features(text: str | None, codes: Codes, weights: np.ndarray) -> list[float]:
    words = WORD.findall(text) if text else []
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    code = np.fromiter(map(codes.__getitem__, words), np.int64, n)
    hit = np.flatnonzero(code & HIT)
    you = np.flatnonzero(code & YOU)
    place = code[hit] & 0xFFF
    near = 0
    if len(hit) and len(you):
        at = np.searchsorted(you, hit)
        before = hit - you[np.maximum(at - 1, 0)]
        after = you[np.minimum(at, len(you) - 1)] - hit
        near = int(((np.abs(before) <= NEAR) | (np.abs(after) <= NEAR)).sum())
    letters = int((code >> 16 & 0x7FFF).sum())
    return [
        len(hit) / n, math.log1p(len(hit)), float(weights[place].sum()) / math.sqrt(n),
        float(weights[place].max(initial=0.0)), float(len(np.unique(place))), float(near), len(you) / n,
        int((code & CAPS > 0).sum()) / n, int((code >> 32 & 0x7FFF).sum()) / max(letters, 1),
        int((code >> 48 & 0x7FFF).sum()) / n, text.count("!") / n, int((code & DISGUISED > 0).sum()) / n,
        int(((code & DISGUISED > 0) & (code & HIT > 0)).sum()) / n, math.log1p(n),
    ]


def add_features(docs: DataFrame, lexicon: list[tuple[str, float]], text_col: str = "text") -> DataFrame:
    """Adds ``features``, an array of the FEATURES in order; a null, empty or wordless
    text has zeros. Only the text travels to Python and only the features come back:
    the rows themselves stay where they are."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codes = Codes([w for w, _ in shared.value])
        weights = np.array([0.0, *(x for _, x in shared.value)])
        for column in columns:
            found = []
            for part in rows([pa.RecordBatch.from_arrays([column], ["text"])]):
                found += [features(t, codes, weights) for t in part.column(0).to_pylist()]
            yield pa.array(found, pa.list_(pa.float64()))

    return docs.withColumn("features", F.arrow_udf(run, T.ArrayType(T.DoubleType()))(F.col(text_col)))


def learn_lexicon(labelled: DataFrame, size: int = 400, least: int = 3,
                  strength: float = 16.0) -> list[tuple[str, float]]:
    """``(unit, log ratio)`` of the words and word beginnings that mark label 1: in ``least`` such texts or
    more, with a log-likelihood ratio over ``strength``. At most ``size`` words (a
    bound of what reaches the driver), the strongest first."""
    totals = dict(labelled.groupBy("label").count().collect())
    n1, n0 = totals.get(1, 0), totals.get(0, 0)
    if not n1 or not n0:
        return []

    def words(batches):
        for part in rows(batches):
            found: tuple[Counter, Counter] = (Counter(), Counter())
            for text, label in zip(part.column("text").to_pylist(), part.column("label").to_pylist()):
                plain = {core(w) for w in WORD.findall(text or "")} - {""}
                found[label].update({u for w in plain for u in units(w)})
            seen = sorted(found[0].keys() | found[1].keys())
            yield pa.RecordBatch.from_arrays(
                [pa.array(seen, pa.string()), *(pa.array([found[y][u] for u in seen], pa.int64()) for y in (1, 0))],
                ["word", "a", "b"])

    c = F.col
    counted = labelled.mapInArrow(words, "word string, a long, b long").groupBy("word").agg(
        F.sum("a").alias("a"), F.sum("b").alias("b")).filter(c("a") >= least)
    p1, p0 = (c("a") + 0.5) / (n1 + 1.0), (c("b") + 0.5) / (n0 + 1.0)
    mean = (c("a") + c("b")) / float(n1 + n0)

    def part(x, n, p):
        return F.when(x > 0, x * F.log(x / (n * p))).otherwise(0.0)

    ratio = 2 * (part(c("a"), n1, mean) + part(c("b"), n0, mean)
                 + part(n1 - c("a"), n1, 1 - mean) + part(n0 - c("b"), n0, 1 - mean))
    found = counted.withColumn("g", ratio).withColumn("weight", F.log(p1 / p0)).filter(
        (c("g") > strength) & (c("weight") > 0))
    best = found.orderBy(F.desc("g"), "word").limit(size).select("word", "weight").collect()
    return [(r.word, r.weight) for r in best]


class Model:
    """Lexicon, trees and calibration; a constant where the labels have one class."""

    def __init__(self, lexicon=(), trees=None, calibration=None, constant: float = 0.0):
        self.lexicon, self.trees = list(lexicon), trees
        self.calibration, self.constant = calibration, constant

    def score(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """``(id, score, predicted)`` for each row of ``docs``, empty and null texts
        too; other columns are not looked at."""
        return self._scored(docs.select(docs[id_col].alias("_id"), docs[text_col].alias("text"))).select(
            F.col("_id").alias(id_col), "score", "predicted")

    def accepted(self, docs: DataFrame, text_col: str = "text") -> DataFrame:
        """The rows of ``docs`` that are not predicted to be toxic, unchanged. Null and
        empty texts are scored as well; repeated rows fare alike; an empty table stays empty."""
        others = [c for c in docs.columns if c != text_col]
        row = F.struct(*(docs[c] for c in others)) if others else F.lit(0)
        kept = self._scored(docs.select(row.alias("_id"), docs[text_col].alias("text"))).filter("predicted = 0")
        return kept.select(*(F.col("text" if c == text_col else f"_id.`{c}`").alias(c) for c in docs.columns))

    def _scored(self, picked: DataFrame) -> DataFrame:
        """(_id, text) with score and predicted."""
        if self.trees is None:
            out = picked.withColumn("score", F.lit(float(self.constant)))
        else:
            dense = add_features(picked, self.lexicon).withColumn("_features", array_to_vector("features"))
            raw = self.trees.transform(dense).withColumn("margin", vector_to_array("_raw")[1])
            if self.calibration is None:
                raw = raw.withColumn("score", vector_to_array("_probability")[1])
            else:
                raw = self.calibration.transform(raw)
            out = raw.withColumn("score", F.least(F.greatest("score", F.lit(0.0)), F.lit(1.0)))
        return out.select("_id", "text", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def train(labelled: DataFrame, sample: int = 20_000, iterations: int = 20, depth: int = 3,
          seed: int = 7) -> Model:
    """A model of ``(text, label)`` rows with label 0 or 1; others are left out.

    Fitted on about ``sample`` rows at most, chosen by a hash of the text; a fourth of
    them, chosen by another hash, calibrates and trains nothing else."""
    known = labelled.select("text", F.col("label").cast("int").alias("label")).filter("label IN (0, 1)")
    total = known.count()
    if not total:
        return Model()
    draw = F.pmod(F.xxhash64("text", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    chosen = materialise(
        known.filter(draw < sample / total).withColumn(
            "calibrates", F.pmod(F.xxhash64("text", F.lit(seed + 1)), F.lit(4)) == 0), "toxicity-sample")
    fitting = chosen.filter(~F.col("calibrates"))
    share = chosen.agg(F.avg("label")).first()[0] or 0.0
    both = {r.label for r in fitting.select("label").distinct().collect()}
    if both != {0, 1}:
        return Model(constant=share)
    lexicon = learn_lexicon(fitting)
    dense = materialise(
        add_features(chosen, lexicon).drop("text").repartition(8).withColumn("_features", array_to_vector("features")),
        "toxicity-features")
    trees = GBTClassifier(
        featuresCol="_features", labelCol="label", predictionCol="_class", maxIter=iterations,
        maxDepth=depth, stepSize=0.2, seed=seed,
    ).setRawPredictionCol("_raw").setProbabilityCol("_probability").fit(dense.filter(~F.col("calibrates")))
    seen = trees.transform(dense.filter("calibrates")).select(
        vector_to_array("_raw")[1].alias("margin"), F.col("label").cast("double").alias("label"))
    calibration = None
    if seen.select("label").distinct().count() == 2:
        calibration = IsotonicRegression(featuresCol="margin", labelCol="label", predictionCol="score").fit(seen)
    return Model(lexicon, trees, calibration, share)
