"""Language identification by n-gram filters that answer with a language bitmask.

For each language the n-grams typical of it go into a Bloom filter. The filters are
bit-sliced: position p of all filters is one integer with a bit per language, so one
lookup of an n-gram (the AND over its positions) returns all languages that contain
it. The bits are counted per language over a text, corrected for the filters' false
positives, and the largest corrected count decides.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstack.llm.common import mix, rows
from quillstack.session import materialise

GRAMS = (1, 3, 4)
SPACE = 32


@functools.cache
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def letter_runs(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased code points of all texts, every run of other characters as one
    space, a space at both ends of each text, and the text each belongs to."""
    lowered = [f" {(t or '').lower()} " for t in texts]
    points = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in lowered])
    points = np.where(_letters()[points], points, SPACE).astype(np.uint64)
    follows = np.zeros(len(points), bool)
    follows[1:] = (points[1:] == SPACE) & (points[:-1] == SPACE) & (owner[1:] == owner[:-1])
    return points[~follows], owner[~follows]


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of all texts, and the text of each."""
    points, owner = letter_runs(texts)
    keys, owners = [], []
    for n in GRAMS:
        count = len(points) - n + 1
        if count < 1:
            continue
        key = np.full(count, n, np.uint64)
        for k in range(n):
            key = key * np.uint64(0x1FFFFF) + points[k: k + count]
        inside = owner[n - 1:] == owner[:count]
        if n == 1:
            inside &= points != SPACE
        keys.append(mix(key[inside]))
        owners.append(owner[:count][inside])
    if not keys:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate(keys), np.concatenate(owners)


@dataclass
class Filters:
    """``planes[i][p]``: bits of languages 64·i to 64·i+63 at position p."""

    languages: list[str]
    planes: np.ndarray
    hashes: int
    false_rate: np.ndarray

    @classmethod
    def build(cls, languages: list[str], profiles: list[np.ndarray], hashes: int = 3,
              bits_per_gram: int = 16) -> Filters:
        most = max([1, *(len(p) for p in profiles)])
        size = 1 << int(np.ceil(np.log2(most * bits_per_gram)))
        planes = np.zeros((-(-len(languages) // 64) or 1, size), np.uint64)
        rate = []
        for number, profile in enumerate(profiles):
            bit = np.uint64(1) << np.uint64(number % 64)
            for at in positions(profile, hashes, size):
                planes[number // 64, at] |= bit
            rate.append(float(((planes[number // 64] & bit) > 0).mean()) ** hashes)
        return cls(languages, planes, hashes, np.array(rate))

    def masks(self, keys: np.ndarray) -> np.ndarray:
        """Languages that contain each n-gram, as bits; one row per 64 languages."""
        found = None
        for at in positions(keys, self.hashes, self.planes.shape[1]):
            found = self.planes[:, at] if found is None else found & self.planes[:, at]
        return found

    def counts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """N-grams of each text, and the corrected counts by text and language."""
        keys, owner = grams(texts)
        total = np.bincount(owner, minlength=len(texts)).astype(float)
        masks = self.masks(keys)
        hits = np.empty((len(texts), len(self.languages)))
        for k in range(len(self.languages)):
            bit = (masks[k // 64] >> np.uint64(k % 64)) & np.uint64(1)
            hits[:, k] = np.bincount(owner, weights=bit, minlength=len(texts))
        return total, (hits - total[:, None] * self.false_rate) / (1 - self.false_rate)


def positions(keys: np.ndarray, hashes: int, size: int):
    step = (keys >> np.uint64(32)) | np.uint64(1)
    for k in range(hashes):
        yield ((keys + np.uint64(k) * step) & np.uint64(size - 1)).astype(np.int64)


def sample(docs: DataFrame, lang: str, per_language: int) -> DataFrame:
    """About ``per_language`` rows of each language, chosen by a hash of the text, or
    all where there are fewer; rows without a language are left out."""
    named = docs.filter(F.col(lang).isNotNull())
    counts = named.groupBy(lang).count().collect()  # one row per language
    if not counts:
        return named
    share = F.create_map(*(x for r in counts for x in (F.lit(r[0]), F.lit(min(1.0, per_language / r[1])))))
    draw = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / float(1 << 30)
    return named.filter(draw < share[F.col(lang)])


def train(docs: DataFrame, lang: str = "lang", text: str = "text", per_language: int = 3000,
          profile: int = 4000, dominance: float = 0.5) -> Filters:
    """Filters of the languages in ``docs``, fitted on at most about ``per_language``
    rows of each.

    A language's profile is its ``profile`` n-grams of highest frequency that are in no
    other language more than 1/``dominance`` times as frequent. Only the profiles
    reach the driver: their size is bounded by ``profile`` times the languages."""
    chosen = materialise(sample(docs.select(docs[lang].alias("lang"), docs[text].alias("text")),
                                "lang", per_language), "language-sample")

    def count(batches):
        for part in rows(batches):
            keys, owner = grams(part.column("text").to_pylist())
            names, code = np.unique(np.array(part.column("lang").to_pylist(), object), return_inverse=True)
            for k, name in enumerate(names):
                gram, times = np.unique(keys[code[owner] == k], return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(gram), pa.string()), pa.array(gram.view(np.int64)), pa.array(times)],
                    ["lang", "gram", "n"])

    found = chosen.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(
        F.sum("n").alias("n"))
    found = materialise(found, "language-grams")
    totals = dict(found.groupBy("lang").agg(F.sum("n")).collect())
    languages = sorted(totals)
    if not languages:
        return Filters.build([], [])
    total = F.create_map(*(x for k, v in totals.items() for x in (F.lit(k), F.lit(float(v)))))
    rated = found.withColumn("p", F.col("n") / total[F.col("lang")])
    best = rated.groupBy("gram").agg(F.max("p").alias("best"))
    typical = rated.join(best, "gram").filter(F.col("p") >= dominance * F.col("best"))
    profiles = []
    for name in languages:
        top = typical.filter(F.col("lang") == name).orderBy(F.desc("n"), "gram").limit(profile)
        profiles.append(np.array([r[0] for r in top.select("gram").collect()], np.int64).view(np.uint64))
    return Filters.build(languages, profiles)


def predict(docs: DataFrame, filters: Filters, id_col: str = "doc_id",
            text_col: str = "text") -> DataFrame:
    """``(id, lang_pred, score)``: the language of the largest corrected count, ties
    to the first by name, and its share of all positive counts. ``und`` with score 0
    for a text that is null or has no letter, and if no language was learned. A row
    for each row of ``docs``; other columns are not looked at."""
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def run(batches):
        model = shared.value
        for part in rows(batches, "t"):
            texts = part.column("t").to_pylist()
            names, scores = ["und"] * len(texts), np.zeros(len(texts))
            if model.languages:
                total, counts = model.counts(texts)
                best = np.argmax(counts, axis=1)
                positive = np.maximum(counts, 0)
                mass = positive.sum(axis=1)
                scores = np.where(mass > 0, positive[np.arange(len(best)), best] / np.maximum(mass, 1e-300), 0.0)
                names = [model.languages[b] if n else "und" for b, n in zip(best, total)]
            yield pa.RecordBatch.from_arrays(
                [part.column("i"), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                [id_col, "lang_pred", "score"])

    picked = docs.select(docs[id_col].alias("i"), docs[text_col].alias("t"))
    kind = picked.schema["i"].dataType.simpleString()
    return picked.mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double")
