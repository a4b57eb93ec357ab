"""Mixing sources to target weights by raking.

Tokens are summed by cell (source, language, topic). Iterative proportional fitting
scales the cells until source, language and topic sums meet their targets; a cell's
weight is the probability of keeping each of its documents, one at most.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from quillstack.llm.common import WordHashes, byte_words, rows
from quillstack.session import materialise

DIMENSIONS = ("source", "lang", "topic")


def counted(texts: list[list[bytes]], hashes: WordHashes, width: int) -> np.ndarray:
    """Words of each text by their hash, for all texts at once."""
    flat = (hashes.of(list(chain.from_iterable(texts))) % np.uint64(width)).view(np.int64)
    owner = np.repeat(np.arange(len(texts)) * width, [len(words) for words in texts])
    return np.bincount(owner + flat, minlength=len(texts) * width).reshape(len(texts), width)


@dataclass
class Topics:
    """Centres of hashed word counts, after the mean of each language is taken off, so
    that topics do not repeat the languages."""

    width: int
    means: dict
    centres: np.ndarray

    def vectors(self, texts: list[list[bytes]], hashes: WordHashes) -> np.ndarray:
        out = np.sqrt(counted(texts, hashes, self.width))
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-300)

    def assign(self, vectors: np.ndarray, langs: list) -> np.ndarray:
        if not len(self.centres):
            return np.zeros(len(vectors), np.int64)
        zero = np.zeros(self.width)
        return np.argmax((vectors - np.array([self.means.get(x, zero) for x in langs])) @ self.centres.T, axis=1)


#: Sums of vectors are taken in whole steps of this size, so they do not depend on the
#: order of rows and a rerun gives the same topics.
STEPS = float(1 << 24)


def cell_sums(frame: DataFrame, kind: str, add) -> dict:
    """``{key: (count, sums)}`` over all rows. ``add(totals, batch)`` adds the rows of a
    batch to a dict of ``[count, sums of steps]``; only those sums leave a task."""
    def partial(batches):
        totals = {}
        for batch in batches:
            add(totals, batch)
        names, places, values = [], [], []
        for name, (count, sums) in totals.items():
            at = np.flatnonzero(sums)
            names += [name] * (len(at) + 1)
            places += [-1, *at.tolist()]
            values += [count, *sums[at].tolist()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, arrow_kind), pa.array(places, pa.int32()), pa.array(values, pa.int64())], ["key", "place", "value"])

    schema = f"key {kind}, place int, value long"
    arrow_kind = to_arrow_type(T.StructType.fromDDL(schema)["key"].dataType)
    cells = frame.mapInArrow(partial, schema).groupBy("key", "place").agg(F.sum("value").alias("value"))
    out = {}
    for name, place, value in cells.collect():
        out.setdefault(name, {})[place] = value
    return {name: (sums.pop(-1), sums) for name, sums in out.items()}


def word_counts(docs: DataFrame, lang: str, source: str | None = None, width: int = 128) -> DataFrame:
    """``(source, lang, h, tokens, counts)``, stored: a hash of the words of each document
    with a word, their number, and their counts by hash."""
    kinds = dict(docs.dtypes)
    kind = f"struct<source: {kinds[source] if source else 'int'}, lang: {kinds[lang]}>"

    def read(batches):
        hashes = WordHashes()
        for part in rows(batches):
            texts = byte_words(part)
            at = [k for k, words in enumerate(texts) if words]
            counts = counted(texts, hashes, width).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [part.column("of").take(pa.array(at, pa.int64())),
                 pa.array([xxhash.xxh3_64_intdigest(b" ".join(texts[k])) >> 1 for k in at], pa.int64()),
                 pa.array([len(texts[k]) for k in at], pa.int64()),
                 pa.array([counts[k].tobytes() for k in at], pa.binary())], ["of", "h", "tokens", "counts"])

    own = F.col(source) if source else F.lit(0)
    packed = docs.select(F.struct(own.alias("source"), F.col(lang).alias("lang")).alias("of"), "text")
    found = packed.mapInArrow(read, f"of {kind}, h long, tokens long, counts binary")
    return materialise(found.select("of.source", "of.lang", "h", "tokens", "counts"), "topic-counts")


def units(column: pa.Array, width: int) -> np.ndarray:
    """The vectors of stored counts."""
    x = np.sqrt(np.frombuffer(b"".join(column.to_pylist()), np.int32).reshape(-1, width))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def learn_topics(found: DataFrame, count: int = 8, width: int = 128, sample: int = 4000,
                 rounds: int = 15, seed: int = 5) -> Topics:
    """Spherical k-means over all rows of ``word_counts``. Language means and the sums of
    each round are aggregates over all rows; the driver holds means and centres. Only
    the centres to start from are drawn from about ``sample`` distinct texts."""
    topics = Topics(width, {}, np.empty((0, width)))
    kind = dict(found.dtypes)["lang"]

    def steps(x: np.ndarray) -> np.ndarray:
        return np.rint(x * STEPS).astype(np.int64)

    def collect(totals: dict, names, x: np.ndarray) -> None:
        names = np.array(names, object)
        for name in set(names.tolist()):
            own = names == name if name is not None else np.array([n is None for n in names])
            total = totals.setdefault(name, [0, np.zeros(width, np.int64)])
            total[0] += int(own.sum())
            total[1] += steps(x[own]).sum(axis=0)

    def by_lang(totals, batch):
        if batch.num_rows:
            collect(totals, batch.column("lang").to_pylist(), units(batch.column("counts"), width))

    def dense(sums: dict) -> np.ndarray:
        out = np.zeros(width)
        out[list(sums)] = np.array(list(sums.values()), np.float64) / STEPS
        return out

    topics.means = {name: dense(sums) / n for name, (n, sums) in cell_sums(found, kind, by_lang).items()}
    if not topics.means:
        return topics
    kinds = found.select("h").distinct().count()
    draw = F.pmod(F.xxhash64("h", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    # The distinct texts are told apart before anything is collected.
    start = found.filter(draw < sample / kinds).groupBy("h").agg(F.min("lang").alias("lang"), F.first("counts").alias("counts"))
    start = start.sort("h").collect()
    if not start:  # a draw can miss all of a few texts
        start = found.groupBy("h").agg(F.min("lang").alias("lang"), F.first("counts").alias("counts")).orderBy("h").limit(1).collect()
    x = units(pa.array([bytes(r.counts) for r in start], pa.binary()), width) - np.array([topics.means[r.lang] for r in start])
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), 1)]
    while len(centres) < min(count, len(x)):
        far = 1 - (x @ centres.T).max(axis=1)
        far = np.maximum(far, 1e-12)
        centres = np.vstack([centres, x[rng.choice(len(x), p=far / far.sum())]])
    for _ in range(rounds):
        now = Topics(width, topics.means, centres)

        def by_centre(totals, batch):
            if batch.num_rows:
                langs, own = batch.column("lang").to_pylist(), units(batch.column("counts"), width)
                collect(totals, now.assign(own, langs).tolist(), own - np.array([now.means[g] for g in langs]))

        sums = cell_sums(found, "long", by_centre)
        new = np.array([dense(sums[k][1]) if k in sums else centres[k] for k in range(len(centres))])
        new /= np.maximum(np.linalg.norm(new, axis=1, keepdims=True), 1e-300)
        if np.array_equal(new, centres):
            break
        centres = new
    topics.centres = centres
    return topics


def topic_and_tokens(topics: Topics, spark: SparkSession, text: Column, lang: Column) -> Column:
    """``(topic, tokens)`` of a text: its cluster and the number of its words. Only the
    text and its language travel to Python."""
    shared = spark.sparkContext.broadcast(topics)

    def run(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        hashes = WordHashes()
        for pair in columns:
            at, size = [np.empty(0, np.int64)], []
            for part in rows([pa.RecordBatch.from_arrays(list(pair), ["text", "lang"])]):
                texts = byte_words(part)
                at.append(shared.value.assign(shared.value.vectors(texts, hashes), part.column("lang").to_pylist()))
                size += [len(w) for w in texts]
            yield pa.StructArray.from_arrays(
                [pa.array(np.concatenate(at), pa.int64()), pa.array(size, pa.int64())], ["topic", "tokens"])

    kind = T.StructType([T.StructField("topic", T.LongType()), T.StructField("tokens", T.LongType())])
    return F.arrow_udf(run, kind)(text, lang)


def cell_tokens(found: DataFrame, topics: Topics) -> DataFrame:
    """``(source, lang, topic, tokens)``: sums over the rows of ``word_counts``."""
    shared = found.sparkSession.sparkContext.broadcast(topics)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                at = shared.value.assign(units(batch.column("counts"), shared.value.width), batch.column("lang").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("source"), batch.column("lang"), pa.array(at, pa.int64()), batch.column("tokens")],
                    [*DIMENSIONS, "tokens"])

    kinds = dict(found.dtypes)
    marked = found.mapInArrow(run, f"source {kinds['source']}, lang {kinds['lang']}, topic long, tokens long")
    return marked.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens"))


def tempered(cells: pd.DataFrame, dimension: str, power: float) -> dict:
    """Target shares in proportion to the token sums raised to ``power``."""
    sums = cells.groupby(dimension, dropna=False)["tokens"].sum() ** power
    return dict(sums / sums.sum())


def rake(cells: pd.DataFrame, targets: dict[str, dict], budget: float, rounds: int = 500,
         tolerance: float = 1e-9) -> np.ndarray:
    """Weights of the cells, from 0 to 1, so that weighted tokens meet ``budget`` times
    the target share of each value of each dimension. Values without a target get
    none. Where weights reach 1 a target can stay short; the others are still met as
    far as the cells allow."""
    tokens = cells["tokens"].to_numpy(np.float64)
    weights = np.where(tokens > 0, budget / max(tokens.sum(), 1e-300), 0.0)
    groups = []
    for dimension, shares in targets.items():
        code, values = pd.factorize(cells[dimension], use_na_sentinel=False)
        names = [None if pd.isna(v) else v for v in values]
        known = {None if pd.isna(k) else k: v for k, v in shares.items()}
        groups.append((code, np.array([known.get(n, 0.0) for n in names]) * budget))
    for _ in range(rounds):
        before = weights.copy()
        for code, target in groups:
            sums = np.bincount(code, weights * tokens, len(target))
            weights = np.minimum(weights * (target / np.maximum(sums, 1e-300))[code], 1.0)
        if np.abs(weights - before).max(initial=0.0) < tolerance:
            break
    return weights


def mix(docs: DataFrame, source: str = "source", lang: str = "lang", id_col: str = "doc_id",
        budget_share: float = 0.6, powers: tuple[float, float, float] = (0.8, 0.9, 0.8),
        max_cells: int = 200_000, seed: int = 3, targets: dict[str, dict] | None = None) -> DataFrame:
    """``docs`` with ``topic``, ``n_tokens``, ``probability`` and ``kept`` added (columns
    of these names are replaced).

    ``targets`` gives the shares of the values of ``source``, ``lang`` or ``topic``; they
    are scaled to add up to one, and a value that is not named gets nothing. A dimension
    without targets keeps the corpus shares of its values, each raised to its power. The kept tokens are
    expected to be ``budget_share`` of all. A document is kept if a hash of its id and
    text falls below its probability, so a rerun keeps the same ones and equal rows go
    together. A null source or language is a value of its own; texts without a word have
    probability 0. The table of cells, one row for each combination of values, goes
    through the driver: more than ``max_cells`` is an error."""
    unknown = set(targets or {}) - set(DIMENSIONS)
    if unknown:
        raise ValueError(f"no such dimension: {sorted(unknown)}")
    own = ("topic", "n_tokens", "probability", "kept")
    docs = docs.select(*(c for c in docs.columns if c not in own))
    found = word_counts(docs, lang, source)
    topics = learn_topics(found)
    sums = materialise(cell_tokens(found, topics), "mixing-cells")
    count = sums.count()
    if count > max_cells:
        raise ValueError(f"{count} cells of source, language and topic; fold rare values first")
    cells = sums.toPandas().sort_values(list(DIMENSIONS), na_position="first").reset_index(drop=True)
    shares = {d: tempered(cells, d, p) for d, p in zip(DIMENSIONS, powers)}
    for dimension, given in (targets or {}).items():
        shares[dimension] = {value: weight / (sum(given.values()) or 1.0) for value, weight in given.items()}
    cells["probability"] = rake(cells, shares, budget_share * float(cells["tokens"].sum()))
    kinds = dict(sums.dtypes)
    table = docs.sparkSession.createDataFrame(
        [(None if pd.isna(s) else s, None if pd.isna(g) else g, int(t), float(p))
         for s, g, t, p in cells[[*DIMENSIONS, "probability"]].itertuples(index=False)],
        f"s {kinds['source']}, l {kinds['lang']}, t long, p double")
    # The document is one column, so that no name of its own meets one of ours.
    row = docs.select(F.struct(*docs.columns).alias("row"))
    text, of_source, of_lang = (F.col(f"row.`{c}`") for c in ("text", source, lang))
    marked = row.withColumn("found", topic_and_tokens(topics, docs.sparkSession, text, of_lang))
    draw = F.pmod(F.xxhash64(F.col(f"row.`{id_col}`"), text, F.lit(seed)), F.lit(1 << 53)) / float(1 << 53)
    same = of_source.eqNullSafe(F.col("s")) & of_lang.eqNullSafe(F.col("l")) & (F.col("found.topic") == F.col("t"))
    # The cells number max_cells at most, which was checked.
    joined = marked.join(F.broadcast(table), same, "left")
    probability = F.when(F.col("found.tokens") > 0, F.coalesce("p", F.lit(0.0))).otherwise(0.0)
    return joined.select(*(F.col(f"row.`{c}`") for c in docs.columns), F.col("found.topic").alias("topic"),
                         F.col("found.tokens").alias("n_tokens"), probability.alias("probability"),
                         (draw < probability).alias("kept"))
