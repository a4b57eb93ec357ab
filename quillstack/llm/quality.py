"""Quality scores: supervised embeddings of hashed words and character n-grams.

A document is the mean of the learned vectors of its words, its word pairs and the
character n-grams of its words (edges of words count as a space), each hashed to one
of ``2 ** BITS`` rows of a table; a softmax over the classes follows. The table is
trained by stochastic gradient descent in numpy: in every round each shard of the
sample takes its steps from the same parameters in a task of its own, and the shards'
moves of a row are averaged over the shards that moved it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstack.llm.common import WordHashes, rows, sequence_hashes
from quillstack.session import materialise

BITS = 16
SIZES = (3, 4, 5)
SHARDS = 16
DIMENSIONS = 8
SLICE = 1 << 18
WORDS_AT_ONCE = 1 << 15
_SHIFT = np.uint64(64 - BITS)
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
#: All pairs of a word and itself share one row.
SAME_PAIR = 0


def _rows(codes: np.ndarray) -> np.ndarray:
    """The table row of each 64-bit value: the upper bits of a product."""
    with np.errstate(over="ignore"):
        return (codes * _FACTOR >> _SHIFT).view(np.int64)


def _character_places(joined: np.ndarray) -> Iterator[np.ndarray]:
    """Table rows of the n-grams of bytes that hold no space but at their ends."""
    with np.errstate(over="ignore"):
        for start in range(0, len(joined), SLICE):
            block = joined[start:start + SLICE + max(SIZES) - 1]
            spaces = np.concatenate([[0], np.cumsum(block == 32)])
            value = block.astype(np.uint64)
            code = value.copy()
            for n in range(2, max(SIZES) + 1):
                code = code[:-1] * _FACTOR + value[n - 1:]
                if n in SIZES and len(code):
                    inner = spaces[n - 1:len(block)] - spaces[1:len(block) - n + 2]
                    fit = inner == 0
                    fit[SLICE:] = False  # those begin in the next slice
                    yield _rows(code[fit] + np.uint64(n))


def places(text: str | None, hashes: WordHashes) -> Iterator[np.ndarray]:
    """Table rows of everything that counts in a text, in pieces of bounded size."""
    words = text.encode("utf-8", "surrogatepass").split() if text else []
    before = np.empty(0, np.uint64)
    for start in range(0, len(words), WORDS_AT_ONCE):
        part = words[start:start + WORDS_AT_ONCE]
        found = hashes.of(part)
        yield _rows(found)
        linked = np.concatenate([before, found])
        yield np.where(linked[1:] == linked[:-1], SAME_PAIR, _rows(sequence_hashes(linked, 2)))
        before = found[-1:]
        yield from _character_places(np.frombuffer(b" " + b" ".join(part) + b" ", np.uint8))


def counts(text: str | None, hashes: WordHashes) -> np.ndarray:
    """How often each table row is met in the text."""
    total = np.zeros(1 << BITS, np.int64)
    for found in places(text, hashes):
        total += np.bincount(found, minlength=1 << BITS)
    return total


def class_scores(text: str | None, by_row: np.ndarray, hashes: WordHashes) -> np.ndarray:
    """Weights times the mean vector, relative to the first class. ``by_row`` holds that
    product for each row of the table, so that the rows of a text need not be added up
    in all dimensions."""
    total, n = np.zeros(len(by_row) + 1), 0
    for found in places(text, hashes):
        total[1:] += [scores.take(found).sum(dtype=np.float64) for scores in by_row]
        n += len(found)
    return total / max(n, 1)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max())
    return e / e.sum()


class Parameters:
    """Vectors of the table rows, weights (classes x dimensions) and offsets of classes."""

    def __init__(self, table: np.ndarray, weights: np.ndarray, offsets: np.ndarray):
        self.table, self.weights, self.offsets = table, weights, offsets

    @staticmethod
    def start(classes: int, dimensions: int, seed: int) -> Parameters:
        """Empty vectors, so that what training never met weighs nothing."""
        drawn = np.random.default_rng(seed).normal(size=(classes, dimensions))
        return Parameters(np.zeros((1 << BITS, dimensions), np.float32), drawn, np.zeros(classes))

    def copy(self) -> Parameters:
        return Parameters(self.table.copy(), self.weights.copy(), self.offsets.copy())

    def step(self, ids: np.ndarray, share: np.ndarray, label: int, rate: float) -> None:
        """One document. The move of the vectors is scaled so that the mean itself
        moves by ``rate`` times its gradient, however many rows make it up."""
        hidden = (share[:, None] * self.table[ids]).sum(axis=0)
        error = softmax(self.weights @ hidden + self.offsets)
        error[label] -= 1
        back = error @ self.weights
        self.weights -= rate * np.outer(error, hidden)
        self.offsets -= 0.1 * rate * error
        if len(ids):
            self.table[ids] -= np.outer(share * (rate / np.square(share).sum()), back).astype(np.float32)


def _passes(start: Parameters, table: pa.Table, rates: list[float]) -> tuple[Parameters, np.ndarray]:
    """The moves of some passes over a shard in the order of ``draw``, and the rows moved."""
    now, moved = start.copy(), np.zeros(1 << BITS, bool)
    table = table.sort_by("draw")
    for rate in rates:
        for ids, share, label in zip(table.column("ids"), table.column("share"), table.column("label").to_pylist()):
            ids = np.frombuffer(ids.as_py(), np.uint16).astype(np.int64)
            now.step(ids, np.frombuffer(share.as_py(), np.float32), label, rate)
            moved[ids] = True
    return Parameters(now.table - start.table, now.weights - start.weights, now.offsets - start.offsets), moved


def _numbered(docs: DataFrame) -> DataFrame:
    """(shard, draw, label, ids, share): the table rows of each text and their shares, as bytes."""
    def run(batches):
        hashes = WordHashes()
        for part in rows(batches, limit=1 << 18):
            ids, share = [], []
            for text in part.column("text").to_pylist():
                found = counts(text, hashes)
                at = np.flatnonzero(found)
                ids.append(at.astype(np.uint16).tobytes())
                share.append((found[at] / max(found.sum(), 1)).astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays(
                [part.column("shard"), part.column("draw"), part.column("label"),
                 pa.array(ids, pa.binary()), pa.array(share, pa.binary())],
                ["shard", "draw", "label", "ids", "share"])

    return docs.mapInArrow(run, "shard int, draw long, label int, ids binary, share binary")


class QualityModel:
    """The classes and their parameters; a constant where there is one class or none."""

    def __init__(self, classes: list, parameters: Parameters | None = None):
        self.classes, self.parameters = classes, parameters

    def score(self, docs: DataFrame, of, text_col: str = "text", name: str = "score") -> DataFrame:
        """``docs`` without the text and with ``name``, the probability of class ``of``, between 0 and 1, for
        every row. A null, empty or wordless text has the probability of the offsets
        alone. A column of that name is replaced; no other column is looked at."""
        others = [c for c in docs.columns if c not in (text_col, name)]
        if self.parameters is None or of not in self.classes:
            return docs.select(*(docs[c] for c in others), F.lit(float(self.classes == [of])).alias(name))
        weights = self.parameters.weights[1:] - self.parameters.weights[0]
        by_row = np.ascontiguousarray((weights @ self.parameters.table.T).astype(np.float32))
        shared = docs.sparkSession.sparkContext.broadcast((by_row, self.parameters.offsets))
        place = self.classes.index(of)

        def run(batches):
            by_row, offsets = shared.value
            hashes = WordHashes()
            for part in rows(batches, "text"):
                found = [float(softmax(class_scores(t, by_row, hashes) + offsets)[place])
                         for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(found, pa.float64())], ["row", "score"])

        # An empty struct cannot travel, so a table of texts alone has a place holder.
        kept = F.struct(*(docs[c] for c in others)) if others else F.struct(F.lit(0).alias("_"))
        picked = docs.select(kept.alias("row"), docs[text_col].alias("text"))
        kind = picked.schema["row"].dataType.simpleString()
        scored = picked.mapInArrow(run, f"row {kind}, score double")
        return scored.select(*(F.col(f"row.`{c}`") for c in others), F.col("score").alias(name))


def train(labelled: DataFrame, text: Column, label: Column, sample: int = 8_000, rounds: int = 3,
          passes: int = 3, rate: float = 0.3, dimensions: int = DIMENSIONS, seed: int = 7) -> QualityModel:
    """A model of the rows with a label.

    Fitted on about ``sample`` rows at most, chosen by a hash of the text. Each of the
    SHARDS tasks holds the counted table rows of its share, a bounded number, and passes
    over them ``passes`` times a round; what reaches the driver then is one table of
    moves a shard. Null texts count as empty ones. No labelled
    row gives a model without classes, one class a constant."""
    known = labelled.select(text.alias("text"), label.alias("label")).filter("label IS NOT NULL")
    totals = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    classes = sorted(totals)
    if len(classes) < 2:
        return QualityModel(classes)
    draw = F.xxhash64(F.coalesce("text", F.lit("")), F.lit(seed))
    limit = min(1.0, sample / sum(totals.values()))
    numbers = F.create_map(*(F.lit(x) for k, c in enumerate(classes) for x in (c, k)))
    chosen = (
        known.withColumn("draw", draw)
        .filter(F.pmod("draw", F.lit(1 << 30)) / float(1 << 30) < limit)
        .select(F.pmod(F.shiftright("draw", 40), F.lit(SHARDS)).cast("int").alias("shard"), "draw",
                numbers[F.col("label")].alias("label"), "text")
    )
    stored = materialise(_numbered(chosen), "quality-sample")
    now = Parameters.start(len(classes), dimensions, seed)
    context = labelled.sparkSession.sparkContext
    steps = [rate * (1 - k / (rounds * passes)) for k in range(rounds * passes)]
    for turn in range(rounds):
        rates = steps[turn * passes:(turn + 1) * passes]
        shared = context.broadcast((now.table, now.weights, now.offsets))

        def moves(table: pa.Table) -> pa.Table:
            move, moved = _passes(Parameters(*shared.value), table, rates)  # noqa: B023 (sent in this round)
            at = np.flatnonzero(moved)
            return pa.table({
                "rows": pa.array([at.astype(np.int32).tobytes()], pa.binary()),
                "vectors": pa.array([move.table[at].tobytes()], pa.binary()),
                "weights": pa.array([move.weights.tobytes()], pa.binary()),
                "offsets": pa.array([move.offsets.tobytes()], pa.binary())})

        found = stored.groupBy("shard").applyInArrow(
            moves, "rows binary, vectors binary, weights binary, offsets binary").collect()
        sums, times = np.zeros(now.table.shape), np.zeros(1 << BITS)
        for r in sorted(found, key=lambda r: r["weights"]):
            at = np.frombuffer(r["rows"], np.int32)
            sums[at] += np.frombuffer(r["vectors"], np.float32).reshape(len(at), dimensions)
            times[at] += 1
            now.weights = now.weights + np.frombuffer(r["weights"]).reshape(now.weights.shape) / len(found)
            now.offsets = now.offsets + np.frombuffer(r["offsets"]) / len(found)
        now.table = (now.table + sums / np.maximum(times, 1)[:, None]).astype(np.float32)
        shared.unpersist()
    return QualityModel(classes, now)
