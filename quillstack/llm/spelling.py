"""Grouping of spelling variants: kd-trees over letter counts.

One replaced letter lowers one count and raises another, one more letter raises one, so
near words lie within a city-block distance of two in the space of letter counts. Words
of one length are dealt into the cells of a kd-tree; every word visits the cells of its
own length and of the next shorter one whose box it can reach, and there the tree of the
visitors meets the tree of the cell. Of the leaf pairs that the boxes leave, those words
at the right distance (a matrix product) are compared letter by letter.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstack.llm.common import rows
from quillstack.llm.vector_codes import BoxTree
from quillstack.session import materialise

#: Letters a-z have a dimension each, others share 64 by code point; U+00C0 to U+00FF
#: take one each of those.
DIMENSIONS = 26 + 64
CELL_WORDS = 16_384
MAX_DEPTH = 12
LEAF = 128
SAMPLE = 200
COUNTED_AT_ONCE = 400_000
PAIRS_AT_ONCE = 1 << 22
ABROAD, AT_HOME = 1, 2

_CONTINUED = bytes(range(0x80, 0xC0))
_FOREIGN = re.compile(rb"[\xc2\xc4-\xf4][\x80-\xbf]*")
_LETTERS = bytes(
    c | 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c == 0xC3 or 0x80 <= c < 0xC0 else 32 for c in range(256))


def letter_runs(text: str | None) -> list[bytes]:
    """Maximal runs of A-Z, a-z and U+00C0 to U+00FF, A-Z in lower case, as UTF-8. Those
    above a-z are the characters that begin with the byte C3."""
    raw = text.encode() if text else b""
    if not raw.isascii() and len(raw) - len(raw.translate(None, _CONTINUED)) != raw.count(b"\xc3"):
        raw = _FOREIGN.sub(b" ", raw)
    return raw.translate(_LETTERS).split()


def typo(word: bytes, h: int) -> bytes:
    """The run without its code point ``h`` modulo its length."""
    letters = word.decode()
    at = h % len(letters)
    return (letters[:at] + letters[at + 1:]).encode()


def counted_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", modulus: int | None = 199,
                  min_length: int = 6, min_count: int = 5) -> DataFrame:
    """``(word, n)``: the letter runs of all texts and how often they occur in all, those
    of ``min_length`` code points and ``min_count`` occurrences or more.

    With ``modulus``, runs whose crc32 together with the id is divisible by it lose a
    letter in that document. A null id is written as an empty text, a null text has no
    run, and repeated rows count as often as they are there."""
    picked = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))

    def run(batches):
        total: Counter = Counter()

        def sums():
            found = [(w.decode(), n) for w, n in total.items() if n and len(w) - w.count(b"\xc3") >= min_length]
            total.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array([w for w, _ in found], pa.string()), pa.array([n for _, n in found], pa.int64())], ["word", "n"])

        for part in rows(batches):
            for key, text in zip(part.column("id").to_pylist(), part.column("text").to_pylist()):
                words = letter_runs(text)
                total.update(words)
                if modulus is None:
                    continue
                start = zlib.crc32(f"{key or ''}:".encode())
                for word in set(words):
                    h = zlib.crc32(word, start)
                    if h % modulus == 0:
                        n = words.count(word)
                        total[word] -= n
                        total[typo(word, h)] += n
            if len(total) > COUNTED_AT_ONCE:
                yield sums()
        yield sums()

    found = picked.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return found.filter(F.col("n") >= min_count)


def codes_of(words: list[str], length: int) -> np.ndarray:
    """Code points of words of one length, one row a word."""
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), length)
    return codes.astype(np.uint8) if not len(codes) or codes.max() < 256 else codes


def letter_counts(codes: np.ndarray) -> np.ndarray:
    place = codes.astype(np.int64)
    place = np.where((place >= 97) & (place <= 122), place - 97, 26 + (place & 63))
    flat = place + (np.arange(len(place)) * DIMENSIONS)[:, None]
    found = np.bincount(flat.ravel(), minlength=len(place) * DIMENSIONS).reshape(len(place), DIMENSIONS)
    return found.astype(np.int16 if place.shape[1] < 1 << 15 else np.int64)


def fits(low, high, box_low, box_high, more: int, less: int) -> np.ndarray:
    """Whether a point of the second box can have at most ``more`` letters more and
    ``less`` letters less than one of the first, row by row."""
    up = np.maximum(box_low - high, 0).sum(axis=1)
    down = np.maximum(low - box_high, 0).sum(axis=1)
    return (up <= more) & (down <= less)


class CellTree:
    """Cells of the words of one length: a kd-tree split near medians of a sample. The
    boxes cover all counts, so the sample decides only how even the cells are."""

    def __init__(self, sample: np.ndarray, depth: int, length: int):
        low = np.zeros((1, DIMENSIONS), np.int64)
        high = np.full((1, DIMENSIONS), length, np.int64)
        self.splits, self.low, self.high = [], [low], [high]
        node = np.zeros(len(sample), np.int64)
        for level in range(depth):
            split = np.array([self._split(sample[node == k]) for k in range(1 << level)])
            low, high = np.repeat(self.low[-1], 2, axis=0), np.repeat(self.high[-1], 2, axis=0)
            left = np.arange(1 << level) * 2
            high[left, split[:, 0]] = np.minimum(high[left, split[:, 0]], split[:, 1])
            low[left + 1, split[:, 0]] = np.maximum(low[left + 1, split[:, 0]], split[:, 1] + 1)
            self.splits.append(split)
            self.low.append(low)
            self.high.append(high)
            node = self._down(node, sample, split)

    @staticmethod
    def _split(points: np.ndarray) -> tuple[int, int]:
        """Dimension and greatest count of the lower side that halve the points best."""
        if not len(points):
            return 0, 0
        middle = np.median(points, axis=0).astype(np.int64)
        choices = [(abs(int((points[:, d] <= t).sum()) * 2 - len(points)), d, int(t))
                   for d in range(points.shape[1]) for t in (middle[d] - 1, middle[d]) if t >= 0]
        return min(choices)[1:]

    @staticmethod
    def _down(node, counts, split):
        dimension, most = split[node, 0], split[node, 1]
        return 2 * node + (counts[np.arange(len(counts)), dimension] > most)

    def own(self, counts: np.ndarray) -> np.ndarray:
        node = np.zeros(len(counts), np.int64)
        for split in self.splits:
            node = self._down(node, counts, split)
        return node

    def reached(self, counts: np.ndarray, more: int, less: int) -> tuple[np.ndarray, np.ndarray]:
        """(word, cell) of all cells that can hold a word with so many letters more and less."""
        words, cells = [], []
        for start in range(0, len(counts), 2_000):
            some = counts[start:start + 2_000]
            word, node = np.arange(len(some)), np.zeros(len(some), np.int64)
            for low, high in zip(self.low[1:], self.high[1:]):
                word, node = np.repeat(word, 2), (2 * node[:, None] + np.arange(2)).ravel()
                keep = fits(some[word], some[word], low[node], high[node], more, less)
                word, node = word[keep], node[keep]
            words.append(word + start)
            cells.append(node)
        return np.concatenate(words), np.concatenate(cells)


def cell_trees(words: DataFrame) -> dict[int, CellTree]:
    """A tree for each length with more than CELL_WORDS words. The sample of at most
    SAMPLE words a cell steers only where words are compared."""
    sizes = {r["length"]: r["n"] for r in
             words.groupBy("length").agg(F.count("*").alias("n")).filter(F.col("n") > CELL_WORDS).collect()}
    depths = {length: min(MAX_DEPTH, math.ceil(math.log2(n / CELL_WORDS))) for length, n in sizes.items()}
    if not sizes:
        return {}
    share = F.create_map(*(F.lit(x) for length, n in sizes.items()
                           for x in (length, min(1.0, SAMPLE * (1 << depths[length]) / n))))
    draw = F.pmod(F.xxhash64("word"), F.lit(1 << 30)) / float(1 << 30)
    drawn = words.filter(F.col("length").isin(list(sizes))).filter(draw < share[F.col("length")])
    found: dict[int, list[str]] = {length: [] for length in sizes}
    for r in drawn.select("length", "word").collect():
        found[r["length"]].append(r["word"])
    return {length: CellTree(letter_counts(codes_of(sorted(some), length)), depths[length], length)
            for length, some in found.items()}


def _by_length(batch: pa.RecordBatch):
    """(rows, words, counts) of each length in the batch."""
    words, lengths = batch.column("word").to_pylist(), np.asarray(batch.column("length"))
    for length in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == length)
        some = [words[k] for k in at]
        step = max(1, PAIRS_AT_ONCE // length)
        for start in range(0, len(some), step):
            yield length, at[start:start + step], letter_counts(codes_of(some[start:start + step], length))


def dealt(words: DataFrame, trees: dict[int, CellTree]) -> DataFrame:
    """(length, cell, part, visits, word, n): each word once in its own cell (``visits``
    0) and as a visitor of the cells it can reach (ABROAD, or AT_HOME in its own one). Of two cells of one length the later one is
    visited, so that a pair meets once. A cell with too many words is split in parts,
    all of which are visited."""
    shared = words.sparkSession.sparkContext.broadcast(trees)

    def own(batches):
        for batch in batches:
            for length, at, counts in _by_length(batch):
                tree = shared.value.get(length)
                cell = tree.own(counts) if tree else np.zeros(len(at), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([length] * len(at), pa.int32()), pa.array(cell, pa.int64())], ["length", "cell"])

    crowded = words.select("word", "length").mapInArrow(own, "length int, cell long").groupBy("length", "cell").agg(
        F.count("*").alias("n")).filter(F.col("n") > 2 * CELL_WORDS).collect()
    parts = words.sparkSession.sparkContext.broadcast(
        {(r["length"], r["cell"]): -(-r["n"] // CELL_WORDS) for r in crowded})

    def deal(batches):
        for batch in batches:
            for length, at, counts in _by_length(batch):
                tree, shorter = shared.value.get(length), shared.value.get(length - 1)
                rows_, lengths, cells, pieces, visits = [], [], [], [], []

                def add(word, cell, size, visit):
                    times = np.array([parts.value.get((size, c), 1) for c in cell.tolist()], np.int64)
                    if visit.any():  # every part of the cell
                        inner = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                        word, cell, visit = (np.repeat(x, times) for x in (word, cell, visit))
                    else:
                        inner = at[word] % times
                    rows_.append(at[word])
                    lengths.append(np.full(len(word), size))
                    cells.append(cell)
                    pieces.append(inner)
                    visits.append(visit)

                everyone = np.arange(len(at))
                home = tree.own(counts) if tree else np.zeros(len(at), np.int64)
                add(everyone, home, length, np.zeros(len(at), np.int64))
                word, cell = tree.reached(counts, 1, 1) if tree else (everyone, home)
                later = cell >= home[word]
                word, cell = word[later], cell[later]
                add(word, cell, length, np.where(cell == home[word], AT_HOME, ABROAD))
                word, cell = shorter.reached(counts, 0, 1) if shorter else (everyone, np.zeros(len(at), np.int64))
                add(word, cell, length - 1, np.full(len(word), ABROAD))
                taken = batch.select(["word", "n"]).take(pa.array(np.concatenate(rows_)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(lengths), pa.int32()), pa.array(np.concatenate(cells), pa.int64()),
                     pa.array(np.concatenate(pieces), pa.int32()), pa.array(np.concatenate(visits), pa.int32()),
                     taken.column("word"), taken.column("n")], ["length", "cell", "part", "visits", "word", "n"])

    return words.mapInArrow(deal, "length int, cell long, part int, visits int, word string, n long")


def leaf_pairs(visitors: BoxTree, cell: BoxTree, more: int, less: int) -> tuple[np.ndarray, np.ndarray]:
    """Leaves of the two trees whose boxes can hold words so far apart."""
    one, two, a, b = np.zeros(1, np.int64), np.zeros(1, np.int64), 0, 0
    while a < visitors.depth or b < cell.depth:
        if a < visitors.depth:
            one, two, a = (2 * one[:, None] + np.arange(2)).ravel(), np.repeat(two, 2), a + 1
        if b < cell.depth:
            one, two, b = np.repeat(one, 2), (2 * two[:, None] + np.arange(2)).ravel(), b + 1
        keep = np.concatenate([
            fits(visitors.low[a][x], visitors.high[a][x], cell.low[b][y], cell.high[b][y], more, less)
            for x, y in ((one[s:s + 50_000], two[s:s + 50_000]) for s in range(0, max(len(one), 1), 50_000))])
        one, two = one[keep], two[keep]
    order = np.argsort(one, kind="stable")
    return one[order], two[order]


def one_replaced(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a != b).sum(axis=1) == 1


def one_longer(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether ``a`` is ``b`` with one letter more: what follows the first difference
    must agree with ``b`` from there on."""
    size = b.shape[1]
    same, shifted = a[:, :-1] == b, a[:, 1:] == b
    first = np.where(same.all(axis=1), size, np.argmin(same, axis=1))
    last = np.where(shifted.all(axis=1), 0, size - np.argmin(shifted[:, ::-1], axis=1))
    return last <= first


class Cell:
    """The words of one cell (or of a part of it), in a tree over their letter counts."""

    def __init__(self, words: list[str], n: np.ndarray, length: int):
        codes = codes_of(words, length)
        self.tree = BoxTree(letter_counts(codes), LEAF)
        self.words = [words[k] for k in self.tree.order]
        self.n, self.codes, self.length = n[self.tree.order], codes[self.tree.order], length
        kind = np.float32 if length < 4_000 else np.float64
        points = self.tree.points.astype(kind)
        self.met = np.flatnonzero(points.any(axis=0))
        self.points, self.norms = points[:, self.met], (points * points).sum(axis=1)

    def near(self, other: Cell) -> tuple[np.ndarray, np.ndarray]:
        """(place here, place in ``other``) of near words; ``other`` holds words of the same
        length or of one letter more."""
        longer = other.length - self.length
        one, two = leaf_pairs(other.tree, self.tree, 0 if longer else 1, 1)
        mine, theirs = self.tree.edges(self.tree.depth), other.tree.edges(other.tree.depth)
        # Letters that share a dimension may replace each other without any distance.
        folded = not longer and (self.codes.dtype != np.uint8 or other.codes.dtype != np.uint8)
        edges = np.flatnonzero(np.concatenate([[True], one[1:] != one[:-1], [True]])) if len(one) else np.zeros(1, np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for s, e in zip(edges[:-1], edges[1:]):
            low, high = theirs[one[s]], theirs[one[s] + 1]
            at = np.concatenate([np.arange(mine[k], mine[k + 1]) for k in two[s:e]])
            some = other.tree.points[low:high].astype(self.points.dtype)
            apart = (some * some).sum(axis=1)[:, None] + self.norms[at] - 2 * (some[:, self.met] @ self.points[at].T)
            hit = apart == (1 if longer else 2)
            if folded:
                hit |= apart == 0
            x, y = np.nonzero(hit)
            x, y = x + low, at[y]
            step = max(1, PAIRS_AT_ONCE // other.length)
            for k in range(0, len(x), step):
                a, b = x[k:k + step], y[k:k + step]
                keep = (one_longer if longer else one_replaced)(other.codes[a], self.codes[b])
                found.append((b[keep], a[keep]))
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*found))


def _summary(at: np.ndarray, words: list[str], near: np.ndarray, near_words: list[str], near_n: np.ndarray):
    """(word, n_near, best, best_n) of each word met: number of near words and the one
    of largest n, of which the smallest."""
    order = sorted(range(len(near_words)), key=lambda k: (-near_n[k], near_words[k]))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    best = np.full(len(words), len(order), np.int64)
    np.minimum.at(best, at, rank[near])
    times = np.bincount(at, minlength=len(words))
    met = np.flatnonzero(times)
    chosen = [order[k] for k in best[met]]
    return pa.RecordBatch.from_arrays(
        [pa.array([words[k] for k in met], pa.string()), pa.array(times[met], pa.int64()),
         pa.array([near_words[k] for k in chosen], pa.string()), pa.array(near_n[chosen], pa.int64())],
        ["word", "n_near", "best", "best_n"])


def near_words(words: DataFrame) -> DataFrame:
    """``(word, n_near, best, best_n)`` of the words with a near word, for ``(word, n)``
    with distinct words. The words of a cell come before its visitors, which pass in
    batches, so a task holds one cell at a time."""
    sized = materialise(words.withColumn("length", F.length("word")), "spelling-words")
    trees = cell_trees(sized)
    placed = dealt(sized, trees)
    key = ("length", "cell", "part")
    context = words.sparkSession.sparkContext
    cells = sum(len(t.low[-1]) for t in trees.values())
    # Not left to the size of the rows: little data here is much work.
    tasks = min(1 << MAX_DEPTH, max(2 * cells, 2 * context.defaultParallelism))
    ordered = placed.repartition(tasks, *key).sortWithinPartitions(*key, "visits")

    def run(batches):
        now, cell, held, counts = None, None, [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            names, numbers = batch.column("word").to_pylist(), np.asarray(batch.column("n"))
            marks = np.stack([np.asarray(batch.column(c)).astype(np.int64) for c in key])
            visiting = np.asarray(batch.column("visits"))
            same = np.vstack([marks, visiting])
            edges = np.flatnonzero(np.concatenate([[True], (same[:, 1:] != same[:, :-1]).any(axis=0), [True]]))
            for s, e in zip(edges[:-1], edges[1:]):
                if now is None or (marks[:, s] != now).any():
                    now, cell, held, counts = marks[:, s], None, [], []
                if not visiting[s]:
                    held += names[s:e]
                    counts.append(numbers[s:e])
                    continue
                if not held:  # no word has this length
                    continue
                if cell is None:
                    cell = Cell(held, np.concatenate(counts), int(now[0]))
                yield from met(cell, names[s:e], numbers[s:e], visiting[s] == AT_HOME)

    def met(cell, names, numbers, at_home):
        lengths = np.fromiter(map(len, names), np.int64, len(names))
        for length in (cell.length, cell.length + 1):
            at = np.flatnonzero(lengths == length)
            if not len(at):
                continue
            other = Cell([names[k] for k in at], numbers[at], length)
            a, b = cell.near(other)
            if at_home and len(a):  # such a pair is met from both sides
                keep = np.array([cell.words[x] < other.words[y] for x, y in zip(a.tolist(), b.tolist())])
                a, b = a[keep], b[keep]
            if len(a):
                yield _summary(a, cell.words, b, other.words, other.n)
                yield _summary(b, other.words, a, cell.words, cell.n)

    return ordered.mapInArrow(run, "word string, n_near long, best string, best_n long")


def group_variants(words: DataFrame, factor: int = 5) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` for ``(word, n)`` with distinct words.

    Near words differ by exactly one letter put in, left out or replaced. The form is the
    near word of largest n (the smallest of those), if that is ``factor`` times the
    word's own n or more, else null; the root is where the forms lead, the word itself
    without a form. A word that is null or empty is left out. From word to form n grows by ``factor``
    at least, so the number of rounds that follow forms twice as far each is known."""
    if factor < 2:
        raise ValueError("a form must be more frequent by a factor of 2 at least")
    words = materialise(words.filter("word <> ''").select("word", "n"), "spelling-counts")
    c = F.col
    best = F.min_by(F.struct("best", "best_n"), F.struct((-c("best_n")).alias("n"), "best"))
    near = near_words(words).groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b"))
    found = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(c("b.best_n") >= factor * c("n"), c("b")).alias("b"))
    formed = materialise(found.select("word", c("b.best").alias("form"), "n", "n_near", c("b.best_n").alias("form_n")),
                         "spelling-forms")
    most = formed.agg(F.max("n")).first()[0] or 1
    roots = formed.filter("form IS NOT NULL").select("word", c("form").alias("root"))
    for _ in range(math.ceil(math.log2(1 + math.log(max(most, 1), factor)))):
        further = roots.select(c("word").alias("root"), c("root").alias("beyond"))
        roots = materialise(
            roots.join(further, "root", "left").select("word", F.coalesce("beyond", "root").alias("root")), "spelling-roots")
    return formed.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
