"""Product codes of vectors by dual-tree Lloyd rounds on integers.

Vectors become integers and are cut into equal parts; every part position has its own
codebook. To assign the parts of a block of vectors, a kd-tree over the parts meets a
kd-tree over the entries: bounds on the distance between two boxes rule out node pairs,
a node with one entry left is assigned as a whole (its sum is a difference of cached
sums), and only the points of leaves that stay undecided are measured one by one, in
integers. Blocks are slices of a partition; what leaves a task is one sum per entry.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstack.llm.common import join_split
from quillstack.session import materialise

BLOCK_ROWS = 8_192
LEAF = 16
SCALE = 256.0
#: Integers are held within these bounds, so that no squared distance overflows.
LIMIT = 1 << 26


class BoxTree:
    """Points in kd-order: node i of level l holds the points n*i >> l to n*(i+1) >> l."""

    def __init__(self, points: np.ndarray, leaf: int):
        n = len(points)
        self.n, self.depth = n, max(0, (n // leaf).bit_length() - 1)
        self.order = np.arange(n)
        for level in range(self.depth):
            edges = self.edges(level)
            placed = points[self.order]
            low, high = self._boxes(placed, edges)
            widest = np.repeat(np.argmax(high - low, axis=1), np.diff(edges))
            node = np.repeat(np.arange(1 << level), np.diff(edges))
            self.order = self.order[np.lexsort((placed[np.arange(n), widest], node))]
        self.points = points[self.order]
        low, high = self._boxes(self.points, self.edges(self.depth))
        self.low, self.high = [low], [high]
        for _ in range(self.depth):
            self.low.insert(0, np.minimum(self.low[0][::2], self.low[0][1::2]))
            self.high.insert(0, np.maximum(self.high[0][::2], self.high[0][1::2]))

    @staticmethod
    def _boxes(points: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.minimum.reduceat(points, edges[:-1]), np.maximum.reduceat(points, edges[:-1])

    def edges(self, level: int) -> np.ndarray:
        return (np.arange((1 << level) + 1) * self.n) >> level


def _halves(nodes: np.ndarray) -> np.ndarray:
    return (2 * nodes[:, None] + np.arange(2)).ravel()


def _firsts(sorted_nodes: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], sorted_nodes[1:] != sorted_nodes[:-1]]))


def _within_bounds(node, low, high, entry_low, entry_high) -> np.ndarray:
    """Which pairs of boxes, sorted by node, can hold a nearest entry: those whose least
    distance does not exceed the smallest of the node's greatest distances."""
    gap = np.maximum(np.maximum(entry_low - high, low - entry_high), 0)
    reach = np.maximum(np.abs(high - entry_low), np.abs(entry_high - low))
    firsts = _firsts(node)
    best = np.minimum.reduceat((reach * reach).sum(axis=1), firsts)
    return (gap * gap).sum(axis=1) <= np.repeat(best, np.diff(np.append(firsts, len(node))))


def _not_beaten(node, low, high, entry, entries) -> np.ndarray:
    """Which single entries are nearest somewhere in the box, compared with the entry
    nearest to the middle of the box; on equal distance the lower index wins."""
    firsts = _firsts(node)
    sizes = np.diff(np.append(firsts, len(node)))
    middle = low + high - 2 * entries[entry]
    rank = np.lexsort((entry, (middle * middle).sum(axis=1), node))
    leader = np.repeat(entry[rank[firsts]], sizes)
    apart = entries[leader] - entries[entry]
    lead = (entries[leader] ** 2).sum(axis=1) - (entries[entry] ** 2).sum(axis=1)
    # The most by which a point of the box can be nearer to the entry than to the leader.
    most = lead - 2 * (np.where(apart > 0, low, high) * apart).sum(axis=1)
    return (entry == leader) | (most > 0) | ((most == 0) & (entry < leader))


def assign(tree: BoxTree, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nearest entry of each point (in tree order; ties to the lower index), and the
    number and the sum of the points of each entry."""
    ends = np.concatenate([np.zeros((1, tree.points.shape[1]), np.int64), np.cumsum(tree.points, axis=0)])
    found = np.empty(tree.n, np.int64)
    counts, sums = np.zeros(len(entries), np.int64), np.zeros(entries.shape, np.int64)
    other = BoxTree(entries, 1)
    node, entry, level = np.zeros(1, np.int64), np.zeros(1, np.int64), 0

    def descend(node, entry, level):
        if level == tree.depth:
            return node, entry, level
        node, entry = _halves(node), np.repeat(entry, 2)
        order = np.argsort(node, kind="stable")
        return node[order], entry[order], level + 1

    for depth in range(1, other.depth + 1):
        node, entry, level = descend(node, entry, level)
        node, entry = np.repeat(node, 2), _halves(entry)
        keep = _within_bounds(node, tree.low[level][node], tree.high[level][node],
                              other.low[depth][entry], other.high[depth][entry])
        node, entry = node[keep], entry[keep]
    edges = other.edges(other.depth)
    sizes = np.diff(edges)[entry]
    inner = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    node, entry = np.repeat(node, sizes), other.order[np.repeat(edges[entry], sizes) + inner]
    while len(node):
        low, high, at = tree.low[level][node], tree.high[level][node], entries[entry]
        keep = np.flatnonzero(_within_bounds(node, low, high, at, at))
        keep = keep[_not_beaten(node[keep], low[keep], high[keep], entry[keep], entries)]
        node, entry = node[keep], entry[keep]
        firsts = _firsts(node)
        sizes = np.diff(np.append(firsts, len(node)))
        edges = tree.edges(level)
        alone = firsts[sizes == 1]
        start, end = edges[node[alone]], edges[node[alone] + 1]
        np.add.at(counts, entry[alone], end - start)
        np.add.at(sums, entry[alone], ends[end] - ends[start])
        for s, e, best in zip(start.tolist(), end.tolist(), entry[alone].tolist()):
            found[s:e] = best
        open_ = np.repeat(sizes > 1, sizes)
        node, entry = node[open_], entry[open_]
        if level == tree.depth:
            break
        node, entry, level = descend(node, entry, level)
    if len(node):
        edges = tree.edges(level)
        width = (edges[1:] - edges[:-1])[node]
        inner = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
        point, candidate = np.repeat(edges[node], width) + inner, np.repeat(entry, width)
        apart = tree.points[point] - entries[candidate]
        order = np.lexsort((candidate, (apart * apart).sum(axis=1), point))
        best = order[_firsts(point[order])]
        found[point[best]] = candidate[best]
        np.add.at(counts, candidate[best], 1)
        np.add.at(sums, candidate[best], tree.points[point[best]])
    return found, counts, sums


@dataclass(frozen=True)
class Codebooks:
    """``entries`` of shape (parts, entries of a codebook, components of a part)."""

    entries: np.ndarray

    def sha256(self) -> str:
        """Digest of all components in decimal, by part, entry and place."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int32).reshape(len(column), -1).astype(np.int64)


def _slices(batches):
    for batch in batches:
        for start in range(0, batch.num_rows, BLOCK_ROWS):
            yield batch.slice(start, BLOCK_ROWS)


def integers(vectors: DataFrame, vector: str, keep: list[str], parts: int, scale: float) -> DataFrame:
    """(row, ints): the kept columns as a struct, and floor(scale * x) of each component
    as 32-bit integers, for the rows whose vector is not null and holds only finite numbers.

    Shorter vectors end in zeros, up to the longest one and a multiple of ``parts``;
    integers beyond LIMIT count as LIMIT."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    kept = vectors.filter(F.col(vector).isNotNull()).filter(~F.coalesce(bad, F.lit(True)))
    longest = kept.agg(F.max(F.size(vector))).first()[0] or 0
    width = max(-(-longest // parts), 1) * parts
    picked = kept.select(F.struct(*keep).alias("row"), F.col(vector).cast("array<double>").alias("vector"))

    def run(batches):
        for part in _slices(batches):
            column = part.column("vector")
            sizes = np.diff(column.offsets.to_numpy())
            out = np.zeros((len(sizes), width))
            out[np.arange(width) < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
            whole = np.clip(np.floor(out * scale), -LIMIT, LIMIT).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [part.column("row"), pa.array([x.tobytes() for x in whole], pa.binary())], ["row", "ints"])

    kind = picked.schema["row"].dataType.simpleString()
    return picked.mapInArrow(run, f"row {kind}, ints binary")


def _moved(stored: DataFrame, codebooks: np.ndarray) -> np.ndarray:
    """The codebooks after one round; an entry that nothing is assigned to stays."""
    parts, k, width = codebooks.shape
    shared = stored.sparkSession.sparkContext.broadcast(codebooks)

    def run(batches):
        counts, sums = np.zeros((parts, k), np.int64), np.zeros((parts, k, width), np.int64)
        for part in _slices(batches):
            matrix = _matrix(part.column("ints"))
            for p in range(parts):
                _, n, total = assign(BoxTree(matrix[:, p * width:(p + 1) * width], LEAF), shared.value[p])
                counts[p] += n
                sums[p] += total
        at = np.flatnonzero(counts.ravel())
        yield pa.RecordBatch.from_arrays(
            [pa.array(at, pa.int64()), pa.array(counts.ravel()[at], pa.int64()),
             pa.array(list(sums.reshape(-1, width)[at]), pa.list_(pa.int64()))], ["entry", "n", "sums"])

    each = stored.select("ints").mapInArrow(run, "entry long, n long, sums array<long>")
    totals = each.select("entry", "n", F.posexplode("sums").alias("place", "x")).groupBy("entry", "place").agg(
        F.sum("n").alias("n"), F.sum("x").alias("x"))
    moved = codebooks.copy()
    for r in totals.collect():  # one row a component of a codebook
        moved.reshape(-1, width)[r["entry"], r["place"]] = r["x"] // r["n"]
    return moved


def train(stored: DataFrame, order: list[str], parts: int = 16, entries: int = 64, rounds: int = 2) -> Codebooks:
    """Lloyd rounds over all rows of ``integers``. A codebook starts as that part of the
    first ``entries`` rows by ``order`` (columns of ``row``, nulls last; then by the
    integers); with fewer rows it is smaller."""
    keys = [F.col(f"row.`{c}`").asc_nulls_last() for c in order]
    first = stored.orderBy(*keys, "ints").limit(entries).select("ints").collect()
    if not first:
        return Codebooks(np.zeros((parts, 0, 1), np.int64))
    matrix = _matrix(pa.array([r["ints"] for r in first], pa.binary()))
    books = np.ascontiguousarray(matrix.reshape(len(matrix), parts, -1).transpose(1, 0, 2))
    for _ in range(rounds):
        books = _moved(stored, books)
    return Codebooks(books)


def encode(stored: DataFrame, books: Codebooks) -> DataFrame:
    """The kept columns of each row of ``integers``, with ``code`` (two hex digits an
    index, by part) and ``error``, the squared distances summed over the parts."""
    parts, k, width = books.entries.shape
    shared = stored.sparkSession.sparkContext.broadcast(books.entries)
    digits = max(2, len(f"{max(k - 1, 0):x}"))

    def run(batches):
        names = np.array([f"{i:0{digits}x}" for i in range(k)])
        for part in _slices(batches):
            matrix = _matrix(part.column("ints"))
            indexes, errors = np.empty((parts, len(matrix)), np.int64), np.zeros(len(matrix), np.int64)
            for p in range(parts):
                tree = BoxTree(matrix[:, p * width:(p + 1) * width], LEAF)
                found, _, _ = assign(tree, shared.value[p])
                apart = tree.points - shared.value[p][found]
                indexes[p, tree.order] = found
                errors[tree.order] += (apart * apart).sum(axis=1)
            codes = ["".join(x) for x in names[indexes].T.tolist()]
            yield pa.RecordBatch.from_arrays(
                [part.column("row"), pa.array(codes, pa.string()), pa.array(errors, pa.int64())], ["row", "code", "error"])

    kind = stored.schema["row"].dataType.simpleString()
    return stored.mapInArrow(run, f"row {kind}, code string, error long")


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
             parts: int = 16, entries: int = 64, rounds: int = 2, scale: float = SCALE) -> tuple[DataFrame, Codebooks]:
    """``(id, label, code, error, label_error)`` of each usable vector, and the codebooks.

    A vector that is null or holds a null, NaN or infinite component takes no part; one of
    another length ends in zeros (an empty one is all zeros). Rows of one id are separate
    vectors; ids may be null and then come last. ``label_error`` sums the errors of all
    rows of a label, those without a label together; a label of very many rows is split
    when the sums meet the rows again. Other columns are not looked at, and an empty
    table gives an empty result and empty codebooks."""
    picked = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector"))
    stored = materialise(integers(picked, "vector", ["id", "label"], parts, scale), "vector-integers")
    books = train(stored, ["id"], parts, entries, rounds)
    coded = materialise(encode(stored, books).select("row", F.struct("row.label").alias("of"), "code", "error"), "vector-codes")
    labels = materialise(
        coded.groupBy("of").agg(F.sum("error").alias("label_error"), F.count("*").alias("n")), "vector-labels")
    joined = join_split(coded, labels, "of", F.struct("row.id", "code"))
    return joined.select(F.col("row.id").alias(id_col), F.col("row.label").alias(label_col), "code", "error",
                         "label_error"), books
