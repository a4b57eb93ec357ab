"""Nearest neighbours through stable projections and kd-trees.

Inner product search becomes distance search: with M the largest norm, x' = (x,
sqrt(M² - |x|²)) and q' = (M·q/|q|, 0) have |q' - x'|² = 2M² - 2M·q·x/|q|. Projected
on m random Gaussian directions a squared distance d² becomes d² times a chi-square
variable of m degrees. A query therefore visits points by growing projected distance,
verifies them by their original vectors, and stops at the projected distance r where
chi2_m(r² / d_k²) reaches ``confidence``, d_k being its k-th best verified distance:
a better point is still unseen with no more than the remaining probability.

The upper levels of the kd-tree cut the projected space into cells, which are the
unit of distribution; each task builds the lower levels of one block. A query first
searches its own cell for a bound of d_k and then the cells within that bound.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstack.llm.common import mix
from quillstack.session import materialise

LEAF = 256


def chi_square_quantile(p: float, m: int) -> float:
    """Of an even number of degrees, by bisection of the closed form."""
    def below(x):
        return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(m // 2))

    low, high = 0.0, 1.0
    while below(high) < p:
        high *= 2
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if below(middle) < p else (low, middle)
    return high


@dataclass
class Space:
    """The projection and the upper kd-tree."""

    directions: np.ndarray
    norm: float
    dims: np.ndarray
    splits: np.ndarray

    def points(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.norm**2 - (x * x).sum(axis=1), 0))
        return x @ self.directions[:-1] + rest[:, None] * self.directions[-1]

    def asked(self, q: np.ndarray) -> np.ndarray:
        return (q * (self.norm / np.linalg.norm(q, axis=1))[:, None]) @ self.directions[:-1]

    def cells(self, p: np.ndarray) -> np.ndarray:
        node = np.zeros(len(p), np.int64)
        for _ in range(int(math.log2(len(self.dims) + 1))):
            right = p[np.arange(len(p)), self.dims[node]] > self.splits[node]
            node = 2 * node + 1 + right
        return node - len(self.dims)


def upper_tree(p: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """Splits of a complete tree of ``levels``, at medians of the widest dimension."""
    dims = np.zeros(2**levels - 1, np.int64)
    splits = np.zeros(2**levels - 1)
    groups = {0: p}
    for node in range(len(dims)):
        own = groups.pop(node)
        if len(own):
            dims[node] = int(np.argmax(own.max(axis=0) - own.min(axis=0)))
            splits[node] = np.median(own[:, dims[node]])
        right = own[:, dims[node]] > splits[node]
        groups[2 * node + 1], groups[2 * node + 2] = own[~right], own[right]
    return dims, splits


def leaves(p: np.ndarray, size: int = LEAF) -> list[np.ndarray]:
    """The lower kd-tree: places of the points of each leaf."""
    todo, done = [np.arange(len(p))], []
    while todo:
        own = todo.pop()
        if len(own) <= size:
            done.append(own)
            continue
        dim = int(np.argmax(p[own].max(axis=0) - p[own].min(axis=0)))
        own = own[np.argsort(p[own, dim], kind="stable")]
        todo += [own[: len(own) // 2], own[len(own) // 2:]]
    return done


def box_distances(p: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance of each point to each box."""
    out = np.zeros((len(p), len(low)))
    for d in range(p.shape[1]):
        gap = np.maximum(np.maximum(low[None, :, d] - p[:, d, None], p[:, d, None] - high[None, :, d]), 0)
        out += gap * gap
    return out


def search_block(space: Space, ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray,
                 bound: np.ndarray, k: int, quantile: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(query place, id, score)`` of up to k best of the block for each query.
    ``bound`` is a score that k points elsewhere reach (-inf: none known)."""
    # Copies of one vector are scored once, and only the k + 1 of smallest id can win.
    _, first, group = np.unique(x.view(np.dtype((np.void, x.itemsize * x.shape[1]))).ravel(),
                                return_index=True, return_inverse=True)
    order = np.lexsort((ids, group))
    starts = np.concatenate([[0], np.cumsum(np.bincount(group))])
    order = order[np.arange(len(order)) - starts[group[order]] <= k]
    ids, group, vectors = ids[order], group[order], x[first]
    p = space.points(vectors)
    tree = leaves(p)
    members = [np.flatnonzero(np.isin(group, leaf)) for leaf in tree]
    places = [np.searchsorted(np.sort(leaf), group[m]) for leaf, m in zip(tree, members)]
    tree = [np.sort(leaf) for leaf in tree]
    low = np.array([p[leaf].min(axis=0) for leaf in tree])
    high = np.array([p[leaf].max(axis=0) for leaf in tree])
    gaps = box_distances(space.asked(q), low, high)
    visits = np.argsort(gaps, axis=1, kind="stable")
    scale = space.norm / np.linalg.norm(q, axis=1)
    best = np.full((len(q), k), -np.inf)
    found = np.full((len(q), k), np.iinfo(np.int64).max)
    live = np.arange(len(q))
    for step in range(len(tree)):
        leaf_of = visits[live, step]
        kth = np.maximum(best[live, -1], bound[live])
        reach = quantile * np.maximum(2 * space.norm**2 - 2 * scale[live] * kth, 0)
        go = gaps[live, leaf_of] <= reach  # beyond it the stopping test holds
        live, leaf_of = live[go], leaf_of[go]
        if not len(live):
            break
        for leaf in np.unique(leaf_of):
            own = live[leaf_of == leaf]
            scores = (q[own] @ vectors[tree[leaf]].T)[:, places[leaf]]
            names = ids[members[leaf]]
            scores[query_ids[own][:, None] == names[None, :]] = -np.inf
            better = scores.max(axis=1) >= np.maximum(best[own, -1], bound[own] - 1e-9 * np.abs(bound[own]))
            own, scores = own[better], scores[better]
            if not len(own):
                continue
            all_scores = np.concatenate([best[own], scores], axis=1)
            all_names = np.concatenate([found[own], np.broadcast_to(names, scores.shape)], axis=1)
            rank = np.lexsort((all_names, -all_scores), axis=1)[:, :k]
            best[own] = np.take_along_axis(all_scores, rank, 1)
            found[own] = np.take_along_axis(all_names, rank, 1)
    at, column = np.nonzero(np.isfinite(best))
    return at, found[at, column], best[at, column]


def clean_vectors(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``(id, v array<double>)``, one row per id. Without the rows whose id or vector is
    null, that hold a null or non-finite component, are zero, or have another length
    than most; of rows with the same id the smallest vector stands."""
    v = F.col("v")
    ok = v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.filter(F.col("id").isNotNull() & ok).filter(F.exists(v, lambda e: e != 0))
    common = rows.groupBy(F.size(v).alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    length = common[0]["n"] if common else 0
    return rows.filter(F.size(v) == length).groupBy("id").agg(F.min("v").alias("v"))


def _matrix(column) -> np.ndarray:
    data = b"".join(column)
    return np.frombuffer(data, np.float64).reshape(len(column), -1) if len(column) else np.empty((0, 1))


def search(table: DataFrame, is_query, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20,
           directions: int = 8, confidence: float = 0.95, block_rows: int = 8192,
           query_rows: int = 4096, sample: int = 20_000, seed: int = 11) -> DataFrame:
    """``(query_id, rank, <id>, score)``: for each row where ``is_query`` (a condition on
    the id as column ``id``) holds, about its k rows of largest inner product, its own
    left out; ties go to the smaller id.

    ``sample`` bounds the rows that place the cells; all rows are in the index. A cell
    with many rows, such as the copies of one vector, is split by a hash of the id. See
    ``clean_vectors`` for rows that take no part. Other columns are not looked at."""
    spark = table.sparkSession
    schema = f"query_id long, rank int, `{id_col}` long, score double"
    valid = materialise(clean_vectors(table, id_col, vector_col), "vectors")
    norm2 = F.aggregate("v", F.lit(0.0), lambda a, e: a + e * e)
    n, largest, width = valid.agg(F.count("*"), F.max(norm2), F.max(F.size("v"))).first()
    if not n:
        return spark.createDataFrame([], schema)
    rng = np.random.default_rng(seed)
    space = Space(rng.standard_normal((width + 1, directions)), math.sqrt(largest), np.zeros(0, int), np.zeros(0))
    draw = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / float(1 << 30)
    picked = valid.filter(draw < sample / n).select("v").toPandas()["v"]
    levels = max(0, math.ceil(math.log2(n / block_rows))) if n > block_rows else 0
    if len(picked):
        space.dims, space.splits = upper_tree(space.points(np.stack(picked.to_numpy())), levels)
    shared = spark.sparkContext.broadcast(space)

    def place(batches):
        for batch in batches:
            if batch.num_rows:
                column = batch.column("v")
                x = np.asarray(column.flatten()).reshape(len(column), -1).astype(np.float64)
                p = shared.value.points(x)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), pa.array([r.tobytes() for r in x], pa.binary()),
                     pa.array(shared.value.cells(p)), pa.array(list(p), pa.list_(pa.float64()))],
                    ["id", "x", "cell", "p"])

    placed = materialise(valid.mapInArrow(place, "id long, x binary, cell long, p array<double>"), "cells")
    # One row per cell: about n / block_rows rows, at most as many as leaves of the tree.
    edges = placed.groupBy("cell").agg(
        F.count("*").alias("n"), F.sum(is_query.cast("long")).alias("asked"),
        *(F.min(F.col("p")[d]).alias(f"low{d}") for d in range(directions)),
        *(F.max(F.col("p")[d]).alias(f"high{d}") for d in range(directions))).toPandas().sort_values("cell")
    parts = np.maximum(1, np.ceil(edges["n"].to_numpy() / (2 * block_rows))).astype(np.int64)
    first = np.concatenate([[0], np.cumsum(parts)])  # number of the first block of each cell
    low = edges[[f"low{d}" for d in range(directions)]].to_numpy()
    high = edges[[f"high{d}" for d in range(directions)]].to_numpy()
    # Queries travel in chunks of neighbouring cells.
    before = np.cumsum(edges["asked"].to_numpy()) - edges["asked"].to_numpy()
    cut = np.maximum(1, np.ceil(edges["asked"].to_numpy() / query_rows)).astype(np.int64)
    chunk = before // query_rows
    layout = spark.sparkContext.broadcast((edges["cell"].to_numpy(), parts, first, low, high, chunk, cut))
    quantile = chi_square_quantile(confidence, directions)

    def own_block(ids, cells):
        names, parts, first, _, _, chunk, cut = layout.value
        at = np.searchsorted(names, cells)
        h = mix(ids.view(np.uint64)).astype(np.uint64)
        block = first[at] + (h % parts[at].astype(np.uint64)).astype(np.int64)
        return at, block, chunk[at] + ((h >> np.uint64(20)) % cut[at].astype(np.uint64)).astype(np.int64)

    def to_blocks(batches):
        for batch in batches:
            _, block, _ = own_block(np.asarray(batch.column("id")), np.asarray(batch.column("cell")))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("x"), pa.array(block)], ["id", "x", "block"])

    blocks = materialise(placed.select("id", "x", "cell").mapInArrow(to_blocks, "id long, x binary, block long"), "blocks")

    def ask_own(batches):
        for batch in batches:
            ids = np.asarray(batch.column("id"))
            _, block, part = own_block(ids, np.asarray(batch.column("cell")))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("x"), pa.array(np.full(len(ids), -np.inf)),
                 pa.array(block), pa.array(part), pa.array(block)],
                ["id", "x", "bound", "block", "part", "own"])

    asking = "id long, x binary, bound double, block long, part long, own long"

    def find(_, data: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(data) or not len(asked):
            return pd.DataFrame({"query_id": [], "id": [], "score": []})
        asked = asked.sort_values("id")
        queries, x = _matrix(asked["x"]), _matrix(data["x"])
        names = asked["id"].to_numpy()
        at, ids, _ = search_block(shared.value, data["id"].to_numpy(), x, names, queries,
                                  asked["bound"].to_numpy(), k, quantile)
        by_id = np.argsort(data["id"].to_numpy())
        rows = by_id[np.searchsorted(data["id"].to_numpy()[by_id], ids)]
        score = (x[rows] * queries[at]).sum(axis=1)  # the same sum wherever a row lies
        return pd.DataFrame({"query_id": names[at], "id": ids, "score": score})

    def run(visits: DataFrame, label: str) -> DataFrame:
        """Blocks go to the chunks of queries that ask for them."""
        visits = materialise(visits, f"{label}-visits")
        wanted = visits.select(F.col("block").alias("to_block"), F.col("part").alias("to_part")).distinct()
        data = blocks.join(wanted, F.col("block") == F.col("to_block")).groupBy("to_block", "to_part")
        answers = data.cogroup(visits.groupBy("block", "part")).applyInPandas(
            find, "query_id long, id long, score double")
        return materialise(answers, label)

    questions = placed.filter(is_query).select("id", "x", "cell")
    nearby = run(questions.mapInArrow(ask_own, asking), "neighbours-own")
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    bound = nearby.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") == k).select(
        F.col("query_id").alias("id"), F.col("score").alias("bound"))

    def ask_all(batches):
        names, parts, first, low, high, _, _ = layout.value
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = np.asarray(batch.column("id"))
            q = _matrix(batch.column("x").to_pylist())
            bounds = np.asarray(batch.column("bound").fill_null(-np.inf))
            _, own, part = own_block(ids, np.asarray(batch.column("cell")))
            scale = shared.value.norm / np.linalg.norm(q, axis=1)
            reach = quantile * np.maximum(2 * shared.value.norm**2 - 2 * scale * bounds, 0)
            for start in range(0, len(ids), 256):
                s = slice(start, start + 256)
                at, cell = np.nonzero(box_distances(shared.value.asked(q[s]), low, high) <= reach[s, None])
                row = np.repeat(at + start, parts[cell])
                block = np.concatenate([np.arange(first[c], first[c] + parts[c]) for c in cell] or [np.empty(0, np.int64)])
                other = block != own[row]
                row, block = row[other], block[other]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[row]), batch.column("x").take(pa.array(row)), pa.array(bounds[row]),
                     pa.array(block), pa.array(part[row]), pa.array(own[row])],
                    ["id", "x", "bound", "block", "part", "own"])

    rest = run(questions.join(bound, "id", "left").select("id", "x", "cell", "bound").mapInArrow(ask_all, asking),
               "neighbours-rest")
    best = nearby.unionByName(rest).withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k)
    return best.select("query_id", "rank", F.col("id").alias(id_col), "score")
