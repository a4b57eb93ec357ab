import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstack.llm import neighbours as nb
from quillstack.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.1"


def brute(ids, x, query, k):
    scores = (x * x[ids == query][0]).sum(axis=1)
    order = [j for j in np.lexsort((ids, -scores)) if ids[j] != query][:k]
    return [(ids[j], scores[j]) for j in order]


def recall(found, ids, x, k):
    right = total = 0
    by = {}
    for r in found:
        by.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    for query in ids[ids % 20 == 0]:
        want = brute(ids, x, query, k)
        got = sorted(by.get(query, []))
        assert [r for r, *_ in got] == list(range(1, len(want) + 1))
        assert all((-a[2], a[1]) < (-b[2], b[1]) for a, b in zip(got, got[1:]))
        truth = {int(v) for v, _ in want}
        right, total = right + len(truth & {v for _, v, _ in got}), total + len(truth)
    return right / total


def test_quantile():
    assert nb.chi_square_quantile(0.95, 8) == pytest.approx(15.507, abs=1e-3)
    assert nb.chi_square_quantile(0.5, 2) == pytest.approx(2 * np.log(2))


def test_recall(spark):
    table = spark.read.parquet(f"{FOLDER}/embeddings.parquet")
    rows = table.select("vec_id", "embedding").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float64)
    found = QUERIES["op3_projected_neighbours"](spark, FOLDER).collect()
    assert recall(found, ids, x, 20) >= 0.95
    small = nb.search(table, F.col("id") % 20 == 0, block_rows=100, query_rows=16).collect()
    assert recall(small, ids, x, 20) >= 0.9
    for r in small[:50]:
        assert r.score == pytest.approx(float(x[ids == r.query_id][0] @ x[ids == r.vec_id][0]), abs=1e-12)


def test_norms_copies_and_bad_rows(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((700, 6)) * rng.uniform(0.1, 5, 700)[:, None]
    x[100:500] = x[100]  # a large group of copies
    rows = [(i, [float(c) for c in v], "x") for i, v in enumerate(x)]
    bad = [(1000, None, "x"), (1020, [0.0] * 6, "x"), (1040, [1.0, None, 1.0, 1.0, 1.0, 1.0], "x"), (1060, [float("nan")] * 6, "x"),
           (1080, [float("inf")] * 6, "x"), (1100, [1.0, 2.0], "x"), (1120, [], "x"), (None, [1.0] * 6, "x"), rows[0]]
    schema = "vec_id long, embedding array<double>, score string"
    table = spark.createDataFrame(rows + bad, schema)
    found = nb.search(table, F.col("id") % 20 == 0, block_rows=64, query_rows=8).collect()
    assert recall(found, np.arange(700), x, 20) >= 0.9
    few = nb.search(spark.createDataFrame(rows[:5], schema), F.col("id") % 20 == 0).collect()
    assert len(few) == 4
    assert nb.search(table.limit(0), F.col("id") % 20 == 0).count() == 0
    assert nb.search(spark.createDataFrame(bad[:5], schema), F.col("id") % 20 == 0).columns == ["query_id", "rank", "vec_id", "score"]
