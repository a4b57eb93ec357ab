import resource
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillstack.functions import wordgraph
from quillstack.operators import classify, lda, nmf, similar, topics
from quillstack.session import new_path

THEMES = ("court law judge appeal", "river water fish boat", "music song dance drum")


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(60):
        words = THEMES[i % 3].split()
        rows.append((i, i % 3, " ".join(rng.choice(words, 30))))
    return spark.createDataFrame(rows, "doc_id long, label int, clean_text string")


def test_classifier(spark, docs):
    path = new_path(spark, "clf")
    assert classify.TextClassifier.load(spark, path) is None
    classify.train(docs, "label").save(spark, path)
    predicted = classify.TextClassifier.load(spark, path).predict(docs)
    report = {r["class"]: r for r in classify.report(predicted, "label", "pred_label_num").collect()}
    assert report["accuracy"]["f1"] == 1.0 and report["accuracy"]["support"] == 60


def test_report_on_undefined_classes(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("c", "a")], "label string, pred string")
    got = {r["class"]: (r["precision"], r["recall"], r["f1"], r["support"]) for r in classify.report(df).collect()}
    assert got["a"] == (0.5, 0.5, 0.5, 2) and got["b"] == (0.0, 0.0, 0.0, 0) and got["c"] == (0.0, 0.0, 0.0, 1)
    assert got["accuracy"][0] == pytest.approx(1 / 3)


@pytest.mark.parametrize("kind", ["lda", "nmf"])
def test_topic_models(spark, docs, kind):
    model = topics.train_topics(docs, kind, components=3, passes=5)
    path = new_path(spark, kind)
    assert topics.TopicModel.load(spark, path) is None
    model.save(spark, path)
    model = topics.TopicModel.load(spark, path)
    mixes = [r["topics"] for r in model.mix(docs).collect()]
    assert all(len(m) == 3 and min(m) >= 0 for m in mixes)
    if kind == "lda":
        assert all(sum(m) == pytest.approx(1) for m in mixes)
    means = topics.model_coherence(model, docs).first()
    assert means["intra"] > means["inter"]
    words = topics.topic_words(model.word_weights(spark), 4).collect()
    assert len(words) == 3
    if kind == "nmf":
        assert {frozenset(r["words"].split()) for r in words} == {frozenset(t.split()) for t in THEMES}


def test_nmf_objective_falls(spark):
    rng = np.random.default_rng(1)
    rows = [([0, 1, 2, 3], [float(x) for x in rng.random(4)]) for _ in range(40)]
    df = spark.createDataFrame(rows, "indices array<int>, values array<double>")
    history = nmf.fit_nmf(df, 4, components=2, rounds=8, tolerance=-1).objective
    assert all(b <= a + 1e-6 for a, b in zip(history, history[1:]))


def test_lda_rows_reach_the_fixed_point_in_few_updates():
    rng = np.random.default_rng(4)
    k, width, n = 5, 40, 700
    model = lda.expected(rng.gamma(1.0, 1.0, (k, width)) + 0.05)
    counts = rng.poisson(0.4, (n, width)) * 3.0
    counts[7] = 0
    cells = [np.flatnonzero(row) for row in counts]
    batch = pa.RecordBatch.from_arrays(
        [pa.array([c.tolist() for c in cells], pa.list_(pa.int32())),
         pa.array([r[c].tolist() for r, c in zip(counts, cells)], pa.list_(pa.float64()))], ["indices", "values"])
    solved, sums = lda.solve_rows(batch, model, 0.2)
    share = lda.expected(solved)
    ratio = counts / (share @ model + 1e-300)
    again = share * (ratio @ model.T) + 0.2
    assert np.abs(again - solved).mean(axis=1).max() < 2 * lda.TOLERANCE
    assert np.allclose(solved.sum(axis=1), counts.sum(axis=1) + k * 0.2)
    assert np.allclose(sums.sum(axis=0), counts.sum(axis=0))
    alone, _ = lda.solve_rows(batch.slice(600, 20), model, 0.2)
    assert np.allclose(alone, solved[600:620], atol=1e-9)


def test_lda_finds_planted_topics(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(120):
        words = np.arange(6) + 6 * (i % 3)
        rows.append((words.tolist(), (1.0 + rng.poisson(2, 6)).tolist()))
    rows.append(([], []))
    df = spark.createDataFrame(rows, "indices array<int>, values array<double>")
    planted = {frozenset(range(a, a + 6)) for a in (0, 6, 12)}
    for seed in range(4):  # two topics of a start may stay together
        model = lda.fit_lda(df, 18, 3, 15, 0.5, 10.0, 0.7, seed)
        if {frozenset(np.argsort(-w)[:6].tolist()) for w in model.weights} == planted:
            break
    else:
        raise AssertionError("no start found the topics")
    mixes = [r["m"] for r in df.select(model.mix(F.col("indices"), F.col("values")).alias("m")).collect()]
    assert sorted(round(sum(m), 6) for m in mixes) == [0.0] + [1.0] * 120


def test_unknown_topic_model(docs):
    with pytest.raises(ValueError):
        topics.train_topics(docs, "pca")


def test_similar_both_ways(spark):
    rng = np.random.default_rng(2)
    vectors = rng.standard_normal((80, 6))
    vectors[7] = 0
    vectors[20:50] = vectors[20]  # a third of the rows are copies
    corpus = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "doc_id long, vec array<double>")
    queries = corpus.withColumnRenamed("doc_id", "query_id")
    near = similar.similar_documents(queries, corpus, 5)
    blocks = similar.similar_documents(queries, similar.SimilarIndex.build(corpus), 5)
    assert sorted(map(tuple, near.collect())) == sorted(map(tuple, blocks.collect()))
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    unit = np.divide(vectors, norms, out=np.zeros_like(vectors), where=norms > 0)
    scores = np.round(unit @ unit.T, 6)
    for q in range(80):
        expected = sorted(range(80), key=lambda d: (-scores[q, d], d))[:5]
        got = near.filter(F.col("query_id") == q).orderBy("rank").collect() if q in (0, 7, 25) else None
        assert got is None or [r["doc_id"] for r in got] == expected
    assert similar.similar_documents(queries, corpus, 0).count() == 0


def nearest(vectors, queries, k):
    """All pairs: {query: [(id, score)]}, equal scores in the order of ids."""
    def unit(v):
        return np.array(v) / (np.linalg.norm(v) or 1.0)

    out = {}
    for q, v in queries.items():
        scores = [(-round(float(unit(v) @ unit(x)), 6) + 0.0, i) for i, x in vectors.items()]
        out[q] = [(i, -s + 0.0) for s, i in sorted(scores)[:k]]
    return out


def test_similar_index_grows(spark, monkeypatch):
    """Added, replaced and removed vectors give what an index built whole gives, with ids
    that are texts, in many blocks and cells."""
    monkeypatch.setattr(similar, "BLOCK_ROWS", 40)
    monkeypatch.setattr(similar, "CELL_BLOCKS", 1)
    rng = np.random.default_rng(6)
    middle = rng.standard_normal((12, 5)) * 4

    def made(ids):
        return {f"d{i:04d}": [float(x) for x in np.round(middle[i % 12] + rng.standard_normal(5) * 0.3, 3)] for i in ids}

    def frame(vectors):
        return spark.createDataFrame(list(vectors.items()), "doc_id string, vec array<double>")

    first, second, third = made(range(700)), made(range(600, 900)), made([3, 5, 950])
    third["d0003"] = [0.0] * 5
    gone = ["d0010", "d0011", "d0650", "nobody"]
    index = similar.SimilarIndex.build(frame(first), buckets=3)
    index = index.add(frame(second), spark.createDataFrame([(g,) for g in gone[:2]], "doc_id string"), batch="b")
    assert index.add(frame(second), batch="b") is index
    index = index.add(frame(third)).add(removed=spark.createDataFrame([(g,) for g in gone], "doc_id string"))
    left = {i: v for i, v in (first | second | third).items() if i not in gone}
    queries = {i: v for k, (i, v) in enumerate(left.items()) if k % 9 == 0} | {"zero": [0.0] * 5, "odd": [9.0, -9.0, 9.0, -9.0, 9.0]}
    asked = spark.createDataFrame([*queries.items(), ("none", None)], "query_id string, vec array<double>")
    want = nearest(left, queries, 7)
    measured = spark.sparkContext.accumulator(0)
    for corpus in (index, similar.SimilarIndex.open(spark, index.path), index.merge(), frame(left)):
        found = {}
        for r in similar.similar_documents(asked, corpus, 7, measured if corpus is index else None).orderBy("query_id", "rank").collect():
            found.setdefault(r["query_id"], []).append((r["doc_id"], r["score"]))
        assert found == want
    assert 0 < measured.value < 0.6 * len(queries) * len(left)
    assert {r["doc_id"] for r in index.ids().collect()} == set(left)
    index.close()
    assert similar.similar_documents(asked, similar.SimilarIndex.open(spark, index.path), 2).count() == 2 * len(queries)
    nothing = similar.SimilarIndex.build(spark.createDataFrame([], "doc_id string, vec array<double>"))
    assert similar.similar_documents(asked, nothing, 3).count() == 0
    assert similar.similar_documents(asked, nothing.add(frame(third)), 3).filter("query_id = 'odd'").count() == 3


def test_coherence_equals_all_pairs(spark):
    rng = np.random.default_rng(3)
    a, b = rng.random((12, 4)), rng.random((12, 4))
    df = spark.createDataFrame([(x.tolist(), y.tolist()) for x, y in zip(a, b)], "a array<double>, b array<double>")
    ua, ub = a / np.linalg.norm(a, axis=1)[:, None], b / np.linalg.norm(b, axis=1)[:, None]
    row = topics.half_coherence(df, "a", "b").first()
    assert row["intra"] == pytest.approx((ua * ub).sum(1).mean())
    assert row["inter"] == pytest.approx((ua @ ub.T).mean())


def test_top_topics(spark):
    df = spark.createDataFrame([([0.2, 0.5, 0.3, 0.0],), ([0.0, 0.0],)], "v array<double>")
    rows = [[tuple(t) for t in r[0]] for r in df.select(topics.top_topics(F.col("v"))).collect()]
    assert rows == [[(1, 0.5), (2, 0.3), (0, 0.2)], [(0, 0.0), (1, 0.0)]]


def peeled(graph):
    """Largest k of a k-truss that holds each node, of a plain table of links."""
    level, left, k = np.ones(len(graph), int), (graph > 0).astype(int), 2
    while left.any():
        level[left.any(1)] = k
        k += 1
        while ((left > 0) & (left @ left < k - 2)).any():
            left[(left > 0) & (left @ left < k - 2)] = 0
    return level


def test_truss_levels():
    rng = np.random.default_rng(0)
    for _ in range(60):
        n = int(rng.integers(2, 12))
        graph = np.triu(rng.random((n, n)) < rng.random(), 1)
        graph = graph | graph.T
        assert (wordgraph._truss(graph, np.ones(n, int)) == peeled(graph)).all()
        # Kinds of several words, linked among themselves.
        sizes = rng.integers(1, 5, n)
        graph[np.diag_indices(n)] = sizes > 1
        of = np.repeat(np.arange(n), sizes)
        words = graph[np.ix_(of, of)].astype(int)
        np.fill_diagonal(words, 0)
        assert (wordgraph._truss(graph, sizes)[of] == peeled(words)).all()


def test_truss_of_many_rounds(monkeypatch):
    """A tube of triangles goes ring after ring from its two ends, and a round must not look
    at the whole table of links."""
    def tube(rings):
        ring, side = np.divmod(np.arange(4 * rings), 4)
        down = ring[None, :] - ring[:, None]
        turn = (side[None, :] - side[:, None]) % 4
        graph = ((down == 0) & (turn == 1)) | ((down == 1) & (turn <= 1))
        return graph | graph.T

    graph = tube(600)
    begin = time.process_time()
    assert (wordgraph._truss(graph, np.ones(len(graph), int)) == 3).all()
    assert time.process_time() - begin < 4
    monkeypatch.setattr(wordgraph, "CELLS_AT_ONCE", 100)
    graph = tube(12)
    assert (wordgraph._truss(graph, np.ones(48, int)) == peeled(graph)).all()


def test_connectivity_of_words(monkeypatch):
    """Strength and connectivity over all pairs of words, against the tables of kinds."""
    monkeypatch.setattr(wordgraph, "ROWS_AT_ONCE", 3)
    rng = np.random.default_rng(5)
    for _ in range(60):
        sentence = np.sort(rng.integers(0, rng.integers(1, 9), rng.integers(1, 60)))
        _, node = np.unique(rng.integers(0, rng.integers(1, 40), len(sentence)), return_inverse=True)
        n = node.max() + 1
        shared = np.zeros((n, n), int)
        for w in range(max(int(sentence.max()), 1)):
            inside = np.unique(node[(sentence == w) | (sentence == w + 1)])
            shared[np.ix_(inside, inside)] += 1
        np.fill_diagonal(shared, 0)
        level = peeled(shared)
        kinds = np.array([len(set(level[shared[i] > 0])) for i in range(n)])
        want = (shared * level).sum(axis=1) * kinds / level.max()
        assert np.allclose(wordgraph._connectivity(sentence, node, n), want)


def test_connectivity_of_one_long_sentence():
    begin = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    found = wordgraph._connectivity(np.zeros(30_000, int), np.arange(30_000), 30_000)
    assert (found == 29_999 * 30_000 / 30_000).all()
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - begin < 500_000  # KB


def test_similar_index_has_a_bucket_for_each_block(spark, monkeypatch):
    """Queries are sent to cells, so the cells of a task must stay few while the corpus grows."""
    monkeypatch.setattr(similar, "BLOCK_ROWS", 4)
    rows = [(i, [float(i % 7), 1.0, float(i % 5)]) for i in range(200)]
    index = similar.SimilarIndex.build(spark.createDataFrame(rows, "doc_id long, vec array<double>"))
    assert index.buckets == 50
    index.close()


def test_nmf_in_small_blocks(spark):
    """A round in blocks of at most 2 MB gives the sums and the objective of the whole."""
    rng = np.random.default_rng(4)
    v, h = rng.random((600, 1_000)), rng.random((5, 1_000))
    rows = [(list(range(1_000)), x.tolist()) for x in v]
    batch = pa.table({"indices": [r[0] for r in rows], "values": [r[1] for r in rows]}).to_batches()[0]
    blocks = list(nmf._chunks(batch, 1_000))
    assert max(b.nbytes for b in blocks) <= 2 << 20 and np.array_equal(np.concatenate(blocks), v)
    w = np.full((600, 5), 0.2)
    for _ in range(nmf.ROW_STEPS):
        w *= v @ h.T / (w @ h @ h.T + 0.05 + 0.05 * w + nmf.EPS)
    df = spark.createDataFrame(rows, "indices array<int>, values array<double>")
    wv, ww, loss = nmf._round(df, h)
    assert wv == pytest.approx(w.T @ v) and ww == pytest.approx(w.T @ w)
    assert loss == pytest.approx(0.5 * ((v - w @ h) ** 2).sum() + nmf._penalty(w))
