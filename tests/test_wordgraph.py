import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from quillstack.functions import wordgraph
from quillstack.operators import keyphrase
from quillstack.operators.sentences import with_token_stream


def texts(rng, n):
    """Token arrays of some documents, with nulls between the words."""
    words, sentences = [], []
    for _ in range(n):
        size, kinds = int(rng.integers(0, 90)), int(rng.integers(1, 60))
        number = np.sort(rng.integers(0, rng.integers(1, 12), size))
        words.append([None if rng.random() < 0.3 else f"w{rng.integers(kinds)}" for _ in range(size)])
        sentences.append(number.tolist())
    words[n // 2] = sentences[n // 2] = None
    return pa.array(words, pa.list_(pa.string())), pa.array(sentences, pa.list_(pa.int32()))


def lines(words, sentences):
    """The same as strings: a line for each sentence."""
    out = []
    for w, s in zip(words.to_pylist(), sentences.to_pylist()):
        parts = [[] for _ in range(max(s, default=0) + 1)] if w is not None else None
        for word, number in zip(w or [], s or []):
            parts[number].append(word or "")
        out.append(None if w is None else "\n".join(" ".join(p) for p in parts))
    return pa.array(out, pa.string())


def peak_mb(function, *args):
    tracemalloc.start()
    function(*args)
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    return peak


def ranker(monkeypatch, algos=tuple(keyphrase.WAYS), most=None):
    """The function that a Spark column would call."""
    class Direct:
        def __init__(self, function, kind):
            self.function = function

        def asNondeterministic(self):
            return lambda *columns: self.function

    monkeypatch.setattr(wordgraph.F, "arrow_udf", Direct)
    return wordgraph.ranked_phrases(None, {a: keyphrase.WAYS[a] for a in algos}, most)


@pytest.mark.parametrize("limits", [
    {}, {"PAIRS_AT_ONCE": 50}, {"MOST_PAIRS": 40}, {"WEDGES_AT_ONCE": 60}, {"MOST_WEDGES": 30, "WEDGES_AT_ONCE": 200},
    {"MOST_CELLS": 0}, {"_marks": lambda window: np.ones(len(window), np.uint64)},
])
def test_connectivity_of_many_documents(monkeypatch, limits):
    """All documents at once as one by one, also where marks of windows are equal by chance."""
    for name, value in limits.items():
        monkeypatch.setattr(wordgraph, name, value)
    rng = np.random.default_rng(5)
    for _ in range(3):
        stream = wordgraph._Stream(*texts(rng, 40))
        found = wordgraph._connectivities(stream)
        for doc in np.unique(stream.doc):
            mine = stream.doc == doc
            nodes, local = np.unique(stream.node[mine], return_inverse=True)
            want = wordgraph._connectivity(stream.sentence[mine], local, len(nodes))
            assert (found[nodes] == want).all()


def test_connectivity_without_words():
    for rows in ([], [None, []], [[None, None]]):
        stream = wordgraph._Stream(pa.array(rows, pa.list_(pa.string())), pa.array([r and [0] * len(r) for r in rows], pa.list_(pa.int32())))
        assert len(wordgraph._connectivities(stream)) == 0


def test_phrases_in_pieces(monkeypatch):
    """The same phrases in pieces, for a batch that is itself a slice."""
    run = ranker(monkeypatch)
    batch = lines(*texts(np.random.default_rng(6), 30))
    whole = run(batch)
    monkeypatch.setattr(wordgraph, "BYTES_AT_ONCE", 300)
    assert run(batch).equals(whole)
    assert run(batch.slice(7, 20)).equals(whole.slice(7, 20))
    assert len(run(batch.slice(0, 0))) == 0
    few = ranker(monkeypatch, most=2)(batch).to_pylist()
    assert few == [{algo: found[:2] for algo, found in row.items()} for row in whole.to_pylist()]


def test_lines_hold_the_stream(spark):
    texts = [(1, "The court, of law. Ruled x\nnothing? ... Ab\u00c9\u0130 U.S. end"), (2, ""), (3, None), (4, "  "), (5, "the of")]
    rows = with_token_stream(spark.createDataFrame(texts, "doc_id long, text string")).orderBy("doc_id").collect()
    words, sentences = wordgraph._opened(pa.array([r["word_lines"] for r in rows], pa.string()))
    for k, r in enumerate(rows):
        if r["words"]:
            assert words[k].as_py() == r["words"] and sentences[k].as_py() == r["word_sentence"]
        else:
            assert not any(words[k].as_py() or [])


def test_phrases_in_order(monkeypatch):
    """Runs, sums, order and equal phrases restated word by word."""
    words, sentences = texts(np.random.default_rng(8), 60)
    found = ranker(monkeypatch, ["textrank"])(lines(words, sentences)).field("textrank").to_pylist()
    for k, (w, s) in enumerate(zip(words.to_pylist(), sentences.to_pylist())):
        stream = wordgraph._Stream(words.slice(k, 1), sentences.slice(k, 1))
        scores = dict(zip(stream.place, keyphrase.WAYS["textrank"][0](stream))) if w else {}
        wanted, run = set(), []
        for i in range(len(w or []) + 1):
            if run and (i == len(w) or w[i] is None or s[i] != s[i - 1]):
                total = round(sum(scores[j] for j in run), 9)
                wanted.add((-total, " ".join(w[j] for j in run)))
                run = []
            if i < len(w or []) and w[i] is not None:
                run.append(i)
        assert [(-p["score"], p["phrase"]) for p in found[k]] == sorted(wanted)


def test_rounded_as_spark(spark):
    rng = np.random.default_rng(9)
    x = np.concatenate([[0.0, 0.5e-9, 1.5e-9, 2.5e-9, 0.1234567885, 4e6, 8388608.0000000015], rng.random(500),
                        np.round(rng.random(500) * 10.0 ** rng.integers(-6, 8, 500), 9) + 0.5e-9, rng.random(500) * 1e9])
    rows = spark.createDataFrame([(float(v),) for v in x], "x double").selectExpr("x", "round(x, 9) AS r").collect()
    assert (wordgraph.half_up(np.array([r["x"] for r in rows])) == [r["r"] for r in rows]).all()


def test_memory_does_not_grow_with_the_batch(monkeypatch):
    """1.5 million words in a batch."""
    rng = np.random.default_rng(7)
    batch = pa.array(["\n".join(" ".join(f"w{i}" for i in rng.integers(0, 5_000, 10)) for _ in range(30))] * 5_000)
    assert peak_mb(ranker(monkeypatch, ["pytextrank"], 50), batch) < 150


def test_memory_of_many_links_that_go_at_once():
    """All links of 500 kinds go in one round, from 20 million triangles."""
    n = 500
    graph = ~np.eye(n, dtype=bool)
    levels = []
    assert peak_mb(lambda: levels.append(wordgraph._truss(graph, np.ones(n, int)))) < 150
    assert (levels[0] == n).all()
