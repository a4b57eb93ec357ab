import random
import sys

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillstack.operators import search, search_index
from quillstack.operators.search_index import CELL, SearchIndex

SCHEMA = "doc_id long, title string, text string, source string"
WORDS = [f"w{i}" for i in range(40)]


def made(rng, i):
    n = rng.choice([0, 3, 8, 30, 200])
    return (i, f"w{rng.randint(0, 39)} t", " ".join(rng.choices(WORDS, [1 / (k + 1) for k in range(40)], k=n)), rng.choice("ab"))


def contents(index):
    """Postings, words and statistics as plain sets."""
    rows = index.postings(positions=True).select("field", "term", "doc_id", "tf", "len", "positions").collect()
    return (
        sorted((r[0], r[1], r[2], r[3], r[4], tuple(r[5])) for r in rows),
        sorted(map(tuple, index.words.collect())),
        sorted((r["field"], r["n_docs"], round(r["avg_len"], 9)) for r in index.stats.collect()),
        sorted(map(tuple, index.docs.drop(CELL).collect()), key=str),
    )


def hits(index, q, docs=None):
    out = {}
    for mode in search.MODES:
        found = search.top_hits(search.match(index, q, mode, ("text", "title"), docs=docs))
        out[mode] = sorted((r["query_id"], r["rank"], r["doc_id"], r["score"]) for r in found.collect())
    return out


def test_additions_equal_a_whole_index(spark):
    rng = random.Random(3)
    docs = {i: made(rng, i) for i in range(300)}
    first = {i: made(rng, i) for i in range(0, 150)}
    second = {i: made(rng, i) for i in range(100, 250)}
    gone = [5, 120, 299, 10_000]

    def frame(rows):
        return spark.createDataFrame(list(rows), SCHEMA)

    def named(ids):
        return spark.createDataFrame([(i,) for i in ids], "doc_id long")

    index = SearchIndex.build(frame(first.values()), "doc_id", ("text", "title"), buckets=3)
    index = index.add(frame(second.values()), named([1, 2, 120]), batch="b")
    index = index.add(frame(docs.values()))
    index = index.add(removed=named(gone))
    left = [d for i, d in docs.items() if i not in gone]
    whole = SearchIndex.build(frame(left), "doc_id", ("text", "title"))
    want = contents(whole)
    assert contents(index) == want
    assert len(index.live) == 4
    q = spark.createDataFrame(
        [("a", "w0 w1"), ("b", "w3"), ("c", "w2* "), ("d", "w?"), ("e", "wo1 w2"), ("f", "w0 w0")], "query_id string, query_text string")
    answers = hits(whole, q)
    assert hits(index, q) == answers
    few = [search.terms_filter("source", ["a"])]
    filtered = hits(whole, q, search.allowed(whole, *few))
    assert hits(index, q, search.allowed(index, *few)) == filtered != answers
    # By documents alone, without their cells.
    assert hits(index, q, search.allowed(index, *few).select("doc_id")) == filtered
    again = SearchIndex.open(spark, index.path)
    assert contents(again) == want
    merged = again.merge()
    assert len(merged.live) == 1 and contents(merged) == want and hits(merged, q) == answers
    assert merged.merge() is merged
    merged.close()
    assert contents(SearchIndex.open(spark, index.path)) == want


def test_a_batch_counts_once(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "t", "red fox", "a"), (2, "t", "blue fox", "a")], SCHEMA)
    more = spark.createDataFrame([(2, "t", "green dog", "a"), (3, "t", "red dog", "a")], SCHEMA)
    index = SearchIndex.build(docs, "doc_id", ("text",))

    class Broken(Exception):
        pass

    def fail(*_):
        raise Broken

    with monkeypatch.context() as m:
        m.setattr(SearchIndex, "_commit", fail)
        with pytest.raises(Broken):
            index.add(more, batch="7")
    before = contents(SearchIndex.open(spark, index.path))
    assert before == contents(index) and len(before[3]) == 2
    once = SearchIndex.open(spark, index.path).add(more, batch="7")
    assert {r["doc_id"]: r["text"] for r in once.docs.collect()} == {1: "red fox", 2: "green dog", 3: "red dog"}
    assert SearchIndex.open(spark, index.path).add(more, batch="7").commits == once.commits
    assert once.add(removed=spark.createDataFrame([(9,)], "doc_id long")).docs.count() == 3


def test_empty_index(spark):
    none = spark.createDataFrame([], SCHEMA)
    index = SearchIndex.build(none, "doc_id", ("text",))
    q = spark.createDataFrame([("a", "red"), ("b", "")], "query_id string, query_text string")
    for mode in search.MODES:
        assert search.match(index, q, mode).count() == 0
    assert search.best_normal(index, q).hits.count() == 0
    full = index.add(spark.createDataFrame([(1, "t", "red fox", "a"), (2, None, None, None)], SCHEMA))
    assert [r["doc_id"] for r in search.match(full, q).collect()] == [1] and full.docs.count() == 2


@pytest.mark.parametrize("any_field", [True, False])
def test_best_hits_with_bounds(spark, any_field):
    rng = random.Random(8)
    rows = [made(rng, i) for i in range(3000)] + [(9000, "w1", "w1 w1 w1 w2", "a"), (9001, "w1", "w1 w1 w1 w2", "b")]
    index = SearchIndex.build(spark.createDataFrame(rows, SCHEMA), "doc_id", ("text", "title"))
    index = index.add(spark.createDataFrame([made(rng, i) for i in range(50)], SCHEMA))
    q = spark.createDataFrame(
        [("a", "w1 w2"), ("b", "w0"), ("c", "absent w1"), ("d", "w30 w31 w32"), ("e", ""), ("f", "w1 w1 w5")],
        "query_id string, query_text string")
    few = search.allowed(index, search.terms_filter("source", ["a"]))
    for docs in (None, few):
        for fields in (("text",), ("text", "title")):
            want = search.top_hits(search.match_normal(index, q, fields, any_field, docs))
            best = search.best_normal(index, q, fields, any_field, docs)
            columns = ["query_id", "rank", "doc_id", "score"]
            assert sorted(map(tuple, best.hits.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))
            assert best.read < best.asked


def test_columns_of_documents_stay(spark):
    docs = spark.createDataFrame([("x", "red fox", 1.5, ["a"])], "name string, text string, segment double, terms array<string>")
    index = SearchIndex.build(docs, "name", ("text",))
    found = search.run(index, spark.createDataFrame([("q", "fox")], "query_id string, query_text string"),
                       search.SearchRequest(columns=("segment", "terms")))
    row = found.hits.first()
    assert row["doc_id"] == "x" and row["segment"] == 1.5 and row["terms"] == ["a"]
    assert index.docs.filter(F.col("segment") > 1).count() == 1


def test_postings_are_gathered_without_steps_for_each_word():
    """25 texts of 400 words in two cells: the same blocks whatever is held at a time, and far
    fewer calls than words."""
    rng = random.Random(2)
    texts = [[f"w{rng.randint(0, 30)}" for _ in range(400)] for _ in range(25)]
    cells = [0] * 12 + [7] * 13
    columns = [pa.array(cells), pa.array([f"d{i}" for i in range(25)]), pa.array(["text", "title"] * 12 + ["text"]),
               pa.array(texts, pa.list_(pa.string()))]
    batch = pa.RecordBatch.from_arrays(columns, [CELL, "doc_id", "field", "terms"])
    calls = 0

    def count(frame, event, arg):
        nonlocal calls
        calls += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        made_blocks = list(search_index._gather([batch.slice(0, 5), batch.slice(5)]))
    finally:
        sys.setprofile(None)
    blocks = [row for b in made_blocks for row in b.to_pylist()]
    assert calls < 10_000 / 4
    wanted = {}
    for cell, doc, field, words in zip(*(c.to_pylist() for c in columns)):
        for word in dict.fromkeys(words):
            at = [i for i, w in enumerate(words) if w == word]
            wanted.setdefault((cell, field, word), []).append((doc, len(at), len(words), at))
    got = {}
    for b in blocks:
        entries = [(e["doc_id"], e["tf"], e["len"], p) for e, p in zip(b["entries"], b["positions"])]
        got[b[CELL], b["field"], b["term"]] = entries
        assert b["n"] == len(entries) and b["n_tokens"] == sum(e[1] for e in entries)
        assert b["n_first"] == sum(e[3][0] == 0 for e in entries)
        assert (b["max_tf"], b["min_len"]) == (max(e[1] for e in entries), 400)
    assert got == wanted and len(blocks) == len(got)
