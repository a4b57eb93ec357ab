import zlib

import numpy as np
from pyspark.sql import functions as F

from quillstack.llm import quality
from quillstack.llm.common import WordHashes
from quillstack.llm.queries import QUERIES

LARGER = "/root/testdata/sf0.1"


def by_loop(text, model, of):
    """The score with one n-gram at a time, in plain Python integers."""
    factor, wide = 0x9E3779B97F4A7C15, 2**64 - 1
    hashes = WordHashes()
    words = text.encode().split() if text else []
    rows = [(hashes[w] * factor & wide) >> 48 for w in words]
    for a, b in zip(words, words[1:]):
        both = quality.sequence_hashes(np.array([hashes[a], hashes[b]], np.uint64), 2)
        rows.append(0 if a == b else (int(both[0]) * factor & wide) >> 48)
    for w in words:
        w = b" " + w + b" "
        for n in quality.SIZES:
            for k in range(len(w) - n + 1):
                code = 0
                for byte in w[k:k + n]:
                    code = (code * factor + byte) & wide
                rows.append(((code + n) * factor & wide) >> 48)
    p = model.parameters
    mean = p.table[rows].mean(axis=0) if rows else np.zeros(p.table.shape[1])
    return quality.softmax(p.weights @ mean + p.offsets)[model.classes.index(of)]


def random_model(classes):
    p = quality.Parameters.start(len(classes), 8, 1)
    p.table[:] = np.random.default_rng(2).normal(size=p.table.shape) * 20
    p.offsets[:] = np.arange(len(classes)) / 3
    return quality.QualityModel(classes, p)


def test_scores_equal_a_loop(spark, monkeypatch):
    texts = [None, "", " \n", "a", "one two two two three", "ÄÖ ß!! x" * 30, "b" * 3000, "the end " * 500, "x y\tz " * 40_000]
    model = random_model(["bad", "fair", "good"])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = dict(model.score(docs, "good").collect())
    for i, text in enumerate(texts[:-1]):
        assert abs(got[i] - by_loop(text, model, "good")) < 1e-5, i
    monkeypatch.setattr(quality, "SLICE", 7)
    monkeypatch.setattr(quality, "WORDS_AT_ONCE", 3)
    hashes = WordHashes()
    for text in texts[:-1]:
        small = quality.counts(text, hashes)
        monkeypatch.setattr(quality, "SLICE", 1 << 18)
        monkeypatch.setattr(quality, "WORDS_AT_ONCE", 1 << 15)
        assert (small == quality.counts(text, hashes)).all()
        monkeypatch.setattr(quality, "SLICE", 7)
        monkeypatch.setattr(quality, "WORDS_AT_ONCE", 3)


def test_held_out(spark):
    found = QUERIES["op13_subword_quality"](spark, LARGER).collect()
    labels = dict(spark.read.parquet(f"{LARGER}/labels.parquet").select("doc_id", "quality").collect())
    assert len(found) == 10_000
    held = []
    for r in found:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
        if r.held_out and r.doc_id in labels:
            held.append((labels[r.doc_id], r.predicted))
    good = [p for y, p in held if y == 1]
    bad = [p for y, p in held if y == 0]
    assert len(bad) > 100 and sum(good) >= 0.99 * len(good) and sum(bad) <= 0.1 * len(bad)


def test_odd_rows(spark):
    rows = [(i, f"wild!! shout!! w{i}!! " * 5, 0, "x") for i in range(100)]
    rows += [(100 + i, f"a calm text about trees {i} " * 5, 1, "x") for i in range(200)]
    rows += [(900, None, 1, "x"), (901, "", 0, "x"), (902, "scum " * 200_000, None, "x"), (None, "y", 1, None)] + [(5, "dup", 1, "x")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, label int, row string")
    docs = docs.withColumn("score", F.lit("clash")).withColumn("_", F.lit(1))
    model = quality.train(docs, F.col("text"), F.col("label"))
    assert model.classes == [0, 1]
    scored = model.score(docs, 1)
    assert scored.columns == ["doc_id", "label", "row", "_", "score"]
    got = scored.collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r.score for r in got}
    assert by[7] < 0.3 < 0.7 < by[150] and by[900] == by[901] and 0 <= by[902] <= 1
    assert model.score(docs.select("text"), 1).count() == len(rows)
    assert model.score(docs.limit(0), 1).count() == 0
    none = quality.train(docs.limit(0), F.col("text"), F.col("label"))
    assert none.classes == [] and {r.score for r in none.score(docs, 1).collect()} == {0.0}
    one = quality.train(docs.filter("label = 1"), F.col("text"), F.col("label"))
    assert {r.score for r in one.score(docs, 1).collect()} == {1.0}
    again = quality.train(docs.repartition(3), F.col("text"), F.col("label"))
    assert np.abs(again.parameters.table - model.parameters.table).max() < 1e-4
