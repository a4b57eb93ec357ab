import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillstack.llm import mixing as mx
from quillstack.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"


def cells(seed=0):
    rng = np.random.default_rng(seed)
    return pd.DataFrame([(f"s{s}", g, t, float(rng.integers(50, 500))) for s in range(4) for g in ("en", "de", None)
                         for t in range(3)], columns=[*mx.DIMENSIONS, "tokens"])


def plain_rake(table, targets, budget, rounds):
    """The textbook loop over rows."""
    w = [budget / table.tokens.sum()] * len(table)
    for _ in range(rounds):
        for d, shares in targets.items():
            sums = {}
            for x, v, t in zip(w, table[d], table.tokens):
                sums[v] = sums.get(v, 0) + x * t
            w = [x * shares[v] * budget / sums[v] for x, v in zip(w, table[d])]
    return np.array(w)


def test_margins_met():
    table = cells()
    targets = {d: mx.tempered(table, d, 0.5) for d in mx.DIMENSIONS}
    budget = 0.4 * table.tokens.sum()
    w = mx.rake(table, targets, budget)
    for d, shares in targets.items():
        got = (table.tokens * w).groupby(table[d].fillna("none")).sum() / budget
        for value, share in shares.items():
            assert got["none" if pd.isna(value) else value] == pytest.approx(share, abs=1e-6)
    plain = {d: {None if pd.isna(k) else k: v for k, v in s.items()} for d, s in targets.items()}
    named = table.astype({"lang": object}).where(table.notna(), None)
    assert w == pytest.approx(plain_rake(named, plain, budget, 300), abs=1e-6)


def test_weights_stay_probabilities():
    table = cells(1)
    targets = {"source": {"s0": 0.97, "s1": 0.01, "s2": 0.01, "s3": 0.01}, "topic": {0: 0.4, 1: 0.3, 2: 0.3}}
    w = mx.rake(table, targets, 0.9 * table.tokens.sum())
    assert w.min() >= 0 and w.max() == 1.0 and (w[table.source == "s0"] == 1).all()


def test_sample_follows_probabilities(spark):
    found = QUERIES["op2_raked_mixture"](spark, FOLDER).toPandas()
    assert len(found) == 1000 and found.probability.between(0, 1).all()
    expected = (found.probability * found.n_tokens).sum()
    assert expected == pytest.approx(0.6 * found.n_tokens.sum(), rel=0.01)
    kept = found[found.kept]
    assert abs(len(kept) - found.probability.sum()) < 4 * np.sqrt((found.probability * (1 - found.probability)).sum() + 1)
    assert found.topic.nunique() > 3
    again = QUERIES["op2_raked_mixture"](spark, FOLDER).toPandas()
    assert set(again[again.kept].doc_id) == set(kept.doc_id)


def test_odd_rows(spark):
    rows = [(i, f"text number {i} of many words {i % 7}", "en" if i % 3 else None, None if i % 5 == 0 else f"s{i % 2}", True)
            for i in range(200)]
    rows += [(900, None, "en", "s0", True), (901, "", "de", "s1", True), (902, "word " * 80_000, "fr", "s9", None), rows[0]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, kept boolean")
    out = mx.mix(docs)
    assert out.columns == ["doc_id", "text", "lang", "source", "topic", "n_tokens", "probability", "kept"]
    got = out.collect()
    assert len(got) == len(rows) and {r.probability for r in got if r.doc_id in (900, 901)} == {0.0}
    assert len({(r.kept, r.probability) for r in got if r.doc_id == 0}) == 1
    assert mx.mix(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        mx.mix(docs, max_cells=2)


def test_topics_over_all_documents(spark):
    """Means and centres come from all rows, however few texts start the centres."""
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(f"{'ab'[i % 2]}{rng.integers(0, 9)}" for _ in range(30)), "en") for i in range(400)]
    rows += [(1000 + i, f"r{i} r r", "rare") for i in range(2)] + [(2000 + i, "copy of one text", "en") for i in range(300)]
    rows += [(3000, None, "en"), (3001, " ", "none"), (3002, "no language", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    topics = mx.learn_topics(mx.word_counts(docs, "lang"), count=3, sample=20)
    assert set(topics.means) == {"en", "rare", None} and len(topics.centres) == 3
    kept = [(t.encode().split(), g) for _, t, g in rows if t and t.split()]
    x, langs = topics.vectors([w for w, _ in kept], mx.WordHashes()), [g for _, g in kept]
    for name, mean in topics.means.items():
        own = np.array([g == name for g in langs])
        assert mean == pytest.approx(x[own].mean(axis=0), abs=1e-6)
    # A fixed point of k-means over all rows: each centre is the direction of its rows' sum.
    at = topics.assign(x, langs)
    away = x - np.array([topics.means[g] for g in langs])
    for k in range(3):
        total = away[at == k].sum(axis=0)
        assert topics.centres[k] == pytest.approx(total / np.linalg.norm(total), abs=1e-4)
    again = mx.learn_topics(mx.word_counts(docs.repartition(7), "lang"), count=3, sample=20)
    assert np.array_equal(again.centres, topics.centres)


def test_one_sampled_text_starts(spark):
    docs = spark.createDataFrame([(i, f"word{i} a b", "en") for i in range(50)], "doc_id long, text string, lang string")
    topics = mx.learn_topics(mx.word_counts(docs, "lang"), sample=0)
    assert len(topics.centres) == 1 and set(topics.means) == {"en"}


def test_given_targets_and_clashing_names(spark):
    rng = np.random.default_rng(7)
    rows = [(i, " ".join(f"w{rng.integers(0, 50)}" for _ in range(rng.integers(5, 40))), "en" if i % 4 else "de", f"s{i % 3}",
             1, 2, "x") for i in range(3000)]
    docs = spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, _topic int, _tokens int, row string")
    docs = docs.withColumn("s", F.lit(0)).withColumn("found", F.lit("f")).withColumn("p", F.lit(0.5))
    out = mx.mix(docs, budget_share=0.2, targets={"source": {"s0": 6, "s1": 2, "gone": 2}, "lang": {"en": 1, "de": 1}})
    assert out.columns == [*docs.columns, "topic", "n_tokens", "probability", "kept"]
    found = out.toPandas()
    share = (found.probability * found.n_tokens).groupby(found.source).sum() / found.n_tokens.sum()
    assert share["s0"] / share["s1"] == pytest.approx(3, rel=1e-3) and share["s2"] == 0
    by_lang = (found.probability * found.n_tokens).groupby(found.lang).sum()
    assert by_lang["en"] == pytest.approx(by_lang["de"], rel=1e-3)
    assert not found[found.source == "s2"].kept.any() and (found._topic == 1).all() and (found.p == 0.5).all()
    with pytest.raises(ValueError):
        mx.mix(docs, targets={"site": {}})


def test_query_by_plain_loop(spark):
    """The whole query: cells, raking and the draw, from the topics that the query found."""
    found = QUERIES["op2_raked_mixture"](spark, FOLDER).toPandas()
    words = {r.doc_id: len((r.text or "").split()) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    assert (found.n_tokens == found.doc_id.map(words)).all()
    table = found[found.n_tokens > 0].groupby(list(mx.DIMENSIONS), dropna=False, as_index=False).n_tokens.sum()
    table = table.rename(columns={"n_tokens": "tokens"})
    total = table.tokens.sum()
    targets = {}
    for d, power in zip(mx.DIMENSIONS, (0.8, 0.9, 0.8)):
        sums = table.groupby(d).tokens.sum() ** power
        targets[d] = dict(sums / sums.sum())
    weights = np.full(len(table), 0.6)
    for _ in range(500):
        for d, shares in targets.items():
            now = (weights * table.tokens).groupby(table[d]).sum()
            weights = np.minimum(weights * table[d].map(lambda v: shares[v] * 0.6 * total / now[v]), 1.0)
    want = found.merge(table.assign(want=weights), on=list(mx.DIMENSIONS), how="left").want.fillna(0.0)
    assert found.probability.to_numpy() == pytest.approx(np.where(found.n_tokens > 0, want, 0.0), abs=1e-6)
