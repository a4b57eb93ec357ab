import zlib

import numpy as np

from quillstack.llm import toxicity as tx
from quillstack.llm.queries import QUERIES, toxicity_stage

FOLDER = "/root/testdata/sf0.01"
LARGER = "/root/testdata/sf0.1"


def feature(text, name):
    codes = tx.Codes(["idiot", "scum"])
    return tx.features(text, codes, np.array([0.0, 2.0, 3.0]))[tx.FEATURES.index(name)]


def test_features_by_hand():
    text = "YOU are an 1d!ot, scum*** and idiot! x"
    assert feature(text, "hit_rate") == 3 / 8 and feature(text, "distinct_hits") == 2
    assert feature(text, "strongest") == 3.0 and feature(text, "disguised_hits") == 1 / 8
    assert feature(text, "near_you") == 2 and feature("you a b c d e idiot", "near_you") == 0
    assert feature(text, "caps_words") == 1 / 8 and feature(text, "you_rate") == 1 / 8
    assert feature(None, "hit_rate") == 0 and feature(" \n", "log_words") == 0
    assert tx.units("scummy") == ["scummy", "scum*", "scumm*", "scummy*"]
    assert tx.Codes(["scum*"])["SCUMMY,"] & tx.HIT and not tx.Codes(["scum*"])["scu"] & tx.HIT
    assert tx.undisguised("12") is None and tx.undisguised("s-c-u-m") == "scum"


def test_held_out(spark):
    found = QUERIES["op4_toxicity"](spark, LARGER).collect()
    labels = dict(spark.read.parquet(f"{LARGER}/labels.parquet").select("doc_id", "toxic").collect())
    held = []
    for r in found:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
        if r.held_out and r.doc_id in labels:
            held.append((labels[r.doc_id], r.predicted))
    tp = sum(y and p for y, p in held)
    print("held", len(held), "tp", tp, "toxic", sum(y for y, _ in held), "predicted", sum(p for _, p in held))
    assert tp >= 0.9 * sum(y for y, _ in held) and tp >= 0.9 * sum(p for _, p in held)


def test_odd_rows(spark):
    rows = [(i, "you utter idiot and scum " * 3 + f"w{i}", 1, "x") for i in range(60)]
    rows += [(100 + i, f"a calm text about trees {i} " * 4, 0, "x") for i in range(200)]
    rows += [(900, None, 1, "x"), (901, "", 0, "x"), (902, "scum " * 100_000, None, "x"), (0, "y", 2, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label int, score string")
    model = tx.train(docs)
    assert {"idiot", "scum"} <= {w for w, _ in model.lexicon}
    got = model.score(docs).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r.score for r in got}
    assert by[5] > 0.9 and by[150] < 0.1 and by[901] < 0.5 and 0 <= by[900] <= 1
    assert model.score(docs.limit(0)).count() == 0
    none = tx.train(docs.limit(0))
    assert {r.predicted for r in none.score(docs).collect()} == {0}
    assert {r.predicted for r in tx.train(docs.filter("label = 1")).score(docs).collect()} == {1}


def test_stage_keeps_columns(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    kept = toxicity_stage(spark, docs, FOLDER)
    assert kept.schema == docs.schema
    assert 0.7 * docs.count() < kept.count() < docs.count()
