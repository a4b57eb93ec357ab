import hashlib
import random

import numpy as np

from quillstack.llm import phrase_dedup as pd
from quillstack.llm.common import WORD, WordHashes, sequence_hashes
from quillstack.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"


def brute(docs):
    seen, out = set(), {}
    for i, text in sorted(docs.items()):
        words = WORD.findall(text or "")
        gone = set()
        for s in range(len(words) - 19):
            key = tuple(words[s:s + 20])
            if key in seen:
                gone.update(range(s, s + 20))
            seen.add(key)
        kept = [w for k, w in enumerate(words) if k not in gone]
        out[i] = len(words), len(gone), " ".join(kept)
    return out


def result(frame):
    return {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in frame.collect()}


def test_every_window_has_its_anchor():
    rng = random.Random(1)
    docs = [[rng.choice([b"a", b"b", b"c"]) for _ in range(n)] for n in (5, 20, 21, 90, 0, 60)]
    found = pd.Slice(docs, WordHashes())
    covered = {}
    for p, a, b, fp in zip(found.places, found.low, found.high, found.anchors):
        assert found.owner[a] == found.owner[b + 19] and a <= p <= b + 12 and p >= b
        for s in range(a, b + 1):
            covered.setdefault(s, set()).add(int(fp))
    starts = [s + k for s, e in zip(found.starts, found.ends) for k in range(max(0, e - s - 19))]
    grams = sequence_hashes(found.h, 8)
    assert covered == {s: {int(grams[s:s + 13].min())} for s in starts}


def test_automaton_equals_search():
    rng = random.Random(2)
    words = [rng.choice([b"aa", b"b", b"c"]) for _ in range(3000)]
    phrases = [tuple(rng.choice([b"aa", b"b", b"c"]) for _ in range(8)) for _ in range(40)]
    phrases += [tuple(f"w{i}{k}".encode() for k in range(8)) for i in range(30)]
    got = pd.PhraseAutomaton(sorted(set(phrases))).find(words)
    want = [k for k in range(len(words) - 7) if tuple(words[k:k + 8]) in set(phrases)]
    assert got.tolist() == want


def test_brute_force(spark):
    rng = random.Random(3)
    base = [[f"w{rng.randint(0, 3000)}" for _ in range(120)] for _ in range(6)]
    docs = {}
    for i in range(160):
        words = []
        for _ in range(rng.randint(1, 4)):
            if rng.random() < 0.6:
                part = rng.choice(base)
                a = rng.randint(0, 90)
                words += part[a:a + rng.randint(5, 60)]
            else:
                words += [f"x{rng.randint(0, 10**6)}" for _ in range(rng.randint(0, 30))]
        docs[i] = " ".join(words)
    docs[500] = "la " * 200
    docs[501] = " ".join(base[0]) + "\n" + "\t".join(base[0])
    rows = list(docs.items())
    rng.shuffle(rows)
    assert result(pd.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(docs)


def test_whole_table(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in QUERIES["op6_phrase_automata"](spark, FOLDER).collect()}
    want = {i: (n, g, hashlib.sha256(k.encode()).hexdigest()) for i, (n, g, k) in brute(docs).items()}
    assert got == want


def test_odd_rows(spark):
    text = " ".join(f"w{i}" for i in range(30))
    long = " ".join(f"z{i}" for i in range(80_000))
    rows = [(2, text, 1), (2, text, 1), (3, text, 1), (4, None, 1), (5, "", 1), (6, "a b", 1), (None, text, 1),
            (7, long, 1), (8, "q" * 300_000, 1), (9, "ü b " * 25, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept int")
    got = sorted(((r.doc_id, r.n_words, r.n_removed) for r in pd.remove_repeats(docs).collect()), key=str)
    want = [(2, 30, 0), (2, 30, 0), (3, 30, 30), (4, 0, 0), (5, 0, 0), (6, 2, 0), (None, 30, 0), (7, 80_000, 0), (8, 1, 0),
            (9, 25, 24)]
    assert got == sorted(want, key=str)
    assert pd.remove_repeats(docs.limit(0)).count() == 0
    assert np.array_equal(pd._sliding(np.arange(20), np.minimum), np.arange(8))
