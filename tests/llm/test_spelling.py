import random
import re
import zlib

import numpy as np
import pytest
from oracle import duck

from quillstack.llm import spelling as sp
from quillstack.llm.queries import QUERIES, SQL

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = {65 + k: 97 + k for k in range(26)}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def by_pairs(words, factor=5):
    out = []
    best = {}
    for w, n in words.items():
        found = [x for x in words if near(w, x)]
        top = min(found, key=lambda x: (-words[x], x), default=None)
        best[w] = (top if top is not None and words[top] >= factor * n else None, len(found))
    for w, n in words.items():
        root = w
        while best[root][0] is not None:
            root = best[root][0]
        form, n_near = best[w]
        out.append((w, form, root, n, n_near, None if form is None else words[form]))
    return sorted(out, key=str)


def grouped(spark, words):
    frame = spark.createDataFrame(list(words.items()), "word string, n long")
    return sorted((tuple(r) for r in sp.group_variants(frame).collect()), key=str)


@pytest.mark.parametrize("letters,sizes,cell", [("abé", (5, 6, 7), 40), ("abcdefghÿ", (4, 5), 10_000), ("aΩжü", (4, 5), 25)])
def test_pairs_by_brute_force(spark, monkeypatch, letters, sizes, cell):
    """In one cell, in many, and in cells that had to be split into parts."""
    monkeypatch.setattr(sp, "CELL_WORDS", cell)
    rng = random.Random(len(letters))
    words = {"".join(rng.choice(letters) for _ in range(rng.choice(sizes))): rng.choice([1, 2, 5, 7, 30, 200, 2000])
             for _ in range(500)}
    assert grouped(spark, words) == by_pairs(words)


def test_crowded_cell(spark, monkeypatch):
    """Words of the same letters cannot be told apart by counts: parts of one cell."""
    monkeypatch.setattr(sp, "CELL_WORDS", 16)
    rng = random.Random(9)
    words = {"".join(rng.sample("abcdefg", 7)): rng.choice([1, 9, 60]) for _ in range(200)}
    words |= {w[:k] + "z" + w[k + 1:]: 400 for w, k in [(w, rng.randint(0, 6)) for w in list(words)[:60]]}
    assert grouped(spark, words) == by_pairs(words)


def test_counted_words(spark):
    text = "Straße STRASSE straße×x café €caféine’s Δelta naïve\tnaïve_no Zürich " * 3
    rows = [(1, text), (1, text), (None, text), (2, None), (3, ""), (4, "longword " * 50_000), (5, "q" * 300_000)]
    rows += [(i, "different wordings of several planted letters") for i in range(100, 400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want, altered = {}, 0
    for i, t in rows:
        for run in RUN.findall(t or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                altered += 1
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            want[run] = want.get(run, 0) + 1
    assert altered > 3
    got = dict(sp.counted_words(docs).collect())
    assert got == {w: n for w, n in want.items() if len(w) >= 6 and n >= 5}
    plain = dict(sp.counted_words(docs, modulus=None, min_length=1, min_count=1).collect())
    assert plain["q" * 300_000] == 1 and plain["longword"] == 50_000 and plain["straße"] == 9
    assert sp.counted_words(docs.limit(0)).count() == 0


def test_odd_words(spark):
    long = "x" * 5_000
    words = {"a": 1, "b": 9, "ab": 60, long: 1, long + "y": 50, long[:-1] + "z": 7, "alone": 3, "éé": 2, "é": 1}
    assert grouped(spark, words) == by_pairs(words)
    frame = spark.createDataFrame([(None, 3), ("", 4)], "word string, n long")
    assert sp.group_variants(frame).count() == 0
    chain = {"w" + "v" * k: 6 ** k for k in range(1, 12)}
    assert grouped(spark, chain) == by_pairs(chain)


def test_letters_one_by_one():
    rng = np.random.default_rng(5)
    for _ in range(300):
        a, b = rng.integers(97, 99, (1, 5)).astype(np.uint8), rng.integers(97, 99, (1, 4)).astype(np.uint8)
        assert sp.one_longer(a, b)[0] == near("".join(map(chr, a[0])), "".join(map(chr, b[0])))


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_equals_sql(spark, folder):
    frame = QUERIES["op12_letter_count_trees"](spark, folder)
    sql = duck(folder).sql(SQL["op12_letter_count_trees"])
    place = [sql.columns.index(c) for c in frame.columns]
    assert len(place) == len(sql.columns)
    assert sorted((tuple(r) for r in frame.collect()), key=str) == sorted(
        (tuple(r[k] for k in place) for r in sql.fetchall()), key=str)
