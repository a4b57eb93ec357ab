import random

import numpy as np
from oracle import difference, duck

from quillstack.llm import line_dedup as ld
from quillstack.llm.queries import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"


def brute(docs, run):
    seen, out = set(), {}
    for i, text in sorted(docs.items()):
        lines = ld.lines_of(text)
        gone = set()
        for s in range(len(lines) - run + 1):
            key = tuple(x for _, x in lines[s:s + run])
            if key in seen:
                gone |= {lines[k][0] for k in range(s, s + run)}
            seen.add(key)
        out[i] = "\n".join(x for k, x in enumerate(text.split("\n")) if k not in gone)
    return out


def test_fingerprint_of_every_window():
    rng = np.random.default_rng(2)
    for n in range(3, 40):
        h = rng.integers(0, 5, n).astype(np.uint64)
        places, first = ld.fingerprints(h, 3)
        assert len(places) == n - 2 and first[0] == 0
        assert all(s <= p < s + 3 and h[p] == h[s:s + 3].min() for s, p in enumerate(places))


def test_brute_force(spark):
    rng = random.Random(4)
    docs = {i: "\n".join(rng.choice(["a", "b", " c ", "c", "", "d e"]) for _ in range(rng.randint(1, 30)))
            for i in range(150)}
    docs[200] = docs[201] = "\n".join(f"line {i}" for i in range(500))
    for run in (2, 3):
        frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
        got = {r.doc_id: r.text for r in ld.dedupe_lines(frame, run).collect()}
        assert got == brute(docs, run)


def test_equals_sql(spark):
    frame = QUERIES["op10_line_winnowing"](spark, FOLDER).toPandas()
    assert difference(frame, duck(FOLDER).sql(SQL["op10_line_winnowing"]).df()) is None


def test_odd_rows(spark):
    long = "\n".join(f"l{i}" for i in range(60_000))
    rows = [(1, "a\nb\nc", "x", "y"), (1, "a\nb\nc", "x", "y"), (2, " a\nb \n\nc\nd", "x", "y"), (3, None, "x", "y"),
            (4, "", "x", "y"), (None, "a\nb\nc", "x", "y"), (5, long, "x", "y"), (6, "x" * 400_000, "x", "y"),
            (7, "p\np\np\np", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_lines string, key string")
    out = ld.dedupe_lines(docs)
    assert out.columns == ["doc_id", "text", "key", "n_lines", "n_deleted"]
    got = sorted(((r.doc_id, r.text, r.n_lines, r.n_deleted) for r in out.collect()), key=str)
    assert len(got) == len(rows)
    want = [(1, "", 3, 3), (1, "", 3, 3), (2, "\nd", 4, 3), (3, None, 0, 0), (4, "", 0, 0), (None, "a\nb\nc", 3, 0),
            (5, long, 60_000, 0), (6, "x" * 400_000, 1, 0), (7, "", 4, 3)]
    assert [g for g in got if g[0] != 7] == sorted((w for w in want if w[0] != 7), key=str)
    assert next(g for g in got if g[0] == 7) == (7, "p", 4, 3)
    assert ld.dedupe_lines(docs.limit(0)).count() == 0


def brute_passages(docs, run, words):
    """As ``brute``, with windows of fewer lines that hold ``words`` words as runs too."""
    seen, out = set(), {}
    for i, text in sorted(docs.items()):
        lines = ld.lines_of(text)
        gone = set()
        for size in range(1, run + 1):
            for s in range(len(lines) - size + 1):
                key = tuple(x for _, x in lines[s:s + size])
                if size < run and sum(len(x.split()) for x in key) < words:
                    continue
                if key in seen:
                    gone |= {lines[k][0] for k in range(s, s + size)}
                seen.add(key)
        out[i] = "\n".join(x for k, x in enumerate(text.split("\n")) if k not in gone)
    return out


def test_long_passages(spark):
    long, half = " ".join(f"w{i}" for i in range(50)), " ".join(f"h{i}" for i in range(25))
    short = " ".join(f"w{i}" for i in range(49))
    docs = {1: f"{long}\na", 2: f"b\n{long}", 3: long, 4: f"{half}\n{half} x", 5: f"c\n{half}\n \n{half} x\nd",
            6: short, 7: short, 8: f"{long}\n{long}"}
    rng = random.Random(6)
    for i in range(100, 200):
        docs[i] = "\n".join(rng.choice([long, half, short, "a", "b c", ""]) for _ in range(rng.randint(1, 12)))
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {r.doc_id: r.text for r in ld.dedupe_lines(frame, passage_words=50).collect()}
    assert got == brute_passages(docs, 3, 50)
    assert (got[2], got[3], got[5], got[7]) == ("b", "", "c\n \nd", short)


def test_long_passages_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r.text for r in ld.dedupe_lines(docs, passage_words=50).collect()}
    assert got == brute_passages(texts, 3, 50) != brute(texts, 3)
