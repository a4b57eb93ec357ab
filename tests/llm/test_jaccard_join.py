import random

import numpy as np

from quillstack.llm import jaccard_join as jj
from quillstack.llm.common import WORD
from quillstack.llm.components import components
from quillstack.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"


def plain_set(text):
    lowered = "".join(ch.lower() if "A" <= ch <= "Z" else ch for ch in text or "")
    words = WORD.findall(lowered)
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + 4]) for i in range(max(1, len(words) - 3)))


def brute(docs):
    """Smallest id reachable by links, over all pairs that share a shingle."""
    whole = {i: plain_set(t) for i, t in docs}
    holders = {}
    for i, s in whole.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    top = {i: i for i in whole}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    done = set()
    for ids in holders.values():
        for p, a in enumerate(ids):
            for b in ids[p + 1:]:
                if (a, b) not in done:
                    done.add((a, b))
                    same = len(whole[a] & whole[b])
                    if 100 * same >= 85 * len(whole[a] | whole[b]):
                        x, y = sorted((find(a), find(b)))
                        top[y] = x
    return {i: (len(s), find(i)) for i, s in whole.items()}


def result(frame):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in frame.collect()}


def test_prefix_bound():
    """Similar sets share at least min(k, k') of their prefixes, whatever the k."""
    rng = np.random.default_rng(0)
    for _ in range(300):
        base = rng.choice(2**20, rng.integers(1, 120), replace=False).astype(np.uint64)
        x = np.unique(base)
        y = np.unique(np.concatenate([base[rng.random(len(base)) > 0.06], rng.integers(2**21, 2**22, rng.integers(0, 8)).astype(np.uint64)]))
        hot = np.sort(rng.choice(base, len(base) // 3, replace=False)).astype(np.uint32)
        levels = rng.integers(1, 12, len(hot))
        same = len(np.intersect1d(x, y))
        if not len(y) or 100 * same < 85 * (len(x) + len(y) - same):
            continue
        cut = []
        ks = []
        for s in (x, y):
            token, _ = jj.ordered(s, hot, levels)
            need = int(jj.needed(len(s), 85))
            k = int(rng.choice(jj.CHOICES[jj.CHOICES <= need]))
            ks.append(k)
            cut.append(set(token[: len(s) - need + k].tolist()))
        assert len(cut[0] & cut[1]) >= min(ks)


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 200), (200, 150), (300, 301)] + [(500, k) for k in range(501, 560)]
    found = components(spark.createDataFrame(links, "a long, b long")).collect()
    got = {r.node: r.component for r in found}
    assert all(got[i] == 0 for i in range(61)) and got[150] == got[200] == 100 and got[301] == 300 and got[559] == 500


def test_brute_force(spark):
    rng = random.Random(8)
    docs = []
    for g in range(25):
        base = [f"w{rng.randint(0, 400)}" for _ in range(rng.randint(5, 150))]
        for _ in range(rng.randint(1, 12)):
            words = [w if rng.random() > 0.012 else f"x{rng.randint(0, 99)}" for w in base]
            docs.append(" ".join(words).upper() if rng.random() < 0.2 else "  ".join(words))
    docs += ["a b c", "A b\nc", "a", "", " ", "ä b c", "Ä b c"]
    rows = list(enumerate(docs))
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(jj.join(frame)) == brute(rows)
    assert result(jj.join(frame, hot=0)) == brute(rows)


def test_whole_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    assert result(QUERIES["op9_jaccard_prefixes"](spark, FOLDER)) == brute(docs)


def test_odd_rows(spark):
    long = " ".join(f"t{i}" for i in range(60_000))
    rows = [(1, "a b c d e", 0), (1, "a b c d e", 0), (2, "a b c d e", 0), (3, None, 0), (4, "", 0), (5, long, 0),
            (6, long + " end", 0), (None, "a b c d e", 0), (None, "only here", 0), (7, "x" * 300_000, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n long")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jj.join(docs).collect()), key=str)
    want = [(1, 2, 1), (1, 2, 1), (2, 2, 1), (3, 0, 3), (4, 0, 4), (5, 59_997, 5), (6, 59_998, 5), (None, 2, 1),
            (None, 1, None), (7, 1, 7)]
    assert got == sorted(want, key=str)
    assert jj.join(docs.limit(0)).count() == 0


def test_words_of_many_texts_are_hashed_at_once():
    """The words of a whole batch without a Python step for each: equal words have equal
    values, and the shingles of each text are those of the text alone."""
    rng = random.Random(3)
    pieces = ["a", "B", "b", "\u00e9", "\x00", "\x1f", "\u00a0", " ", "\t", "\x0b", "\n", "wordofnine", "Long" * 20]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(60))).encode() for _ in range(800)]
    texts += [None, b"", b" ", b"x" * 8, b"x" * 9, b"x" * 64, b"x" * 65, b"a\x00", b"a", b"a b c", b"a b c d"]
    value, ends = jj.word_hashes(texts)
    words = [(t or b"").lower().split() for t in texts]
    flat = [w for ws in words for w in ws]
    assert ends.tolist() == np.cumsum([len(ws) for ws in words]).tolist()
    assert len(set(flat)) == len(set(value.tolist())) == len(set(zip(flat, value.tolist())))
    for text, own in zip(texts, jj.shingles(texts)):
        assert len(own) == len(plain_set((text or b"").decode()))
        assert np.array_equal(own, jj.shingles([text])[0])
    assert jj.shingles([]) == []
