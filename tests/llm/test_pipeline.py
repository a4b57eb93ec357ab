"""The pipeline, each stage judged on its own input."""

import hashlib
import random

import corpus_pipeline
from pyspark.sql import functions as F
from test_jaccard_join import brute as components_of
from test_line_dedup import brute_passages

from quillstack.llm.queries import line_stage, near_duplicate_stage, toxicity_stage

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    start = spark.read.parquet(f"{FOLDER}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "jaccard_join", "mixing", "byte_bpe"]
    docs, seen = start, {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = stage(spark, docs, FOLDER).cache()
        after = {r.doc_id: r for r in docs.collect()}
        if name != "byte_bpe":
            assert docs.schema == start.schema
        assert after.keys() <= before.keys() and len(after) == docs.count()
        seen[name] = before, after
    before, after = seen["line_dedup"]
    want = {i: t for i, t in brute_passages(before, 3, 50).items() if t.split() or t == before[i]}
    assert {i: r.text for i, r in after.items()} == want
    before, after = seen["jaccard_join"]
    assert after.keys() == {c for _, c in components_of(list(before.items())).values()}
    before, after = seen["mixing"]
    assert 0.3 * len(before) < len(after) <= len(before)
    before, after = seen["byte_bpe"]
    assert {i: r.decoded_sha256 for i, r in after.items()} == {
        i: hashlib.sha256(t.encode()).hexdigest() for i, t in before.items()}


def test_run(spark):
    found = corpus_pipeline.run(spark, FOLDER)
    assert found.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and found.count() > 30


def first_of_groups(docs, percent=80, width=5):
    """Smallest id of each group linked by similar sets of words in a row, over all pairs."""
    sets = {}
    for i, text in docs:
        words = "".join(c.lower() if c.isascii() else c for c in text or "").split()
        sets[i] = {tuple(words[k:k + width]) for k in range(max(1, len(words) - width + 1))} if words else set()
    top = {i: i for i in sets}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            same = len(sets[a] & sets[b])
            if same and 100 * same >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                top[y] = x
    return {find(i) for i in ids}


def test_near_duplicates_at_five_words(spark):
    """Copies whose last words differ: 0.8 on five words can be less than 0.85 on four."""
    rng = random.Random(3)
    docs = []
    for _ in range(30):
        words = [f"w{rng.randint(0, 10**6)}" for _ in range(rng.randint(40, 120))]
        for _ in range(rng.randint(1, 4)):
            change = rng.randint(0, len(words) // 7)
            docs.append(" ".join(words[:len(words) - change] + [f"x{rng.randint(0, 10**6)}" for _ in range(change)]))
    docs = list(enumerate(docs))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = [r.doc_id for r in near_duplicate_stage(spark, frame, None).collect()]
    want = first_of_groups(docs)
    assert sorted(got) == sorted(want)
    assert want != first_of_groups(docs, 85, 4)


def test_near_duplicates_of_a_table(spark):
    frame = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    got = [r.doc_id for r in near_duplicate_stage(spark, frame, None).collect()]
    assert sorted(got) == sorted(first_of_groups([(r.doc_id, r.text) for r in frame.collect()]))


def test_near_duplicates_without_good_ids(spark):
    """Null and repeated ids: one document of each group, whatever its id."""
    a = " ".join(f"w{i}" for i in range(40))
    rows = [(1, a, "p"), (1, a, "q"), (2, a + " more", "r"), (3, "other words entirely", "s"), (3, a, "t"),
            (None, a, "u"), (None, a, "v"), (None, "alone here", "w"), (4, None, "x"), (4, None, "y"), (5, "", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, h string").withColumn("row", F.lit(1)).withColumn(
        "key", F.lit("k"))
    kept = near_duplicate_stage(spark, docs, None)
    assert kept.dtypes == docs.dtypes
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    assert got == sorted([(1, a), (3, "other words entirely"), (None, "alone here"), (4, None), (4, None), (5, "")], key=str)
    assert near_duplicate_stage(spark, docs.limit(0), None).count() == 0


def test_stages_of_odd_tables(spark):
    names = "doc_id long, text string, lang string, source string, n_chars long, score double, features string"
    long = "\n".join(f"a calm line number {i} of a long text" for i in range(3000))
    rows = [(1, None, None, None, None, None, None), (None, "a few calm words", "en", "s", 1, 0.5, "f"),
            (2, "", "en", None, 0, None, None), (3, long, "en", "s", 9, 1.0, "f"), (3, long, "en", "s", 9, 1.0, "f")]
    docs = spark.createDataFrame(rows, names)
    for stage in (toxicity_stage, line_stage, near_duplicate_stage):
        assert stage(spark, docs.limit(0), FOLDER).count() == 0
        out = stage(spark, docs, FOLDER)
        assert out.dtypes == docs.dtypes
        copies = 1 if stage is near_duplicate_stage else 2
        assert sorted((str(r.doc_id), len(r.text or "")) for r in out.collect()) == sorted(
            [("1", 0), ("None", 16), ("2", 0)] + [("3", len(long))] * copies)
