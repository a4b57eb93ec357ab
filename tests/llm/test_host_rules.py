from collections import Counter

from oracle import difference, duck

from quillstack.llm import host_rules as hr
from quillstack.llm.queries import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"


def brute_repeat(words):
    wins = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    count = Counter(wins)
    return len({i + k for i, w in enumerate(wins) if count[w] > 1 for k in range(5)})


def test_repeat_words():
    import random

    rng = random.Random(1)
    for _ in range(300):
        words = [rng.choice("ab") for _ in range(rng.randint(0, 40))]
        assert hr.repeat_words(words) == brute_repeat(words)


def test_equals_sql(spark):
    frame = QUERIES["op8_host_rules"](spark, FOLDER).toPandas()
    assert difference(frame, duck(FOLDER).sql(SQL["op8_host_rules"]).df()) is None


def test_hosts_and_odd_rows(spark):
    good = " ".join(f"w{i}" for i in range(30))
    bad = "# * $ %\n" * 8
    rows = [(i, good, "good.org") for i in range(40)] + [(100 + i, bad, "spam.biz") for i in range(40)]
    rows += [(200, good, "spam.biz"), (201, good, None), (202, None, "good.org"), (203, "", None),
             (204, "x" * 300_000 + " a" * 50_000, "good.org"), (0, good, "good.org"), (None, good, "good.org")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, kept int")
    out = hr.judge(docs)
    assert out.columns[0] == "doc_id" and out.count() == len(rows)
    kept = {r.doc_id: r.kept for r in out.collect()}
    assert kept[0] and kept[201] and kept[None]
    assert not kept[200], "the host of spam takes its clean document with it"
    assert not kept[202] and not kept[203] and not kept[204] and not kept[100]
    assert hr.judge(docs.limit(0)).count() == 0


def test_shrinking(spark):
    """A host of one failed document is not condemned by it."""
    good = " ".join(f"w{i}" for i in range(30))
    rows = [(i, good, f"h{i % 10}") for i in range(400)] + [(900, "three words only", "lone"), (901, "x", "h1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    rates = {r.host: r for r in hr.host_rates(hr.add_rules(hr.measure(docs, "source"))).collect()}
    assert rates["lone"].n_docs == 1 and 0 < rates["h1"].short_rate < rates["lone"].short_rate
    assert rates["h1"].short_rate > rates["h2"].short_rate > 0
