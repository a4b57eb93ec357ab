import math

import pytest
from pyspark.sql import functions as F

from quillstack.operators import search
from quillstack.operators.highlight import highlights
from quillstack.operators.search_index import CELL, SearchIndex
from quillstack.operators.suggest import suggestions

DOCS = [
    (1, "red fox", "the quick red fox jumps over the lazy dog", "a", 10),
    (2, "blue fox", "the quick blue fox sleeps", "a", 20),
    (3, "red dog", "red red red dog", "b", 30),
    (4, "empty", "", "b", 40),
    (5, "none", None, "c", None),
    (6, "copy", "the quick red fox jumps over the lazy dog", "c", 5),
]


@pytest.fixture(scope="module")
def index(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, title string, text string, source string, size int")
    return SearchIndex.build(docs, "doc_id", ("text", "title"))


def queries(spark, *texts):
    return spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "query_id string, query_text string")


def ids(matches):
    return sorted((r["query_id"], r["doc_id"]) for r in matches.collect())


def test_normal_needs_all_words(spark, index):
    q = queries(spark, "red fox", "absent red", "")
    assert ids(search.match_normal(index, q)) == [("0", 1), ("0", 6)]
    both = search.match_normal(index, q, ("text", "title"), any_field=False)
    assert ids(both) == [("0", 1)]


def test_score_is_bm25(spark, index):
    row = search.match_normal(index, queries(spark, "dog")).filter("doc_id = 3").first()
    n, df, tf, length, avg = 4, 3, 1, 4, (9 + 5 + 4 + 9) / 4
    idf = math.log(1 + (n - df + 0.5) / (df + 0.5))
    assert row["score"] == pytest.approx(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / avg)))


def test_repeated_word_counts_twice(spark, index):
    once = search.match_normal(index, queries(spark, "dog")).filter("doc_id = 3").first()["score"]
    twice = search.match_normal(index, queries(spark, "dog dog")).filter("doc_id = 3").first()["score"]
    assert twice == pytest.approx(2 * once)


def test_phrase(spark, index):
    q = queries(spark, "quick red", "red quick", "red red", "red fox")
    assert ids(search.match_phrase(index, q)) == [("0", 1), ("0", 6), ("2", 3), ("3", 1), ("3", 6)]
    assert ids(search.match_phrase(index, q, ("text", "title"), any_field=False)) == [("3", 1)]


def test_wildcard(spark, index):
    q = queries(spark, "jum*", "?og", "RED", "*", "f?x", "a.c")
    got = ids(search.match_wildcard(index, q, ("text",), any_field=False))
    assert got == [("0", 1), ("0", 6), ("1", 1), ("1", 3), ("1", 6), *[("3", i) for i in (1, 2, 3, 6)],
                   ("4", 1), ("4", 2), ("4", 6)]


def test_fuzzy_swap_and_length(spark, index):
    q = queries(spark, "qucik", "fxo", "ded", "jupms lazi", "xx")
    assert ids(search.match_fuzzy(index, q)) == [
        ("0", 1), ("0", 2), ("0", 6), ("1", 1), ("1", 2), ("1", 6), ("2", 1), ("2", 3), ("2", 6),
        ("3", 1), ("3", 6),
    ]


def test_unknown_mode(spark, index):
    with pytest.raises(ValueError):
        search.match(index, queries(spark, "red"), "near")


def test_filters_keep_scores(spark, index):
    matches = search.match_normal(index, queries(spark, "fox"))
    before = {r["doc_id"]: r["score"] for r in matches.collect()}
    kept = search.apply_filters(
        index, matches, search.terms_filter("source", ["a"]), search.range_filter("size", gt=10, lte=20)
    )
    assert {r["doc_id"]: r["score"] for r in kept.collect()} == {2: before[2]}


def test_year_bounds(spark):
    df = spark.sql("SELECT explode(sequence(DATE'2013-12-30', DATE'2015-01-02')) AS d")
    def span(**b):
        r = df.filter(search.range_filter("d", **b)).agg(F.min("d"), F.max("d")).first()
        return str(r[0]), str(r[1])
    assert span(gte="2014", lte="2014") == ("2014-01-01", "2014-12-31")
    assert span(gt="2014")[0] == "2015-01-01"
    assert span(lt="2014")[1] == "2013-12-31"
    with pytest.raises(ValueError):
        search.range_filter("d", near="2014")


def test_sort_total_counts(spark, index):
    q = queries(spark, "fox", "absent")
    matches = search.match_normal(index, q)
    hits = search.sorted_hits(index, matches, ["-size", "source"]).orderBy("rank").collect()
    assert [r["doc_id"] for r in hits] == [2, 1, 6]
    assert {r["query_id"]: r["total"] for r in search.total_hits(q, matches).collect()} == {"0": 3, "1": 0}
    counts = search.value_counts(index, matches, "source").orderBy("rank").collect()
    assert [(r["value"], r["n"]) for r in counts] == [("a", 2), ("c", 1)]
    assert search.match_all(index, "all").count() == 6


def test_equal_scores_rank_by_document(spark, index):
    hits = search.top_hits(search.match_normal(index, queries(spark, "lazy dog"))).orderBy("rank").collect()
    assert [r["doc_id"] for r in hits] == [1, 6]


def test_index_reopens(spark, index):
    again = SearchIndex.open(spark, index.path)
    q = queries(spark, "red fox", "the", "qucik")
    for mode in search.MODES:
        a = {tuple(r) for r in search.match(index, q, mode).collect()}
        assert a == {tuple(r) for r in search.match(again, q, mode).collect()}
    places = index.postings(positions=True).filter("doc_id = 3 AND field = 'text' AND term = 'red'").first()
    assert list(places["positions"]) == [0, 1, 2] and places["tf"] == 3


def test_filter_before_matching(spark, index):
    q = queries(spark, "fox", "quick red")
    few = search.allowed(index, search.terms_filter("source", ["a"]))
    for mode in search.MODES:
        late = search.match(index, q, mode).join(few.select("doc_id"), "doc_id", "left_semi")
        early = search.match(index, q, mode, docs=few)
        key = ["query_id", "doc_id", "score"]
        assert {tuple(r) for r in late.select(key).collect()} == {tuple(r) for r in early.select(key).collect()}


def test_one_call(spark, index):
    request = search.SearchRequest(filters=(search.range_filter("size", gte=5),), count_by="source", columns=("size",),
                                   highlight="text")
    answer = search.run(index, queries(spark, "fox", ""), request)
    assert answer.hits.columns == ["query_id", "doc_id", "score", "rank", "size"]
    assert {r["query_id"]: r["total"] for r in answer.total.collect()} == {"0": 3, "1": 5}
    assert answer.counts.filter("query_id = '0'").count() == 2
    assert answer.fragments.filter("query_id = '0'").count() == 3


def test_nothing_moves_before_the_best_are_chosen(spark, index):
    """A filtered search joins, groups and scores without an exchange of postings."""
    few = search.allowed(index, search.terms_filter("source", ["a"]))
    plan = search.match_normal(index, queries(spark, "red fox"), docs=few)._jdf.queryExecution().executedPlan().toString()
    assert "In(term, [" in plan or "EqualTo(term" in plan or "In(" in plan
    assert "Exchange hashpartitioning" not in plan and "Bucketed: true" in plan


def test_filter_without_broadcast(spark, index):
    """Where nothing is small enough to broadcast, only postings of asked words and
    allowed documents are exchanged."""
    few = search.allowed(index, search.terms_filter("source", ["a"]))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = search.match_normal(index, queries(spark, "red fox"), docs=few)
        plan = found._jdf.queryExecution().executedPlan().toString()
        got = ids(found)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == [("0", 1)]
    lines = plan.splitlines()
    scan = next(k for k, line in enumerate(lines) if "FileScan parquet" in line and "_blocks[" in line)

    def depth(line):
        return len(line) - len(line.lstrip(" :+-*()0123456789"))

    # What stands between the scan and the join with the allowed documents.
    joined = next(k for k in range(scan, -1, -1) if "Join" in lines[k])
    assert f"[{CELL}#" in lines[joined]
    assert not any("Exchange" in line for line in lines[joined:scan] if depth(line) < depth(lines[scan]))
    assert "PushedFilters: [In(term" in lines[scan] or "EqualTo(term" in lines[scan]


def test_highlight_and_suggest(spark, index):
    q = queries(spark, "red fox", "quikc drog")
    hits = search.top_hits(search.match_normal(index, q))
    frags = highlights(index, hits, search.query_words(q)).orderBy("doc_id").collect()
    assert frags[0]["fragment"] == "the quick **red** **fox** jumps over the lazy dog"
    got = [(r["asked"], r["term"]) for r in suggestions(index, q).collect()]
    assert sorted(got) == [("drog", "dog"), ("quikc", "quick")]


def test_partition_count_does_not_matter(spark, index):
    q = queries(spark, "red fox", "the")
    results = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        results.append(sorted(map(tuple, search.top_hits(search.match_normal(index, q)).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert results[0] == results[1]


def test_patterns_without_a_letter(spark, index):
    """A pattern of symbols alone is a pattern, not an empty query."""
    q = queries(spark, "*", "***", "?og", "")
    answer = search.run(index, q, search.SearchRequest(mode="wildcard", fields=("text",), any_field=False))
    assert {r["query_id"]: r["total"] for r in answer.total.collect()} == {"0": 4, "1": 4, "2": 3, "3": 6}
    for mode in ("normal", "phrase", "fuzzy"):
        answer = search.run(index, queries(spark, "*", "", "dog"), search.SearchRequest(mode=mode, fields=("text",), any_field=False))
        assert {r["query_id"]: r["total"] for r in answer.total.collect()} == {"0": 6, "1": 6, "2": 3}


def test_pages_and_suggestions(spark, index):
    q = queries(spark, "fox", "quikc")
    pages = [search.run(index, q, search.SearchRequest(size=2, offset=n)).hits.collect() for n in (0, 2)]
    assert [(r["rank"], r["doc_id"]) for r in sorted(sum(pages, []), key=lambda r: r["rank"])] == [(1, 2), (2, 1), (3, 6)]
    offered = search.run(index, q, search.SearchRequest(suggest=True)).suggestions
    assert [(r["asked"], r["term"]) for r in offered.collect()] == [("quikc", "quick")]
    assert search.run(index, q, search.SearchRequest(mode="wildcard", suggest=True)).suggestions is None


def test_phrase_postings_stay_where_they_are_read(spark):
    """More documents hold the rarest word than are sent to all tasks: they meet the lists of
    words by cell, and no posting is exchanged by its document."""
    named = spark.range(4_000).select(F.sha2(F.col("id").cast("string"), 256).alias("doc_id"), F.when(
        F.col("id") % 2 == 0, "the red fox and the dog").otherwise("red the fox and dog the").alias("text"))
    built = SearchIndex.build(named, "doc_id", ("text",))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100k")
    try:
        found = search.match_phrase(built, queries(spark, "the red fox", "and the dog", "fox red"))
        plan = found._jdf.queryExecution().executedPlan().toString()
        counts = {r["query_id"]: r["count"] for r in found.groupBy("query_id").count().collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        built.close()
    assert counts == {"0": 2_000, "1": 2_000}
    assert not [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "doc_id" in line]
