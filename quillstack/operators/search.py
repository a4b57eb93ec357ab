"""Matching, filtering, ranking and counting.

Queries are a DataFrame ``(query_id, query_text)``; one job answers all of them.
Every matcher returns ``(query_id, doc_id, score)``, one row per match.

* normal, fuzzy: all words of the query must occur in a field. ``any_field``
  takes the best field, otherwise every listed field must match and scores add.
* phrase, wildcard: ``any_field`` always looks at every field of the index and
  adds their scores; otherwise every listed field must match.

The words of the queries are stored before they meet the index: Spark then knows their
size and sends them to the postings, not the postings to them, and a short list of words
is given to the scan. ``docs`` restricts a search to some documents where the postings
are read; scores do not change. Postings and matches of a document stay in the bucket
of its cell until the best are chosen.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstack.functions.distance import allowed_edits, edit_distance, with_deletion_keys
from quillstack.functions.tokens import search_tokens
from quillstack.operators.search_index import CELL, GRAM, SearchIndex
from quillstack.session import materialise

K1, B = 1.2, 0.75
TOP_HITS = 10
TOP_VALUES = 10
MODES = ("normal", "phrase", "wildcard", "fuzzy")


def _for_fields(rows: DataFrame, fields: Sequence[str]) -> DataFrame:
    return rows.withColumn("field", F.explode(F.array(*[F.lit(f) for f in fields])))


def query_words(queries: DataFrame) -> DataFrame:
    """(query_id, term, copies, n_terms): distinct words of each query."""
    tokens = queries.select("query_id", search_tokens(F.col("query_text")).alias("words"))
    return tokens.select(
        "query_id",
        F.size(F.array_distinct("words")).alias("n_terms"),
        F.explode("words").alias("term"),
    ).groupBy("query_id", "n_terms", "term").agg(F.count("*").alias("copies"))


def bm25(idf: Column, tf: Column, length: Column, avg_len: Column) -> Column:
    """Contribution of one term."""
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / avg_len))


def _combine(per_field: DataFrame, n_fields: int, any_field: bool, best: bool) -> DataFrame:
    """Fields to one score: best or sum for any field, sum over all fields otherwise."""
    total = F.max("score") if any_field and best else F.sum("score")
    grouped = per_field.groupBy("query_id", CELL, "doc_id").agg(
        total.alias("score"), F.count("*").alias("n_fields")
    )
    if not any_field:
        grouped = grouped.filter(F.col("n_fields") == n_fields)
    return grouped.select("query_id", "doc_id", "score")


def match_normal(
    index: SearchIndex, queries: DataFrame, fields: Sequence[str] = ("text",), any_field: bool = True,
    docs: DataFrame | None = None,
) -> DataFrame:
    """G2, G3"""
    words = _for_fields(query_words(queries), fields)
    known = index.word_stats(words.select("field", "term").distinct())
    wanted = materialise(words.join(known, ["field", "term"]), "query-words")
    return _score_normal(index.postings(wanted, docs), wanted, len(fields), any_field)


def _score_normal(postings: DataFrame, wanted: DataFrame, n_fields: int, any_field: bool) -> DataFrame:
    keys = [c for c in wanted.columns if c in postings.columns]
    part = F.col("copies") * bm25(F.col("idf"), F.col("tf"), F.col("len"), F.col("avg_len"))
    per_field = (
        postings.join(wanted, keys)
        .groupBy("query_id", CELL, "doc_id", "field", "n_terms")
        .agg(F.count("*").alias("matched"), F.sum(part).alias("score"))
        .filter(F.col("matched") == F.col("n_terms"))
    )
    return _combine(per_field, n_fields, any_field, best=True)


#: Cells that are scored first, for each query and each hit asked for.
FIRST_CELLS = 2


@dataclass(frozen=True)
class BestHits:
    """``hits`` as by ``top_hits``; ``read`` and ``asked``: how many postings of the asked
    words were scored, and how many there are."""

    hits: DataFrame
    read: int
    asked: int


def best_normal(
    index: SearchIndex, queries: DataFrame, fields: Sequence[str] = ("text",), any_field: bool = True,
    docs: DataFrame | None = None, k: int = TOP_HITS,
) -> BestHits:
    """The ``k`` best hits of a normal search without scoring all matches.

    Every block knows its largest term frequency and its least length, which bound the
    contribution of its word. A cell can be left out if it lacks a word of the query or
    if its bounds add up to less than the k-th best score of the cells that look best;
    of the others only the blocks of asked words are opened. Documents of a cell are of
    similar length, so the bounds are close."""
    words = _for_fields(query_words(queries), fields)
    known = index.word_stats(words.select("field", "term").distinct())
    wanted = materialise(words.join(known, ["field", "term"]), "query-words")
    blocks = index.asked_blocks(wanted)
    c = F.col
    most = c("copies") * bm25(c("idf"), c("max_tf"), c("min_len"), c("avg_len"))
    bounds = (
        blocks.select(CELL, "field", "term", "n", "max_tf", "min_len").join(wanted, ["field", "term"])
        .groupBy("query_id", CELL, "field", "term", "n_terms").agg(F.max(most).alias("most"), F.sum("n").alias("n"))
        .groupBy("query_id", CELL, "field", "n_terms")
        .agg(F.count("*").alias("matched"), F.sum("most").alias("most"), F.sum("n").alias("n"))
    )
    full = c("matched") == c("n_terms")
    total = F.max(F.when(full, c("most"))) if any_field else F.sum(F.when(full, c("most")))
    enough = F.count_if(full) >= (1 if any_field else len(fields))
    cells = materialise(bounds.groupBy("query_id", CELL).agg(
        total.alias("most"), enough.alias("possible"), F.sum("n").alias("n")), "query-cells")
    order = Window.partitionBy("query_id").orderBy(c("most").desc(), CELL)
    possible = cells.filter("possible").withColumn("place", F.row_number().over(order))
    first = materialise(possible.filter(c("place") <= FIRST_CELLS * k).select("query_id", CELL, "n"), "first-cells")

    def score(chosen: DataFrame) -> DataFrame:
        opened = blocks.join(chosen.select(CELL).distinct(), CELL, "left_semi")
        asked = wanted.join(chosen.select("query_id", CELL), "query_id")
        return _score_normal(index.postings(wanted, docs, blocks=opened), asked, len(fields), any_field)

    found = materialise(top_hits(score(first), k), "first-hits")
    kth = found.filter(c("rank") == k).select("query_id", c("score").alias("kth"))
    rest = (
        cells.filter("possible").join(first, ["query_id", CELL], "left_anti").join(kth, "query_id", "left")
        .filter(c("kth").isNull() | (c("most") >= c("kth") - 1e-6)).select("query_id", CELL, "n")
    )
    rest = materialise(rest, "further-cells")
    counted = [t.agg(F.sum("n")).first()[0] or 0 for t in (first, rest, cells)]
    matches = found.select("query_id", "doc_id", "score").unionByName(score(rest))
    return BestHits(top_hits(matches, k), counted[0] + counted[1], counted[2])


def match_phrase(
    index: SearchIndex, queries: DataFrame, fields: Sequence[str] = ("text",), any_field: bool = True,
    docs: DataFrame | None = None,
) -> DataFrame:
    """G4, G5, from positions alone. Only documents that hold the rarest word of a
    phrase have the positions of its other words spread, so frequent words make few rows."""
    fields = tuple(index.fields if any_field else fields)
    phrases = queries.select("query_id", search_tokens(F.col("query_text")).alias("phrase")).filter(
        F.size("phrase") > 0
    )
    placed = _for_fields(
        phrases.select("query_id", F.size("phrase").alias("n"), F.posexplode("phrase").alias("offset", "term")), fields
    )
    weighed = placed.join(index.word_stats(placed.select("field", "term").distinct()), ["field", "term"])
    whole = Window.partitionBy("query_id", "field")
    rarest = F.row_number().over(whole.orderBy("df", "offset")) == 1
    weighed = materialise(
        weighed.withColumn("lead", rarest)
        .withColumn("n_known", F.count("*").over(whole))
        .withColumn("idf", F.sum("idf").over(whole))
        .filter(F.col("n_known") == F.col("n")),
        "query-phrases",
    )
    leads = weighed.filter("lead").select("query_id", "field", "term")
    held = index.postings(weighed.filter("lead"), docs).join(leads, ["field", "term"]).select("query_id", "field", "doc_id", CELL)
    held = materialise(held, "query-leads")
    # The documents of a cell go to its blocks by the bucket they are in, few as they are, and
    # sort out the lists of words where these are read; only what is left meets the queries.
    found = held.groupBy(CELL, "query_id", "field").agg(F.collect_set("doc_id").alias("ids"))
    found = found.groupBy(CELL).agg(F.collect_list(F.struct("query_id", "field", "ids")).alias("found"))
    found = found.withColumn("ids", F.array_distinct(F.flatten("found.ids")))
    own = F.filter("found", lambda f: (f["query_id"] == F.col("query_id")) & (f["field"] == F.col("field")))
    begin = F.col("at") - F.col("offset")

    def only(ids: Column) -> Column:
        return F.filter("e", lambda e: F.array_contains(ids, e["entries"]["doc_id"]))

    lists = index.lists(weighed, docs, positions=True).join(found.hint("shuffle_hash"), CELL)
    lists = lists.withColumn("e", only(F.col("ids"))).filter(F.size("e") > 0).join(weighed, ["field", "term"])
    starts = (
        lists.withColumn("ids", F.flatten(F.transform(own, lambda f: f["ids"])))
        .withColumn("e", F.explode_outer(only(F.col("ids")))).filter(F.col("e").isNotNull())
        .select("*", "e.entries.doc_id", "e.entries.len", "e.positions")
        .select("query_id", CELL, "doc_id", "field", "n", "idf", "avg_len", "len", "offset", F.explode("positions").alias("at"))
        .groupBy("query_id", CELL, "doc_id", "field", "n", "idf", "avg_len", "len", begin.alias("begin"))
        .agg(F.count("*").alias("met"))
        .filter((F.col("begin") >= 0) & (F.col("met") == F.col("n")))
    )
    per_field = (
        starts.groupBy("query_id", CELL, "doc_id", "field", "idf", "avg_len", "len")
        .agg(F.count("*").alias("tf"))
        .select(
            "query_id", CELL, "doc_id", "field",
            bm25(F.col("idf"), F.col("tf"), F.col("len"), F.col("avg_len")).alias("score"),
        )
    )
    return _combine(per_field, len(fields), any_field, best=False)


def _pattern_regex(pattern: Column) -> Column:
    """``*`` and ``?`` to an anchored regular expression, everything else literal."""
    quoted = F.regexp_replace(pattern, r"([\\.\[\]{}()+^$|\-&#~])", r"\\$1")
    return F.concat(
        F.lit("^"), F.replace(F.replace(quoted, F.lit("*"), F.lit(".*")), F.lit("?"), F.lit(".")), F.lit("$")
    )


def expand_wildcards(index: SearchIndex, patterns: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(query_id, field, term): index terms matching each pattern.

    Patterns meet terms by an equi-join on an anchor, up to three characters of
    the longest literal stretch of the pattern; matches are verified after it.
    """
    stretches = F.split("query_text", r"[*?]+")
    by_size = F.transform(stretches, lambda s: F.struct((-F.length(s)).alias("size"), s.alias("part")))
    longest = F.element_at(F.array_sort(by_size), 1).getField("part")
    anchored = patterns.select(
        "query_id",
        F.substring(longest, 1, GRAM).alias("anchor"),
        _pattern_regex(F.col("query_text")).alias("regex"),
    )
    anchored = materialise(anchored, "query-patterns")
    near = index.grams.join(anchored, "anchor")
    # A pattern without a literal character can match any word.
    open_ones = anchored.filter(F.col("anchor") == "")
    every = index.words.select("field", "term", F.lit("").alias("anchor")).join(open_ones, "anchor")
    return (
        near.select("query_id", "field", "term", "regex").unionByName(every.select("query_id", "field", "term", "regex"))
        .filter(F.col("field").isin(list(fields)) & F.rlike("term", "regex"))
        .select("query_id", "field", "term")
        .distinct()
    )


def match_wildcard(
    index: SearchIndex, queries: DataFrame, fields: Sequence[str] = ("text",), any_field: bool = True,
    docs: DataFrame | None = None,
) -> DataFrame:
    """G6, G7. The whole query is one pattern over single analysed terms, upper
    case kept as written; every matching field scores one."""
    fields = tuple(index.fields if any_field else fields)
    expanded = expand_wildcards(index, queries.filter(F.col("query_text") != ""), fields)
    expanded = materialise(expanded, "query-expansions")
    per_field = (
        index.postings(expanded, docs).select(CELL, "field", "term", "doc_id").join(expanded, ["field", "term"])
        .select("query_id", CELL, "doc_id", "field")
        .distinct()
        .withColumn("score", F.lit(1.0))
    )
    return _combine(per_field, len(fields), any_field, best=False)


def near_terms(index: SearchIndex, terms: DataFrame, fields: Sequence[str], max_edits: Column) -> DataFrame:
    """(field, asked, term, df, edits): index terms within ``max_edits`` of the
    asked terms. Pairs come from shared deletion keys and are then measured; one swap
    is at most two plain edits, so the built-in distance sorts out most of them."""
    asked = terms.select(F.col("term").alias("asked")).distinct()
    asked_keys = (
        with_deletion_keys(asked.select("asked", max_edits.alias("k")), "asked")
        .filter(F.col("deleted") <= F.col("k"))
        .select("asked", "k", "key")
        .distinct()
    )
    pairs = (
        index.deletion_keys.filter(F.col("field").isin(list(fields)))
        .join(materialise(asked_keys, "query-keys"), "key")
        .filter((F.col("deleted") <= F.col("k")) & (F.levenshtein("asked", "term") <= 2 * F.col("k")))
        .groupBy("field", "asked", "term")
        .agg(F.first("df").alias("df"), F.first("k").alias("k"))
    )
    measured = materialise(pairs.withColumn("edits", edit_distance(F.col("asked"), F.col("term"))), "query-near")
    return measured.filter(F.col("edits") <= F.col("k"))


def similarity(edits: Column, left: Column, right: Column) -> Column:
    return 1 - edits / F.least(F.length(left), F.length(right))


def match_fuzzy(
    index: SearchIndex,
    queries: DataFrame,
    fields: Sequence[str] = ("text",),
    any_field: bool = True,
    docs: DataFrame | None = None,
    max_expansions: int | None = None,
) -> DataFrame:
    """G8, G9. Every query word may be replaced by index terms within its allowed
    edits, weighted by similarity; a document scores the best one per word.
    ``max_expansions`` keeps only the nearest terms of each word; by default all
    terms within the bound take part."""
    words = query_words(queries)
    near = near_terms(index, words, fields, allowed_edits(F.col("asked")))
    near = near.withColumn("weight", similarity(F.col("edits"), F.col("asked"), F.col("term")))
    if max_expansions is not None:
        nearest = Window.partitionBy("field", "asked").orderBy(F.col("weight").desc(), "term")
        near = near.withColumn("place", F.row_number().over(nearest)).filter(
            F.col("place") <= max_expansions
        )
    asked = words.select("query_id", "n_terms", "copies", F.col("term").alias("asked"))
    expanded = near.select("field", "asked", "term", "weight").join(asked, "asked")
    known = index.word_stats(near.select("field", "term").distinct())
    wanted = materialise(expanded.join(known, ["field", "term"]), "query-words")
    part = (
        F.col("copies")
        * F.col("weight")
        * bm25(F.col("idf"), F.col("tf"), F.col("len"), F.col("avg_len"))
    )
    per_field = (
        index.postings(wanted, docs).join(wanted, ["field", "term"])
        .groupBy("query_id", CELL, "doc_id", "field", "n_terms", "asked")
        .agg(F.max(part).alias("part"))
        .groupBy("query_id", CELL, "doc_id", "field", "n_terms")
        .agg(F.count("*").alias("matched"), F.sum("part").alias("score"))
        .filter(F.col("matched") == F.col("n_terms"))
    )
    return _combine(per_field, len(fields), any_field, best=True)


def match_all(index: SearchIndex, query_id: str, docs: DataFrame | None = None) -> DataFrame:
    """An empty query matches every document with the same score."""
    found = index.docs if docs is None else docs
    return found.select(F.lit(query_id).alias("query_id"), "doc_id", F.lit(1.0).alias("score"))


def match(
    index: SearchIndex,
    queries: DataFrame,
    mode: str = "normal",
    fields: Sequence[str] = ("text",),
    any_field: bool = True,
    docs: DataFrame | None = None,
) -> DataFrame:
    matchers = {
        "normal": match_normal, "phrase": match_phrase,
        "wildcard": match_wildcard, "fuzzy": match_fuzzy,
    }
    if mode not in matchers:
        raise ValueError(f"unknown search mode: {mode}")
    return matchers[mode](index, queries, fields, any_field, docs)


def terms_filter(column: str, values: Sequence) -> Column:
    """G10"""
    return F.col(column).isin(list(values))


def range_filter(column: str, **bounds) -> Column:
    """Any of ``gte``, ``gt``, ``lte``, ``lt``. A bare year given for a date
    means its first day for ``gte`` and ``lt``, its last day for ``lte`` and ``gt``."""
    known = {"gte": ">=", "gt": ">", "lte": "<=", "lt": "<"}
    condition = F.lit(True)
    for name, value in bounds.items():
        if name not in known:
            raise ValueError(f"unknown range bound: {name}")
        tested = F.col(column)
        if isinstance(value, str) and len(value) == 4 and value.isdigit():
            value = f"{value}-01-01" if name in ("gte", "lt") else f"{value}-12-31"
            tested, value = tested.cast("date"), F.lit(value).cast("date")
        compare = {
            "gte": tested >= value, "gt": tested > value,
            "lte": tested <= value, "lt": tested < value,
        }
        condition = condition & compare[name]
    return condition


def allowed(index: SearchIndex, *conditions: Column) -> DataFrame:
    """The documents that meet every condition; give them to a matcher as ``docs``."""
    docs = index.docs
    for condition in conditions:
        docs = docs.filter(condition)
    return docs


def apply_filters(index: SearchIndex, matches: DataFrame, *conditions: Column) -> DataFrame:
    """Keep matches whose document meets every condition; scores stay as they are."""
    docs = allowed(index, *conditions)
    return matches.join(docs.select("doc_id"), "doc_id", "left_semi").select(*matches.columns)


def top_hits(matches: DataFrame, k: int = TOP_HITS) -> DataFrame:
    """The k best per query; equal rounded scores in document order."""
    scored = matches.withColumn("score", F.round("score", 6))
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "doc_id")
    return scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def sorted_hits(
    index: SearchIndex, matches: DataFrame, sort_by: Sequence[str], k: int = TOP_HITS
) -> DataFrame:
    """The first k per query by document columns; ``-name`` sorts descending."""
    names = [s.lstrip("-") for s in sort_by]
    keys = [
        F.col(n).desc_nulls_last() if s.startswith("-") else F.col(n).asc_nulls_last()
        for s, n in zip(sort_by, names)
    ]
    placed = matches.join(index.docs.select("doc_id", *names), "doc_id")
    order = Window.partitionBy("query_id").orderBy(*keys, "doc_id")
    return placed.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def value_counts(index: SearchIndex, matches: DataFrame, by: str, k: int = TOP_VALUES) -> DataFrame:
    """The most frequent values of a column among all matches."""
    values = matches.join(index.docs.select("doc_id", F.col(by).alias("value")), "doc_id")
    counts = (
        values.filter(F.col("value").isNotNull())
        .groupBy("query_id", "value")
        .agg(F.count("*").alias("n"))
    )
    order = Window.partitionBy("query_id").orderBy(F.col("n").desc(), "value")
    return counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def total_hits(queries: DataFrame, matches: DataFrame) -> DataFrame:
    """Matches per query, zero included."""
    counts = matches.groupBy("query_id").agg(F.count("*").alias("n"))
    return queries.select("query_id").join(counts, "query_id", "left").select(
        "query_id", F.coalesce("n", F.lit(0)).alias("total")
    )


def project_hits(index: SearchIndex, hits: DataFrame, columns: Sequence[str]) -> DataFrame:
    """B4 on an answer: the result fields of each hit. The hits are stored first: they
    are few, and go to the documents."""
    hits = materialise(hits, "hits")
    return index.docs.select("doc_id", *columns).join(hits, "doc_id").select(*hits.columns, *columns)


@dataclass(frozen=True)
class SearchRequest:
    """One search: type, fields, filters (conditions on document columns), order, value
    counts and highlighting. Without ``sort_by`` the best scores come first. The hits are
    those of rank ``offset`` + 1 to ``offset`` + ``size``; ``suggest`` adds spelling
    suggestions, but for wildcards."""

    mode: str = "normal"
    fields: tuple[str, ...] = ("text",)
    any_field: bool = True
    filters: tuple[Column, ...] = ()
    sort_by: tuple[str, ...] = ()
    count_by: str | None = None
    columns: tuple[str, ...] = ()
    highlight: str | None = None
    size: int = TOP_HITS
    offset: int = 0
    suggest: bool = False


@dataclass(frozen=True)
class SearchAnswer:
    """``hits`` (query_id, doc_id, score, rank and the asked columns), ``total`` per
    query, and ``counts``, ``fragments`` and ``suggestions`` where they were asked for."""

    hits: DataFrame
    total: DataFrame
    counts: DataFrame | None = None
    fragments: DataFrame | None = None
    suggestions: DataFrame | None = None
    matches: DataFrame | None = field(default=None, repr=False)


def run(index: SearchIndex, queries: DataFrame, request: SearchRequest) -> SearchAnswer:
    """G2-G19 in one call: filter, match, score, then order, count and highlight.

    Queries without a word match every document that passes the filters."""
    from quillstack.operators.highlight import highlights
    from quillstack.operators.suggest import suggestions

    docs = allowed(index, *request.filters) if request.filters else None
    # A pattern of symbols alone has no word but is not empty.
    wordless = F.lit(False) if request.mode == "wildcard" else F.size(search_tokens(F.col("query_text"))) == 0
    nothing = wordless | F.col("query_text").isNull() | (F.col("query_text") == "")
    empty = materialise(queries.filter(nothing).select("query_id"), "empty-queries")
    matches = match(index, queries, request.mode, request.fields, request.any_field, docs)
    if empty.limit(1).count():  # stored queries, and every document is a match of each
        everything = index.docs if docs is None else docs
        matches = matches.unionByName(everything.select("doc_id", F.lit(1.0).alias("score")).crossJoin(empty))
    matches = materialise(matches, "matches")
    until = request.offset + request.size
    if request.sort_by:
        names = [s.lstrip("-") for s in request.sort_by]
        hits = sorted_hits(index, matches, request.sort_by, until).drop(*names)
    else:
        hits = top_hits(matches, until)
    hits = materialise(hits.filter(F.col("rank") > request.offset), "hits")
    fragments = None
    if request.highlight:
        fragments = highlights(index, hits, query_words(queries), request.highlight)
    counts = value_counts(index, matches, request.count_by) if request.count_by else None
    shown = project_hits(index, hits, request.columns) if request.columns else hits
    offered = suggestions(index, queries) if request.suggest and request.mode != "wildcard" else None
    return SearchAnswer(shown, total_hits(queries, matches), counts, fragments, offered, matches)
