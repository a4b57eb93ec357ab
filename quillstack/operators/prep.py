"""Filters, fills, numbering, joins, split and checks of a labelled corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstack.functions.skew import salted_join

RESULT_FIELDS = (
    "issue", "issue_area", "decision_direction", "us_cite_id", "maj_opinion_author",
    "argument_date", "decision_date", "n_min_votes", "n_maj_votes", "case_name",
)

# Stand-ins for missing metadata.
SENTINELS = {
    "issue": "-1", "issue_area": -1, "decision_direction": "None", "us_cite_id": "None",
    "maj_opinion_author": -1, "argument_date": "1900-01-01", "decision_date": "1900-01-01",
    "n_min_votes": -1, "n_maj_votes": -1, "case_name": "",
}

TEST_SHARE = 0.2
SPLIT_SEED = 42
BALANCE_RTOL, BALANCE_ATOL = 0.1, 0.25


def usable(docs: DataFrame, label: str = "issue_area", text: str = "text") -> DataFrame:
    """B1"""
    return docs.filter(F.col(label).isNotNull() & (F.col(text) != ""))


def drop_rare_labels(docs: DataFrame, label: str, key: str, min_docs: int = 2) -> DataFrame:
    """B2: documents whose label has at least ``min_docs`` documents."""
    frequent = docs.groupBy(label).agg(F.count("*").alias("n")).filter(F.col("n") >= min_docs)
    return salted_join(docs, frequent.select(label), [label], [key], "left_semi")


def fill_sentinels(docs: DataFrame, values: dict[str, object] | None = None) -> DataFrame:
    """Replace nulls, each value cast to the type of its column."""
    values = SENTINELS if values is None else values
    filled = {
        name: F.coalesce(F.col(name), F.lit(value).cast(docs.schema[name].dataType))
        for name, value in values.items()
        if name in docs.columns
    }
    return docs.withColumns(filled)


def result_fields(docs: DataFrame, fields: tuple[str, ...] = RESULT_FIELDS) -> DataFrame:
    """B4"""
    return docs.select(*fields)


def zero_padded(number: Column, width: int = 6) -> Column:
    """The number with leading zeros; a longer one is not cut."""
    digits = number.cast("string")
    return F.lpad(digits, F.greatest(F.lit(width), F.length(digits)), "0")


def dense_numbers(docs: DataFrame, key: str, out: str = "doc_num", ranges: int = 256) -> DataFrame:
    """Numbers 0, 1, 2, ... in key order, also as a name of six digits or more.

    The numeric key is cut into ranges of about equal size, rows are ranked
    inside a range only, and the sizes of the earlier ranges are added. Range
    bounds are approximate; the numbering is exact whatever they are.
    """
    share = [i / ranges for i in range(1, ranges)]
    bounds = docs.agg(F.percentile_approx(key, share, 10 * ranges)).first()[0] or []
    edges = F.array(*[F.lit(b) for b in sorted(set(bounds))]).cast("array<bigint>")
    cut = docs.withColumn("range", F.size(F.filter(edges, lambda e: e <= F.col(key))))
    sizes = cut.groupBy("range").agg(F.count("*").alias("n"))
    before = F.coalesce(
        F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    offsets = sizes.select("range", before.alias("before"))
    inside = F.row_number().over(Window.partitionBy("range").orderBy(key))
    number = (F.col("before") + inside - 1).cast("long")
    return (
        cut.join(offsets, "range")
        .withColumn(out, number)
        .withColumn("file_name", zero_padded(F.col(out)))
        .drop("range", "before")
    )


def with_metadata(docs: DataFrame, meta: DataFrame, key: str = "doc_id", how: str = "inner") -> DataFrame:
    """Pair texts and metadata by key."""
    return docs.join(meta, key, how)


def decode_label(
    rows: DataFrame, names: DataFrame, code: str, out: str, spread_by: str
) -> DataFrame:
    """Add the name of a code; ``names`` has columns (code, name)."""
    dim = names.select(F.col("code").alias(code), F.col("name").alias(out))
    return salted_join(rows, dim, [code], [spread_by], "left")


def _draw(key: str, seed: int) -> Column:
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f"-{seed}")))


def split_quotas(per_label: DataFrame, label: str, test_share: float = TEST_SHARE) -> DataFrame:
    """Test documents per label by largest remainder; ``per_label`` is (label, n).

    The windows run over one row per label.
    """
    everything = Window.partitionBy()
    total = F.sum("n").over(everything)
    n_test = F.ceil(total * F.lit(str(test_share)).cast("decimal(10,6)")).cast("long")
    shares = per_label.withColumn("n_test", n_test).withColumn("total", total)
    shares = shares.withColumn("base", F.expr("n * n_test div total"))
    shares = shares.withColumn("rest", F.expr("n * n_test % total"))
    open_places = F.col("n_test") - F.sum("base").over(everything)
    place = F.row_number().over(Window.orderBy(F.col("rest").desc(), label))
    quota = F.col("base") + (F.col("place") <= F.col("open")).cast("long")
    return (
        shares.withColumn("open", open_places)
        .withColumn("place", place)
        .select(label, quota.alias("quota"))
    )


def stratified_split(
    docs: DataFrame, label: str, key: str, test_share: float = TEST_SHARE, seed: int = SPLIT_SEED
) -> DataFrame:
    """(key, label, split) with the same label shares in train and test.

    Within a label the documents with the smallest seeded hashes form the test
    set. Ranking is done inside buckets of the leading hash digits, with the
    sizes of earlier buckets added, so a label with most of the corpus is
    ranked in thousands of independent pieces.
    """
    drawn = docs.select(key, label, _draw(key, seed).alias("draw")).withColumn(
        "bucket", F.substring("draw", 1, 3)
    )
    sizes = drawn.groupBy(label, "bucket").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy(label).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    quotas = split_quotas(sizes.groupBy(label).agg(F.sum("n").alias("n")), label, test_share)
    offsets = (
        sizes.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
        .join(quotas, label)
        .select(label, "bucket", "before", "quota")
    )
    inside = F.row_number().over(Window.partitionBy(label, "bucket").orderBy("draw", key))
    ranked = drawn.withColumn("inside", inside).join(offsets, [label, "bucket"])
    split = F.when(F.col("before") + F.col("inside") <= F.col("quota"), "test").otherwise("train")
    return ranked.select(key, label, split.alias("split"))


def split_balance(docs: DataFrame, label: str, name: str, split: str = "split") -> DataFrame:
    """Share of distinct names per label in all, train and test, in percent,
    and whether train and test agree with the whole within the tolerances."""
    # A name is made distinct once, with the sides it is on, and then counted for each.
    sides = [F.max(F.when(F.col(split) == side, F.col(name))).alias(f"in_{side}") for side in ("train", "test")]
    counts = docs.groupBy(label, name).agg(*sides).groupBy(label).agg(
        F.count(name).alias("n_all"), *(F.count(f"in_{side}").alias(f"n_{side}") for side in ("train", "test")))
    everything = Window.partitionBy()

    def percent(column: str) -> Column:
        return F.col(column) * 100.0 / F.sum(column).over(everything)

    shares = counts.select(
        label,
        percent("n_all").alias("all_pct"),
        percent("n_train").alias("train_pct"),
        percent("n_test").alias("test_pct"),
    )

    def close(column: str) -> Column:
        gap = F.abs(F.col("all_pct") - F.col(column))
        return gap <= BALANCE_ATOL + BALANCE_RTOL * F.abs(F.col(column))

    return shares.withColumn("balanced", close("train_pct") & close("test_pct"))


def missing_from_split(docs: DataFrame, assigned: DataFrame, key: str) -> DataFrame:
    """Documents that reached neither train nor test."""
    return docs.select(key).join(assigned.select(key), key, "left_anti")


def completeness(docs: DataFrame, assigned: DataFrame, key: str, split: str = "split") -> DataFrame:
    """Corpus, train and test counts, missing documents, and the verdict."""
    whole = docs.select(key, F.lit(True).alias("stored"))
    parts = assigned.select(key, F.col(split).alias("part"))
    counts = whole.join(parts, key, "full").agg(
        F.count("stored").alias("n_corpus"),
        F.count_if(F.col("part") == "train").alias("n_train"),
        F.count_if(F.col("part") == "test").alias("n_test"),
        F.count_if(F.col("part").isNull()).alias("n_missing"),
    )
    complete = (F.col("n_corpus") == F.col("n_train") + F.col("n_test")) & (F.col("n_missing") == 0)
    return counts.withColumn("complete", complete)


def document_metadata(docs: DataFrame, key: str, value: int, split: str, column: str = "split") -> DataFrame:
    """One document of one split; both conditions reach the scan."""
    return docs.filter((F.col(key) == value) & (F.col(column) == split))


def split_part(docs: DataFrame, split: str, columns: tuple[str, ...], column: str = "split") -> DataFrame:
    """Metadata or labels of one side of the split."""
    return docs.filter(F.col(column) == split).select(*columns)


def corpus_facts(docs: DataFrame, category: str, date: str) -> DataFrame:
    """The distinct categories and the full date range, in one pass."""
    return docs.agg(
        F.array_sort(F.collect_set(category)).alias("categories"),
        F.min(date).alias("first_date"),
        F.max(date).alias("last_date"),
    )


def sample_documents(docs: DataFrame, key: str, k: int, seed: int = SPLIT_SEED) -> DataFrame:
    """K documents by smallest seeded hash; repeatable."""
    return docs.orderBy(_draw(key, seed), key).limit(k)
