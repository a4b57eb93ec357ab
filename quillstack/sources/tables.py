"""Snapshots and the searchable corpus table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstack.sources.corpus import CORPUS_SCHEMA


def write_snapshot(docs: DataFrame, path: str, split: str = "split") -> None:
    """A4: corpus, metadata and cleaned copy in one table, one folder per split."""
    docs.write.mode("overwrite").partitionBy(split).parquet(path)


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def set_up_table(docs: DataFrame, path: str, if_exists: str = "ignore") -> DataFrame:
    """Create the corpus table; keep, replace or refuse an existing one.

    ``if_exists`` is ``ignore``, ``overwrite`` or ``errorifexists``. Columns of
    the corpus schema that ``docs`` lacks are stored as nulls.
    """
    if if_exists not in ("ignore", "overwrite", "errorifexists"):
        raise ValueError(f"if_exists: {if_exists}")
    have = set(docs.columns)
    columns = [
        (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in CORPUS_SCHEMA.fields
    ]
    extra = [F.col(c) for c in docs.columns if c not in CORPUS_SCHEMA.fieldNames()]
    docs.select(*columns, *extra).write.mode(if_exists).parquet(path)
    return docs.sparkSession.read.parquet(path)


def upsert(table: DataFrame, updates: DataFrame, key: str, order: str) -> DataFrame:
    """Rows of ``updates`` replace or extend ``table``; of several for one
    key the one with the largest ``order`` wins. ``order`` is not stored."""
    columns = table.columns
    latest = (
        updates.groupBy(key)
        .agg(F.max_by(F.struct(*columns), F.col(order)).alias("row"))
        .select("row.*")
    )
    kept = table.join(latest.select(key), key, "left_anti").select(*columns)
    return kept.unionByName(latest)


def insert_only(table: DataFrame, new: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """A10: ``(table with the new rows, rejected rows)``; a key that is already
    stored, or occurs more than once in ``new``, is rejected."""
    counts = new.groupBy(key).agg(F.count("*").alias("copies"))
    stored = table.select(key).withColumn("stored", F.lit(True))
    checked = new.join(counts, key).join(stored, key, "left")
    bad = F.col("stored").isNotNull() | (F.col("copies") > 1)
    accepted = checked.filter(~bad).select(*table.columns)
    return table.unionByName(accepted), checked.filter(bad).select(*new.columns)
