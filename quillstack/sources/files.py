"""Listing and versions of stored files, as operations on a table.

A version table holds ``key, version_id, last_modified, size, deleted, content``
and only ever grows; a deletion without a version appends a marker row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstack.functions.text import decode_utf8

VERSION_COLUMNS = ("key", "version_id", "last_modified", "size", "deleted", "content")


def owner_prefix(owner: str, prefix: str | None = None) -> str:
    """Closing the owner with a slash keeps ``bob`` from listing ``bobby``."""
    return f"{owner}/{prefix or ''}"


START = ""


def list_files(files: DataFrame, prefix: str) -> DataFrame:
    """A5: all files under a prefix in key order."""
    listed = files.filter(F.col("key").startswith(prefix))
    return listed.select("key", "last_modified", "size").orderBy("key")


def list_page(
    files: DataFrame, prefix: str, page_size: int, token: str | None = START
) -> tuple[DataFrame, str | None]:
    """A5: one page of ``list_files`` and the token of the next page, its last key.

    One row more than the page is read, so a page that is exactly full is known to be
    the last. The token is None after the last page, and None lists nothing."""
    spark = files.sparkSession
    columns = files.select("key", "last_modified", "size")
    if token is None:
        return spark.createDataFrame([], columns.schema), None
    following = columns.filter(F.col("key").startswith(prefix) & (F.col("key") > token))
    rows = following.orderBy("key").limit(page_size + 1).collect()
    page = spark.createDataFrame(rows[:page_size], columns.schema)
    return page, rows[page_size - 1]["key"] if len(rows) > page_size else None


def load_files(files: DataFrame, prefix: str) -> DataFrame:
    """Decoded content of every file under a prefix."""
    return files.filter(F.col("key").startswith(prefix)).select(
        "key", decode_utf8(F.col("content")).alias("text")
    )


def _age() -> Column:
    return F.struct("last_modified", "version_id")


def latest_versions(versions: DataFrame) -> DataFrame:
    """The newest row of every key, markers included.

    ``max_by`` aggregates on the map side first, so a key with very many
    versions never gathers in one task.
    """
    newest = versions.groupBy("key").agg(F.max_by(F.struct(*versions.columns), _age()).alias("v"))
    return newest.select("v.*")


def add_versions(versions: DataFrame, new: DataFrame) -> DataFrame:
    """Append uploaded files."""
    return versions.unionByName(new)


def list_versions(versions: DataFrame) -> DataFrame:
    """Every stored version with its ``is_latest`` flag, markers left out.

    The join key holds the version, which is unique, so hot keys stay spread.
    """
    newest = latest_versions(versions.select("key", "version_id", "last_modified")).select(
        "key", "version_id", F.lit(True).alias("newest")
    )
    flagged = versions.join(newest, ["key", "version_id"], "left")
    return flagged.filter(~F.col("deleted")).select(
        "key",
        "version_id",
        F.coalesce("newest", F.lit(False)).alias("is_latest"),
        "last_modified",
        "size",
    )


def read_files(versions: DataFrame, requests: DataFrame) -> DataFrame:
    """Answer ``(key, version_id or null)`` requests with content and a status."""
    live = versions.filter(~F.col("deleted"))
    named = (
        requests.filter(F.col("version_id").isNotNull())
        .join(live.select("key", "version_id", "content"), ["key", "version_id"], "left")
        .select("key", "version_id", "content")
    )
    newest = latest_versions(versions.select("key", "version_id", "last_modified", "deleted"))
    found = newest.filter(~F.col("deleted")).select("key", "version_id")
    unnamed = (
        requests.filter(F.col("version_id").isNull()).select("key").join(found, "key", "left")
        .join(live.select("key", "version_id", "content"), ["key", "version_id"], "left")
        .select("key", "version_id", "content")
    )
    status = F.when(F.col("content").isNull(), "missing").otherwise("ok")
    return named.unionByName(unnamed).select(
        "key", "version_id", status.alias("status"), decode_utf8(F.col("content")).alias("text")
    )


def delete_files(versions: DataFrame, requests: DataFrame, when: Column) -> DataFrame:
    """Requests with a version remove that row; requests without append a marker."""
    kept = versions.join(
        requests.filter(F.col("version_id").isNotNull()).select("key", "version_id"),
        ["key", "version_id"],
        "left_anti",
    ).select(*versions.columns)
    markers = requests.filter(F.col("version_id").isNull()).select(
        "key",
        F.concat(F.lit("deleted-"), F.md5(F.concat("key", when.cast("string")))).alias("version_id"),
        when.alias("last_modified"),
        F.lit(0).cast(versions.schema["size"].dataType).alias("size"),
        F.lit(True).alias("deleted"),
        F.lit(None).cast("binary").alias("content"),
    )
    return kept.unionByName(markers)
