"""Corpora of text files, delimited metadata and code dictionaries."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstack.functions.text import decode_utf8

METADATA_SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("case_name", T.StringType()),
        T.StructField("issue", T.StringType()),
        T.StructField("issue_area", T.IntegerType()),
        T.StructField("decision_direction", T.StringType()),
        T.StructField("us_cite_id", T.StringType()),
        T.StructField("maj_opinion_author", T.IntegerType()),
        T.StructField("argument_date", T.DateType()),
        T.StructField("decision_date", T.DateType()),
        T.StructField("n_min_votes", T.IntegerType()),
        T.StructField("n_maj_votes", T.IntegerType()),
    ]
)

# Written for nulls, so that empty strings stay apart from them. Fields that are
# missing altogether are read as null too.
NULL = r"\N"

CORPUS_SCHEMA = T.StructType(
    [
        METADATA_SCHEMA["doc_id"],
        METADATA_SCHEMA["case_name"],
        T.StructField("text", T.StringType()),
        *METADATA_SCHEMA.fields[2:],
        T.StructField("topics", T.ArrayType(T.StringType())),
        T.StructField("tags", T.ArrayType(T.StringType())),
        T.StructField("ners", T.ArrayType(T.StringType())),
        T.StructField("ext_summary", T.StringType()),
    ]
)


#: Files of one folder; a folder for each file would be listed and committed one by one.
FOLDER_FILES = 1_000


def write_text_files(docs: DataFrame, path: str) -> None:
    """A1: (name, text) as files ``<name>-<task>.txt`` below ``path``. Every text is ended by
    a line break, a null one is that alone; texts of one name in a task share a file. Each
    task writes its own files, and a task that is repeated writes the same ones again."""
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(path)
        task, n, name, out = TaskContext.get().partitionId(), 0, None, None
        for batch in batches:
            for own, text in zip(batch.column("name").to_pylist(), batch.column("text")):
                if out is None or own != name:
                    if out is not None:
                        out.close()
                    folder = f"{root}/{task:05d}-{n // FOLDER_FILES:05d}"
                    if n % FOLDER_FILES == 0:
                        store.create_dir(folder)
                    name, out, n = own, store.open_output_stream(f"{folder}/{own}-{task:05d}.txt", compression=None), n + 1
                if text.is_valid:
                    out.write(text.as_buffer())
                out.write(b"\n")
        if out is not None:
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    written = docs.select("name", "text").sortWithinPartitions("name").mapInArrow(write, "n long")
    written.agg(F.sum("n")).collect()


def read_text_files(
    spark: SparkSession, folder: str, number: str = r"([0-9]+)\.txt$", recursive: bool = False
) -> DataFrame:
    """A1: one document per ``.txt`` file, numbered by the digits in its path.

    Spark may leave out files of zero bytes; B1 drops empty texts in any case.
    """
    files = (
        spark.read.option("pathGlobFilter", "*.txt")
        .option("recursiveFileLookup", recursive)
        .text(folder, wholetext=True)
    )
    found = F.regexp_extract(F.col("_metadata.file_path"), number, 1)
    return files.select(found.cast("long").alias("doc_id"), F.col("value").alias("text"))


def read_metadata(
    spark: SparkSession, path: str, schema: T.StructType = METADATA_SCHEMA, sep: str = "|"
) -> DataFrame:
    """A2: delimited metadata with a header and a declared schema."""
    return (
        spark.read.schema(schema).option("sep", sep).option("header", True)
        .option("multiLine", True).option("escape", '"').option("nullValue", NULL).csv(path)
    )


def write_metadata(meta: DataFrame, path: str, sep: str = "|") -> None:
    """A4: the metadata side of a snapshot. Empty strings and nulls stay apart."""
    (
        meta.write.option("sep", sep).option("header", True).option("escape", '"')
        .option("nullValue", NULL).option("emptyValue", '""').option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False).csv(path)
    )


def read_code_names(spark: SparkSession, path: str, entry: str) -> DataFrame:
    """A3: one code-to-name map of a JSON info file as (code, name) rows."""
    schema = T.StructType([T.StructField(entry, T.MapType(T.StringType(), T.StringType()))])
    info = spark.read.schema(schema).option("multiLine", True).json(path)
    return info.select(F.explode(entry)).select(
        F.col("key").cast("int").alias("code"), F.col("value").alias("name")
    )


def read_stored_files(spark: SparkSession, folder: str, prefix: str = "") -> DataFrame:
    """A6 from a directory: content of every file under a prefix, decoded."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    return files.load(f"{folder}/{prefix}".rstrip("/")).select(
        F.col("path").alias("key"),
        F.col("modificationTime").alias("last_modified"),
        F.col("length").alias("size"),
        decode_utf8(F.col("content")).alias("text"),
    )


def list_stored_files(spark: SparkSession, folder: str) -> DataFrame:
    """A5 from a directory: key, time and size, without reading the content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.select(
        F.col("path").alias("key"),
        F.col("modificationTime").alias("last_modified"),
        F.col("length").alias("size"),
    )
