"""The log of search texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LOG_SCHEMA = T.StructType(
    [
        T.StructField("search_time", T.TimestampType()),
        T.StructField("search_text", T.StringType()),
    ]
)


def append_searches(searches: DataFrame, path: str) -> None:
    searches.select("search_time", "search_text").write.mode("append").parquet(path)


def stream_searches(searches: DataFrame, path: str, checkpoint: str):
    """Append a stream of searches; every row reaches the log exactly once."""
    return (
        searches.select("search_time", "search_text")
        .writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_searches(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LOG_SCHEMA).parquet(path)


def search_texts(log: DataFrame) -> DataFrame:
    """All texts, oldest first."""
    return log.orderBy("search_time", "search_text").select(
        F.col("search_time"), F.col("search_text")
    )
