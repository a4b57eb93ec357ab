"""Tables that grow by segments, each made visible by one commit row."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, replace

from pyspark.sql import SparkSession

from quillstack.session import path_exists

_COMMITS = "segment string, number long, replaces array<string>, batch string, tombstones boolean"


@dataclass(frozen=True)
class Commits:
    """The commits of the tables in a folder, oldest first. What a segment holds is read
    once its commit is there, so an addition that fails before leaves nothing behind
    that is read. A commit names the segments it replaces, the batch it came from, and
    whether its segment has tombstones for earlier ones. There is one writer at a time."""

    spark: SparkSession
    path: str
    rows: tuple = ()

    @staticmethod
    def read(spark: SparkSession, folder: str) -> Commits:
        path = f"{folder}/commits"
        if not path_exists(spark, f"{path}/_SUCCESS"):
            return Commits(spark, path)
        return Commits(spark, path, tuple(spark.read.schema(_COMMITS).parquet(path).orderBy("number").collect()))

    @property
    def live(self) -> list[str]:
        """Segments that no later commit replaces."""
        gone = {s for c in self.rows for s in c["replaces"]}
        return [c["segment"] for c in self.rows if c["segment"] not in gone]

    @property
    def has_dead(self) -> bool:
        live = set(self.live)
        return any(c["tombstones"] for c in self.rows if c["segment"] in live)

    def has(self, batch: str | None) -> bool:
        return batch is not None and any(c["batch"] == batch for c in self.rows)

    def next(self) -> tuple[str, int]:
        """Name and number of a new segment."""
        return uuid.uuid4().hex, 1 + max((c["number"] for c in self.rows), default=0)

    def add(self, segment: str, number: int, replaces=(), batch: str | None = None, tombstones: bool = False) -> Commits:
        row = [(segment, number, list(replaces), batch, tombstones)]
        self.spark.createDataFrame(row, _COMMITS).coalesce(1).write.mode("append").parquet(self.path)
        rows = self.spark.read.schema(_COMMITS).parquet(self.path).orderBy("number").collect()
        return replace(self, rows=tuple(rows))
