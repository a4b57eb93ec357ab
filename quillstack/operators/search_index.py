"""The stored index for search: documents and blocks of postings, in segments.

Documents are dealt into cells of about CELL_DOCS documents of similar length, and the
postings of a word in a cell are one row, a block. Documents, blocks and tombstones are
external tables, bucketed by cell: a filter on documents, the deletion of documents and
the gathering of the words of a query meet without moving postings. Within a file blocks
are sorted by field and word, so a condition on words skips most of it.

Each addition is a segment of its own; one that is repeated under its batch name changes
nothing. Documents that an addition replaces or removes get tombstones, and the
statistics of words are sums over segments, with what the dead documents had counted
taken off; they are those of an index built whole.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstack.functions.distance import with_deletion_keys
from quillstack.functions.tokens import search_tokens
from quillstack.session import materialise, new_path, path_exists
from quillstack.sources.segments import Commits

GRAM = 3
CELL_DOCS = 64
#: Documents in one bucket, about, and words that are given to the scan as a list.
BUCKET_DOCS = 250_000
LISTED_WORDS = 1_000
WORDS_AT_ONCE = 500_000
#: Bytes of a row group: small, since sorted words are skipped by row group and page.
GROUP_BYTES = 8 << 20
CELL, SEGMENT = "_cell", "_segment"


def _block_rows(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    """Block rows of whole cells: the words of all their documents are sorted at once by
    cell, field and word, where a stable sort keeps the order of documents and places."""
    table = pa.Table.from_batches(held).combine_chunks()
    cells, ids, fields, terms = (table.column(c).combine_chunks() for c in (CELL, "doc_id", "field", "terms"))
    sizes = pc.list_value_length(terms).to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    known_cells, cell = np.unique(cells.to_numpy(), return_inverse=True)
    fields, words = fields.dictionary_encode(), terms.flatten().dictionary_encode()
    place = cell * len(fields.dictionary) + fields.indices.to_numpy()
    key = place[row] * len(words.dictionary) + words.indices.to_numpy()
    order = np.argsort(key, kind="stable")
    key, row, at = key[order], row[order], at[order]
    entry = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (row[1:] != row[:-1])])
    tf = np.diff(np.r_[entry, len(key)])
    entry_row, entry_key, first = row[entry], key[entry], at[entry] == 0
    block = np.flatnonzero(np.r_[True, entry_key[1:] != entry_key[:-1]])
    lengths = sizes[entry_row].astype(np.int32)
    places, word = np.divmod(entry_key[block], len(words.dictionary))
    cell, name = np.divmod(places, len(fields.dictionary))
    offsets = pa.array(np.r_[block, len(entry)].astype(np.int32))
    entries = pa.StructArray.from_arrays(
        [ids.take(pa.array(entry_row)), pa.array(tf, pa.int64()), pa.array(lengths)], ["doc_id", "tf", "len"])
    positions = pa.ListArray.from_arrays(pa.array(np.r_[entry, len(key)].astype(np.int32)), pa.array(at.astype(np.int32)))
    return pa.RecordBatch.from_arrays(
        [pa.array(known_cells[cell], pa.int64()), fields.dictionary.take(pa.array(name)), words.dictionary.take(pa.array(word)),
         pa.array(np.diff(np.r_[block, len(entry)]), pa.int64()), pa.array(np.add.reduceat(tf, block), pa.int64()),
         pa.array(np.add.reduceat(first.astype(np.int64), block), pa.int64()),
         pa.array(np.maximum.reduceat(tf, block), pa.int64()), pa.array(np.minimum.reduceat(lengths, block), pa.int32()),
         pa.ListArray.from_arrays(offsets, entries), pa.ListArray.from_arrays(offsets, positions)],
        [CELL, "field", "term", "n", "n_tokens", "n_first", "max_tf", "min_len", "entries", "positions"])


def _gather(batches):
    """Blocks of documents that come in the order of their cells. The positions of a word
    are gathered here, so that no token is shuffled; cells of WORDS_AT_ONCE words are held
    at a time, a single larger cell whole."""
    held: list[pa.RecordBatch] = []
    size, now = 0, None
    for batch in batches:
        cells = batch.column(CELL).to_numpy()
        cuts = [0, *(np.flatnonzero(cells[1:] != cells[:-1]) + 1).tolist(), len(cells)]
        for start, end in zip(cuts, cuts[1:]):
            if start == end:
                continue
            if size >= WORDS_AT_ONCE and cells[start] != now:
                yield _block_rows(held)
                held, size = [], 0
            now = cells[start]
            held.append(batch.slice(start, end - start))
            size += pc.sum(pc.list_value_length(held[-1].column("terms"))).as_py()
    if held:
        yield _block_rows(held)


@dataclass(frozen=True)
class SearchIndex:
    """Tables below one folder.

    ``docs``    the live documents, with ``doc_id`` and the text and metadata columns
    ``blocks``  (_cell, field, term, n, n_tokens, n_first, max_tf, min_len, entries,
                positions) of the live segments; ``entries`` holds (doc_id, tf, len)
    ``words``   (field, term, df), ``stats`` (field, n_docs, avg_len)

    The keys for misspelt words and for wildcards are derived from ``words`` and stored
    when they are first asked for. ``spark.catalog`` knows the tables under ``name``
    until ``close``; the files stay.
    """

    spark: SparkSession
    path: str
    name: str
    fields: tuple[str, ...]
    buckets: int
    schema: T.StructType
    commits: Commits

    # -- life cycle ------------------------------------------------------------------

    @staticmethod
    def build(docs: DataFrame, key: str, fields: tuple[str, ...], path: str | None = None,
              buckets: int | None = None) -> SearchIndex:
        """A new index of ``docs``, whose key becomes ``doc_id`` and is distinct."""
        docs = docs.withColumnRenamed(key, "doc_id") if key != "doc_id" else docs
        spark = docs.sparkSession
        path = path or new_path(spark, "search-index")
        if buckets is None:
            buckets = max(spark.sparkContext.defaultParallelism, -(-docs.count() // BUCKET_DOCS))
        schema = T.StructType([T.StructField(f.name, f.dataType) for f in docs.schema])
        about = [(list(fields), buckets, schema.json())]
        spark.createDataFrame(about, "fields array<string>, buckets int, schema string").coalesce(1).write.parquet(f"{path}/about")
        return SearchIndex.open(spark, path).add(docs, batch="build")

    @staticmethod
    def open(spark: SparkSession, path: str) -> SearchIndex:
        """The index in a folder as of its last commit."""
        about = spark.read.parquet(f"{path}/about").first()
        commits = Commits.read(spark, path)
        name = "search_" + hashlib.md5(path.encode()).hexdigest()[:16]
        schema = T.StructType.fromJson(json.loads(about["schema"]))
        index = SearchIndex(spark, path, name, tuple(about["fields"]), about["buckets"], schema, commits)
        key = schema["doc_id"].dataType.simpleString()
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        for table, kept, order in (
            ("docs", f"{columns}, {CELL} bigint", CELL),
            ("blocks", f"{CELL} bigint, field string, term string, n bigint, n_tokens bigint, n_first bigint, "
                       f"max_tf bigint, min_len int, entries array<struct<doc_id: {key}, tf: bigint, len: int>>, "
                       "positions array<array<int>>", "field, term"),
            ("dead", f"doc_id {key}, {CELL} bigint", CELL),
        ):
            if not spark.catalog.tableExists(f"{name}_{table}"):
                spark.sql(
                    f"CREATE TABLE {name}_{table} ({kept}, {SEGMENT} string) USING parquet PARTITIONED BY ({SEGMENT}) "
                    f"CLUSTERED BY ({CELL}) SORTED BY ({order}) INTO {index.buckets} BUCKETS LOCATION '{path}/{table}'")
                if path_exists(spark, f"{path}/{table}"):
                    spark.sql(f"MSCK REPAIR TABLE {name}_{table}")
        return index

    def close(self) -> None:
        """Take the tables out of the catalog; the stored index stays."""
        for table in ("docs", "blocks", "dead"):
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}_{table}")

    # -- additions -------------------------------------------------------------------

    def add(self, docs: DataFrame | None = None, removed: DataFrame | None = None, batch: str | None = None) -> SearchIndex:
        """The index with ``docs`` added, documents of the same ``doc_id`` replaced, and
        those of ``removed`` (doc_id) gone. Ids are distinct within ``docs``; one that is
        both added and removed is added. A ``batch`` that is committed is not added again."""
        if self.commits.has(batch):
            return self
        segment, number = self.commits.next()
        old = None
        if self.live:
            changed = [d.select("doc_id") for d in (docs, removed) if d is not None]
            ids = changed[0] if len(changed) == 1 else changed[0].union(changed[1])
            ids = materialise(ids.distinct(), "changed-documents")
            old = materialise(self.docs.join(ids, "doc_id", "left_semi"), "replaced-documents")
            if not old.limit(1).count():
                old = None
        if docs is not None:
            self._write_docs(docs, segment, number)
            self._write_blocks(segment)
        counted = self._counted(segment)
        totals = self._totals(segment)
        if old is not None:
            self._write(old.select("doc_id", CELL), "dead", segment, CELL)
            analysed = materialise(self._analysed(old.select("doc_id", *self.fields)), "replaced-words")
            lost = analysed.select("field", F.explode(F.array_distinct("terms")).alias("term")).groupBy("field", "term").agg(
                (-F.count("*")).alias("df"))
            counted = counted.unionByName(lost).groupBy("field", "term").agg(F.sum("df").alias("df")).filter("df <> 0")
            gone = analysed.groupBy("field").agg((-F.count("*")).alias("n_docs"), (-F.sum(F.size("terms"))).alias("n_tokens"))
            totals = totals.unionByName(gone)
        # In the order of words, so that a condition on words skips most of a large table.
        counted.sortWithinPartitions("field", "term").write.parquet(f"{self.path}/words/{SEGMENT}={segment}")
        totals.coalesce(1).write.parquet(f"{self.path}/stats/{SEGMENT}={segment}")
        return self._commit(segment, number, [], batch, old is not None)

    def merge(self) -> SearchIndex:
        """The same index in one segment, without tombstones."""
        if len(self.live) < 2 and not self._has_dead:
            return self
        segment, number = self.commits.next()
        self._write_docs(self.docs.drop(CELL), segment, number)
        self._write_blocks(segment)
        self._counted(segment).sortWithinPartitions("field", "term").write.parquet(f"{self.path}/words/{SEGMENT}={segment}")
        self._totals(segment).coalesce(1).write.parquet(f"{self.path}/stats/{SEGMENT}={segment}")
        return self._commit(segment, number, self.live, None, False)

    def _commit(self, *commit) -> SearchIndex:
        return replace(self, commits=self.commits.add(*commit))

    def _write(self, rows: DataFrame, table: str, segment: str, *order: str) -> None:
        (
            rows.withColumn(SEGMENT, F.lit(segment)).write.mode("append").format("parquet").partitionBy(SEGMENT)
            .bucketBy(self.buckets, CELL).sortBy(*order).option("path", f"{self.path}/{table}")
            .option("parquet.block.size", GROUP_BYTES).saveAsTable(f"{self.name}_{table}")
        )

    def _write_docs(self, docs: DataFrame, segment: str, number: int) -> None:
        """Documents in cells: segment, length class, and a hash within the class. The
        classes are steps of a quarter of a power of two, so they are few."""
        size = sum((F.coalesce(F.octet_length(F.col(f)), F.lit(0)) for f in self.fields), F.lit(0))
        step = F.floor(F.log2(size + 1.0) * 4).cast("long")
        classes = docs.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect()
        cells = F.create_map(*(F.lit(x) for r in classes for x in (r["step"], -(-r["n"] // CELL_DOCS)))) if classes else None
        within = F.pmod(F.xxhash64("doc_id"), cells[step]) if classes else F.lit(0)
        cell = F.lit(number << 44) + F.shiftleft(step, 36) + within
        columns = [F.col(f.name) for f in self.schema]
        placed = docs.select(*columns, cell.cast("long").alias(CELL))
        self._write(placed.repartition(self.buckets, CELL), "docs", segment, CELL)

    def _analysed(self, docs: DataFrame) -> DataFrame:
        entries = F.array(
            *[F.struct(F.lit(f).alias("field"), search_tokens(F.col(f)).alias("terms")) for f in self.fields])
        others = [c for c in docs.columns if c not in self.fields or c == "doc_id"]
        return docs.select(*others, F.inline(entries)).filter(F.size("terms") > 0)

    def _write_blocks(self, segment: str) -> None:
        stored = self._table("docs").filter(F.col(SEGMENT) == segment).select("doc_id", CELL, *self.fields)
        blocks = self._table("blocks")
        schema = T.StructType([f for f in blocks.schema if f.name != SEGMENT])
        self._write(self._analysed(stored).mapInArrow(_gather, schema), "blocks", segment, "field", "term")

    def _counted(self, segment: str) -> DataFrame:
        mine = self._table("blocks").filter(F.col(SEGMENT) == segment)
        return mine.groupBy("field", "term").agg(F.sum("n").alias("df"))

    def _totals(self, segment: str) -> DataFrame:
        """A document with words has exactly one at position 0, and its length is the
        number of its tokens."""
        mine = self._table("blocks").filter(F.col(SEGMENT) == segment)
        return mine.groupBy("field").agg(F.sum("n_first").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))

    # -- reading ---------------------------------------------------------------------

    @property
    def live(self) -> list[str]:
        return self.commits.live

    @property
    def _has_dead(self) -> bool:
        return self.commits.has_dead

    def _table(self, name: str) -> DataFrame:
        return self.spark.table(f"{self.name}_{name}")

    def _live_table(self, name: str) -> DataFrame:
        return self._table(name).filter(F.col(SEGMENT).isin(self.live)).drop(SEGMENT)

    def _dead(self) -> DataFrame:
        """(_cell, _ids): the documents of a cell that are dead."""
        return self._live_table("dead").groupBy(CELL).agg(F.collect_set("doc_id").alias("_ids"))

    @property
    def docs(self) -> DataFrame:
        rows = self._live_table("docs")
        if not self._has_dead:
            return rows
        alive = F.col("_ids").isNull() | ~F.array_contains("_ids", F.col("doc_id"))
        return rows.join(self._dead(), CELL, "left").filter(alive).select(*(f.name for f in self.schema), CELL)

    @property
    def blocks(self) -> DataFrame:
        return self._live_table("blocks")

    def asked_blocks(self, wanted: DataFrame | None) -> DataFrame:
        """The blocks of the words of the stored ``wanted`` (field, term). A short list of
        words is given to the scan; a long one meets the blocks in the join that follows."""
        if wanted is None:
            return self.blocks
        words = [r["term"] for r in wanted.select("term").distinct().limit(LISTED_WORDS + 1).collect()]
        return self.blocks if len(words) > LISTED_WORDS else self.blocks.filter(F.col("term").isin(words))

    def lists(self, wanted: DataFrame | None = None, docs: DataFrame | None = None, positions: bool = False,
              blocks: DataFrame | None = None) -> DataFrame:
        """(_cell, field, term, e): the postings of a word in a cell as one array of
        ``entries`` and ``positions``, of the live documents, of the words of ``wanted``
        (stored) and of the documents of ``docs`` where they are given. Documents meet
        blocks by cell, in which both are bucketed: postings are sorted out where they
        are read."""
        blocks = self.asked_blocks(wanted) if blocks is None else blocks
        entries = F.arrays_zip("entries", "positions") if positions else F.transform("entries", lambda e: F.struct(e.alias("entries")))
        rows = blocks.select(CELL, "field", "term", entries.alias("e"))
        if docs is not None:
            if CELL not in docs.columns:
                docs = self.docs.select("doc_id", CELL).join(docs.select("doc_id"), "doc_id", "left_semi")
            ids = docs.groupBy(CELL).agg(F.collect_set("doc_id").alias("_ids"))
            rows = rows.join(ids, CELL).withColumn("e", F.filter("e", lambda e: F.array_contains("_ids", e["entries"]["doc_id"])))
        elif self._has_dead:
            kept = F.filter("e", lambda e: ~F.array_contains("_ids", e["entries"]["doc_id"]))
            rows = rows.join(self._dead(), CELL, "left").withColumn("e", F.when(F.col("_ids").isNull(), F.col("e")).otherwise(kept))
        return rows.select(CELL, "field", "term", "e")

    def postings(self, wanted: DataFrame | None = None, docs: DataFrame | None = None, positions: bool = False,
                 blocks: DataFrame | None = None) -> DataFrame:
        """(_cell, field, term, doc_id, tf, len) and ``positions``, a row for each posting of ``lists``."""
        flat = self.lists(wanted, docs, positions, blocks).select(CELL, "field", "term", F.explode("e").alias("e"))
        return flat.select(CELL, "field", "term", "e.entries.*", *(["e.positions"] if positions else []))

    def _parts(self, name: str, schema: str) -> DataFrame:
        """The plain table ``name`` of the live segments."""
        paths = [f"{self.path}/{name}/{SEGMENT}={s}" for s in self.live]
        return self.spark.read.schema(schema).parquet(*paths)

    @property
    def words(self) -> DataFrame:
        parts = self._parts("words", "field string, term string, df long")
        if len(self.live) == 1:
            return parts
        return parts.groupBy("field", "term").agg(F.sum("df").alias("df")).filter("df > 0")

    @property
    def stats(self) -> DataFrame:
        parts = self._parts("stats", "field string, n_docs long, n_tokens long")
        return parts.groupBy("field").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n")).filter("n_docs > 0").select(
            "field", "n_docs", (F.col("n") / F.col("n_docs")).alias("avg_len"))

    def _stored(self, name: str, table) -> DataFrame:
        version = hashlib.md5(",".join(self.live).encode()).hexdigest()[:12]
        path = f"{self.path}/{name}-{version}"
        if not path_exists(self.spark, f"{path}/_SUCCESS"):
            table().write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    @property
    def deletion_keys(self) -> DataFrame:
        """(field, term, df, key, deleted): strings reached by deleting up to two characters."""
        return self._stored("deletion_keys", lambda: with_deletion_keys(self.words, "term"))

    @property
    def grams(self) -> DataFrame:
        """(field, term, anchor): the stretches of up to GRAM characters of each word."""
        sizes = F.array(*[F.lit(n) for n in range(1, GRAM + 1)])
        return self._stored("grams", lambda: (
            self.words.withColumn("start", F.explode(F.sequence(F.lit(1), F.length("term"))))
            .withColumn("size", F.explode(sizes))
            .select("field", "term", F.expr("substring(term, start, size)").alias("anchor"))
            .distinct()
        ))

    def word_stats(self, needed: DataFrame) -> DataFrame:
        """(field, term, df, idf, avg_len) of the needed (field, term)."""
        n, df = F.col("n_docs"), F.col("df")
        idf = F.ln(1 + (n - df + 0.5) / (df + 0.5))
        found = self.words.join(needed, ["field", "term"], "left_semi")
        return found.join(self.stats, "field").select("field", "term", "df", idf.alias("idf"), "avg_len")
