"""Removal of repeated word windows by automata of recurring phrases.

A window is ``WINDOW`` consecutive words; words in a window that also starts earlier
are removed. Of the ``GRAM``-word phrases in a window the one of smallest hash is its
anchor, so equal windows have equal anchors and only about a sixth of the positions
are anchors at all.

1. Anchors are counted; those found once cannot lie in a recurring window.
2. The recurring anchors of a document are sent to it. For each slice of documents
   their phrases are compiled into an Aho-Corasick automaton over the words themselves
   (pyahocorasick) and the documents of the slice are streamed through it. As the phrases
   are those at the slice's own anchors, it finds these places again; what recurs is
   decided by the hashes of anchors before and of passages after. Around an occurrence
   lies its passage, the union of the windows that have this anchor.
3. Of equal passages all but the first are removed whole. Only where one anchor has
   different passages are the windows of the first of each compared one by one.

The documents are stored bucketed by id once, so that their texts are not shuffled
again for each of these steps.
"""

from __future__ import annotations

import math
import uuid

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstack.llm.common import WordHashes, byte_words, release, rows, sequence_hashes
from quillstack.session import materialise

WINDOW, GRAM = 20, 8
STEPS = WINDOW - GRAM + 1
BUCKET_BYTES = 16 << 20
AUTOMATON_BYTES = 4 << 20
BASE = 64


def _sliding(values: np.ndarray, best) -> np.ndarray:
    """Best of every STEPS consecutive values, by doubling."""
    width, out = 1, values
    while 2 * width <= STEPS:
        out = best(out[:-width], out[width:])
        width *= 2
    rest = STEPS - width
    return best(out[:-rest], out[rest:]) if rest else out


class Slice:
    """Word hashes, anchors and passages of a few documents laid end to end."""

    def __init__(self, words: list[list[bytes]], hashes: WordHashes):
        self.ends = np.cumsum([len(w) for w in words], dtype=np.int64)
        self.starts = self.ends - [len(w) for w in words]
        self.h = hashes.of([x for w in words for x in w])
        self.owner = np.repeat(np.arange(len(words)), self.ends - self.starts)
        n = len(self.h)
        if n < WINDOW:
            self.grams = self.anchors = np.empty(0, np.uint64)
            self.places = self.low = self.high = np.empty(0, np.int64)
            return
        grams = sequence_hashes(self.h, GRAM)
        least = _sliding(grams, np.minimum)
        inside = self.owner[: n - WINDOW + 1] == self.owner[WINDOW - 1:]
        self.least = np.where(inside, least, np.uint64(0))
        pad = np.zeros(STEPS - 1, np.uint64)
        most = _sliding(np.concatenate([pad, self.least, pad]), np.maximum)
        self.places = np.flatnonzero((most == grams) & (most > 0))
        self.anchors = grams[self.places]
        self.low = np.full(len(self.places), n, np.int64)
        self.high = np.full(len(self.places), -1, np.int64)
        for step in range(STEPS):  # the windows that have this anchor follow each other
            at = self.places - step
            ok = (at >= 0) & (at < len(self.least))
            ok[ok] = self.least[at[ok]] == self.anchors[ok]
            self.low = np.where(ok, np.minimum(self.low, at), self.low)
            self.high = np.where(ok, np.maximum(self.high, at), self.high)


class PhraseAutomaton:
    """Locates phrases of GRAM words in lists of words. Each word of a phrase is
    written with a fixed number of symbols, all other words alike, so that a match is
    one of whole words."""

    def __init__(self, phrases: list[tuple[bytes, ...]]):
        number: dict[bytes, int] = {}
        for phrase in phrases:
            for word in phrase:
                number.setdefault(word, len(number) + 1)
        self.digits = max(1, math.ceil(math.log(len(number) + 1, BASE) + 1e-9))
        self.code = {w: self._write(n) for w, n in number.items()}
        self.other = self._write(0)
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for k, phrase in enumerate(phrases):
            self.machine.add_word("".join(map(self.code.__getitem__, phrase)), k)
        self.machine.make_automaton()

    def _write(self, n: int) -> str:
        out = ""
        for _ in range(self.digits):
            n, digit = divmod(n, BASE)
            out += chr(48 + digit)
        return out

    def find(self, words: list[bytes]) -> np.ndarray:
        """Places of the first words of all occurrences, in order."""
        code, other = self.code, self.other
        text = "".join([code.get(w, other) for w in words])
        ends = np.fromiter((end for end, _ in self.machine.iter(text)), np.int64)
        ends = ends[ends % self.digits == self.digits - 1]
        return (ends + 1) // self.digits - GRAM


def _take(batch: pa.RecordBatch, at) -> list[pa.Array]:
    at = pa.array(np.asarray(at, np.int64))
    return [batch.column("id").take(at), batch.column("h").take(at)]


def bucketed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, h, text)`` of the rows with an id, stored in buckets of the id."""
    spark = docs.sparkSession
    kept = docs.select(F.col(id_col).alias("id"), F.hash(text_col).alias("h"), F.col(text_col).alias("text"))
    size = kept.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(spark.sparkContext.defaultParallelism, math.ceil(size / BUCKET_BYTES))
    name = f"phrase_dedup_{uuid.uuid4().hex}"
    kept.filter("id IS NOT NULL").repartition(buckets, "id").write.format("parquet").option(
        "compression", "zstd").bucketBy(buckets, "id").saveAsTable(name)
    release(spark)
    return spark.table(name)


def anchors(docs: DataFrame) -> DataFrame:
    """``(fp, id)`` for each anchor of each document."""
    def run(batches):
        hashes = WordHashes()
        for part in rows(batches):
            found = Slice(byte_words(part), hashes)
            yield pa.RecordBatch.from_arrays(
                [pa.array(found.anchors.view(np.int64)),
                 part.column("id").take(pa.array(found.owner[found.places] if len(found.places) else found.places))],
                ["fp", "id"])

    kind = dict(docs.dtypes)["id"]
    return docs.select("id", "text").mapInArrow(run, f"fp long, id {kind}")


def passages(docs: DataFrame, recurring: DataFrame) -> DataFrame:
    """``(fp, passage, id, h, start, windows)`` for each occurrence of a recurring
    anchor: a hash of its passage, and the windows that make it up."""
    per_doc = recurring.groupBy("id").agg(F.collect_set("fp").alias("fps"))

    def run(batches):
        hashes = WordHashes()
        for part in rows(batches, limit=AUTOMATON_BYTES):
            words = byte_words(part)
            found = Slice(words, hashes)
            fps = part.column("fps")
            known = np.asarray(pa.concat_arrays([fps.flatten()]), np.int64).view(np.uint64)
            wanted = np.flatnonzero(np.isin(found.anchors, known))
            # One phrase for each anchor hash and for each word sequence of it.
            phrases = {tuple(words[d][p: p + GRAM]) for d, p in zip(
                found.owner[found.places[wanted]].tolist(),
                (found.places[wanted] - found.starts[found.owner[found.places[wanted]]]).tolist())}
            if not phrases:
                continue
            automaton = PhraseAutomaton(sorted(phrases))
            located = np.concatenate([automaton.find(w) + s for w, s in zip(words, found.starts)])
            at = np.flatnonzero(np.isin(found.places, located))
            low, high = found.low[at], found.high[at]
            data, digest = found.h, xxhash.xxh3_64_intdigest
            marks = np.fromiter((digest(data[a: b + WINDOW].tobytes()) for a, b in zip(low.tolist(), high.tolist())),
                                np.uint64, len(at))
            owner = found.owner[low] if len(low) else low
            yield pa.RecordBatch.from_arrays(
                [pa.array(found.anchors[at].view(np.int64)), pa.array(marks.view(np.int64)), *_take(part, owner),
                 pa.array((low - found.starts[owner]).astype(np.int32)), pa.array((high - low + 1).astype(np.int32))],
                ["fp", "passage", "id", "h", "start", "windows"])

    kind = dict(docs.dtypes)["id"]
    return docs.join(per_doc, "id").mapInArrow(
        run, f"fp long, passage long, id {kind}, h int, start int, windows int")


def windows(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """``(fp, name, id, h, start)`` for each window of the passages ``(fp, id, h, start,
    windows)``; ``name`` is a hash of its words."""
    per_doc = chosen.groupBy("id").agg(F.collect_list(F.struct("h", "fp", "start", "windows")).alias("asked"))

    def run(batches):
        hashes = WordHashes()
        for part in rows(batches):
            out: list[list] = [[], [], [], []]
            own = part.column("h").to_pylist()
            for d, (words, asked) in enumerate(zip(byte_words(part), part.column("asked").to_pylist())):
                names = sequence_hashes(hashes.of(words), WINDOW, seed=1).view(np.int64)
                for a in asked:
                    if a["h"] == own[d]:
                        s, n = a["start"], a["windows"]
                        out[0].append(np.full(n, a["fp"]))
                        out[1].append(names[s: s + n])
                        out[2].append(np.full(n, d))
                        out[3].append(np.arange(s, s + n))
            fp, name, owner, start = (np.concatenate(o) if o else np.empty(0, np.int64) for o in out)
            yield pa.RecordBatch.from_arrays(
                [pa.array(fp), pa.array(name), *_take(part, owner), pa.array(start.astype(np.int32))],
                ["fp", "name", "id", "h", "start"])

    kind = dict(docs.dtypes)["id"]
    return docs.join(per_doc, "id").mapInArrow(run, f"fp long, name long, id {kind}, h int, start int")


def repeats(docs: DataFrame) -> DataFrame:
    """``(id, h, start, windows)``: runs of windows that also start earlier; ``docs`` as
    from ``bucketed``."""
    listed = materialise(anchors(docs), "phrase-anchors")
    twice = listed.groupBy("fp").agg(F.count("*").alias("n")).filter("n > 1").select("fp")
    recurring = materialise(listed.join(twice, "fp"), "phrase-recurring")
    release(docs.sparkSession)
    found = materialise(passages(docs, recurring), "phrase-passages")
    release(docs.sparkSession)
    place = F.struct("id", "h", "start")
    first = materialise(
        found.groupBy("fp", "passage").agg(F.min(place).alias("first"), F.first("windows").alias("windows")),
        "phrase-first")
    later = found.join(first.select("fp", "passage", "first"), ["fp", "passage"]).filter(
        place != F.col("first")).select("id", "h", "start", "windows")
    several = first.groupBy("fp").agg(F.count("*").alias("n")).filter("n > 1").select("fp")
    unlike = first.join(several, "fp").select("fp", "first.*", "windows")
    single = materialise(windows(docs, unlike), "phrase-windows")
    release(docs.sparkSession)
    name = single.groupBy("fp", "name").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    again = single.join(name.filter("first <> last").select("fp", "name", "first"), ["fp", "name"]).filter(
        place != F.col("first")).select("id", "h", "start", F.lit(1).alias("windows"))
    return later.unionByName(again)


def keep(words: list[bytes], runs: list[tuple[int, int]]) -> list[bytes]:
    """The words outside the runs ``(first window, number of windows)``."""
    edge = np.zeros(len(words) + 1, np.int64)
    for start, n in runs:
        edge[start] += 1
        edge[start + n - 1 + WINDOW] -= 1
    return [words[k] for k in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_words, n_removed, kept)``, one row for each row of ``docs``; ``kept`` is
    the remaining words joined by one space.

    Earlier means a smaller id, or further up in the same document; texts of one id are
    ordered by a hash, rows equal in both are one document. Rows without an id neither
    lose words nor count as earlier. A null, empty or short text is kept as it is. Other
    columns are not looked at."""
    table = bucketed(docs, id_col, text_col)
    kind = dict(table.dtypes)["id"]
    runs = materialise(
        repeats(table).groupBy("id").agg(F.collect_set(F.struct("h", "start", "windows")).alias("runs")),
        "phrase-removals")
    release(docs.sparkSession)

    def cut(batches):
        for part in rows(batches):
            own, asked = part.column("h").to_pylist(), part.column("runs").to_pylist()
            words = byte_words(part)
            left = [keep(w, [(r["start"], r["windows"]) for r in a if r["h"] == h]) if a else w
                    for w, a, h in zip(words, asked, own)]
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), pa.array([len(w) for w in words], pa.int64()),
                 pa.array([len(w) - len(k) for w, k in zip(words, left)], pa.int64()),
                 pa.array([b" ".join(k) for k in left], pa.binary()).cast(pa.string())],
                ["id", "n_words", "n_removed", "kept"])

    schema = f"id {kind}, n_words long, n_removed long, kept string"
    nameless = docs.filter(F.col(id_col).isNull()).select(
        F.col(id_col).alias("id"), F.hash(text_col).alias("h"), F.col(text_col).alias("text"),
        F.lit(None).cast(dict(runs.dtypes)["runs"]).alias("runs"))
    done = table.join(runs, "id", "left").select("id", "h", "text", "runs").unionByName(nameless)
    return done.mapInArrow(cut, schema).withColumnRenamed("id", id_col)
