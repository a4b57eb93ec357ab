"""Removal of repeated runs of lines, found by winnowing.

A document is the sequence of its lines that hold a word, without outer white space.
Of every ``run`` consecutive lines the one of smallest hash (the last on a tie) is a
fingerprint, so any shared run of that length or more shares a fingerprint. No text
travels: the positions of fingerprints that occur twice are joined, with the hashes of
the windows they stand for, each is extended both ways to the runs around it, and all
but the first occurrence of a run are deleted. Runs that follow each other merge into
longer ones.

Where ``passage_words`` is given, one line or a few that hold so many words are a run
too. There each such window is a fingerprint of its own. Fingerprints and windows that
very many documents share are split over many tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstack.llm.common import join_split, rows
from quillstack.session import materialise

SPACE = " \t\n\v\f\r"
SCHEMA = "key struct<id: {0}, h: long>, fp long, start int, size int, runs array<binary>"


def lines_of(text: str | None) -> list[tuple[int, str]]:
    """Place and content of the lines that hold a word."""
    if not text:
        return []
    return [(k, s) for k, line in enumerate(text.split("\n")) if (s := line.strip(SPACE))]


def fingerprints(hashes: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of ``run`` lines the place of its minimum, the last on a tie;
    and where in that list a new minimum begins."""
    windows = np.lib.stride_tricks.sliding_window_view(hashes, run)
    places = np.arange(len(windows)) + run - 1 - np.argmin(windows[:, ::-1], axis=1)
    return places, np.flatnonzero(np.concatenate([[True], places[1:] != places[:-1]]))


def passages(lines: list[str], run: int, words: int | None) -> list[tuple[int, int]]:
    """Start and size of the windows of fewer than ``run`` lines that hold ``words`` words."""
    if words is None:
        return []
    ends = np.concatenate([[0], np.cumsum([len(line.split()) for line in lines], dtype=np.int64)])
    return [(int(s), size) for size in range(1, min(run, len(lines) + 1))
            for s in np.flatnonzero(ends[size:] - ends[:-size] >= words)]


def delete(text: str, starts: list) -> tuple[str, int, int]:
    """The text without the runs of these starts and sizes, the number of lines with
    a word, and of deleted lines."""
    lines = lines_of(text)
    gone = {lines[k][0] for s in starts for k in range(s["start"], s["start"] + s["size"])}
    kept = "\n".join(line for k, line in enumerate(text.split("\n")) if k not in gone)
    return kept, len(lines), len(gone)


def repeated_runs(docs: DataFrame, id_col: str, text_col: str, run: int,
                  passage_words: int | None = None) -> DataFrame:
    """``(key, starts)``: of each document that repeats something, the first lines and
    the sizes of the runs that also start earlier (in a smaller id, or further up).

    A key is the id and a hash of the text: rows that agree in both are one document.
    Null ids come first; documents of one id are ordered by that hash."""
    keyed = docs.select(F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h")).alias("key"),
                        F.col(text_col).alias("text"))
    kind = dict(docs.dtypes)[id_col]

    def positions(batches):
        for part in rows(batches):
            keys, fps, starts, sizes, runs = [], [], [], [], []
            for n, text in enumerate(part.column("text").to_pylist()):
                lines = [line.encode("utf-8", "surrogatepass") for _, line in lines_of(text)]
                marks = [xxhash.xxh3_128_digest(line) for line in lines]
                for s, size in passages(lines, run, passage_words):
                    name = xxhash.xxh3_128_digest(b"".join(marks[s:s + size]))
                    keys.append(n)
                    fps.append(np.frombuffer(name, np.uint64, 1)[0])
                    starts.append(s)
                    sizes.append(size)
                    runs.append([name])
                if len(lines) < run:
                    continue
                hashes = np.array([int.from_bytes(m[:8], "little") for m in marks], np.uint64)
                names = [xxhash.xxh3_128_digest(b"".join(marks[s:s + run])) for s in range(len(marks) - run + 1)]
                places, first = fingerprints(hashes, run)
                for a, b in zip(first, [*first[1:], len(places)]):
                    keys.append(n)
                    fps.append(hashes[places[a]])
                    starts.append(a)
                    sizes.append(run)
                    runs.append(names[a:b])
            yield pa.RecordBatch.from_arrays(
                [part.column("key").take(pa.array(keys, pa.int64())), pa.array(np.array(fps, np.uint64).view(np.int64)),
                 pa.array(starts, pa.int32()), pa.array(sizes, pa.int32()), pa.array(runs, pa.list_(pa.binary()))],
                ["key", "fp", "start", "size", "runs"])

    found = materialise(keyed.mapInArrow(positions, SCHEMA.format(kind)), "line-fingerprints")
    again = materialise(found.groupBy("fp").agg(F.count("*").alias("n")).filter("n > 1"), "line-repeats")
    near = materialise(
        join_split(found, again, "fp", F.struct("key", "start"))
        .select("key", "start", "size", F.posexplode("runs").alias("step", "name"))
        .select("name", "key", "size", (F.col("start") + F.col("step")).alias("start")), "line-runs")
    place = F.struct("key", "start")
    groups = near.groupBy("name").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count("*").alias("n"))
    first = materialise(groups.filter("first <> last").select("name", "first", "n"), "line-firsts")
    later = join_split(near, first, "name", place).filter(place != F.col("first"))
    return later.groupBy("key").agg(F.sort_array(F.collect_set(F.struct("start", "size"))).alias("starts"))


def dedupe_lines(docs: DataFrame, run: int = 3, id_col: str = "doc_id", text_col: str = "text",
                 passage_words: int | None = None) -> DataFrame:
    """``docs`` with the repeated runs of ``run`` lines or more deleted from the text,
    and ``n_lines`` and ``n_deleted`` added (columns of these names are replaced). With
    ``passage_words``, fewer lines that hold so many words in all are a run as well.

    Other columns stay as they are. A null or empty text, and one with fewer lines that
    is no such passage, is not changed; a text that repeats others throughout becomes empty or keeps only
    its blank lines. Rows that agree in id and text are treated alike."""
    starts = materialise(repeated_runs(docs, id_col, text_col, run, passage_words), "line-deletions")
    columns = [c for c in docs.columns if c not in ("n_lines", "n_deleted")]
    others = [c for c in columns if c != text_col]
    left = docs.select(F.struct(*others).alias("row"),
                       F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h")).alias("key"),
                       F.col(text_col).alias("text"))
    # One way at every size: the texts meet their deletions by a merge join.
    joined = left.join(starts.withColumnRenamed("key", "of").hint("merge"), F.col("key").eqNullSafe(F.col("of")), "left")

    def cut(batches):
        for part in rows(batches):
            out = [(t, len(lines_of(t)), 0) if not s else delete(t, s)
                   for t, s in zip(part.column("text").to_pylist(), part.column("starts").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [part.column("row"), pa.array([o[0] for o in out], pa.string()),
                 *(pa.array([o[k] for o in out], pa.int64()) for k in (1, 2))],
                ["row", "text", "n_lines", "n_deleted"])

    kind = left.schema["row"].dataType.simpleString()
    done = joined.select("row", "text", "starts").mapInArrow(cut, f"row {kind}, text string, n_lines long, n_deleted long")
    return done.select(*(F.col("text").alias(c) if c == text_col else F.col(f"row.`{c}`") for c in columns),
                       "n_lines", "n_deleted")
