"""Edit distance with swaps, and the keys that bring close words together."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _edits(a: str, b: str) -> int:
    """Unrestricted Damerau-Levenshtein distance (Lowrance and Wagner 1975).

    Row and column 0 of the table hold an unreachable cost, so that a swap
    partner that does not exist is never chosen.
    """
    far = len(a) + len(b)
    table = [[far] * (len(b) + 2), [far, *range(len(b) + 1)]]
    seen: dict[str, int] = {}
    for i, x in enumerate(a, 1):
        row, above, match_col = [far, i], table[i], 0
        for j, y in enumerate(b, 1):
            partner = seen.get(y, 0)
            swap = table[partner][match_col] + (i - partner - 1) + 1 + (j - match_col - 1)
            if x == y:
                match_col = j
            row.append(min(above[j] + (x != y), row[j] + 1, above[j + 1] + 1, swap))
        table.append(row)
        seen[x] = i
    return table[-1][-1]


@F.arrow_udf(T.IntegerType())
def edit_distance(left: pa.Array, right: pa.Array) -> pa.Array:
    return pa.array(
        [
            None if a is None or b is None else _edits(a, b)
            for a, b in zip(left.to_pylist(), right.to_pylist())
        ],
        pa.int32(),
    )


def allowed_edits(term: Column) -> Column:
    """0, 1 or 2 edits for terms of up to 2, 3 to 5, or more characters."""
    n = F.length(term)
    return F.when(n <= 2, 0).when(n <= 5, 1).otherwise(2)


def with_deletion_keys(words: DataFrame, column: str) -> DataFrame:
    """One row per string reached by deleting up to two characters: adds ``key``
    and ``deleted``.

    Every edit, a swap included, is undone by at most one deletion on either
    side, so two words within k edits share a key of at most k deletions each:
    an equi-join on the keys misses no pair. ``i`` and ``j`` are the deleted
    places; ``i = 0`` deletes nothing and ``j = i`` only one character.
    """
    word, size = F.col(column), F.length(column)
    i, j = F.col("__i"), F.col("__j")
    second = F.when(i == 0, F.array(F.lit(0))).otherwise(F.sequence(i, size))
    middle = F.when(j > i, F.substring(word, i + 1, j - i - 1)).otherwise("")
    return (
        words.withColumn("__i", F.explode(F.sequence(F.lit(0), size)))
        .withColumn("__j", F.explode(second))
        .withColumn("key", F.concat(F.substring(word, F.lit(1), i - 1), middle, F.substring(word, j + 1, size)))
        .withColumn("deleted", (i > 0).cast("int") + (j > i).cast("int"))
        .drop("__i", "__j")
    )
