"""Word splitting for models and for search, and arrays with running positions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MODEL_WORD = r"[\p{L}\p{N}_]{2,}"
# The possessive repeat keeps the Java matcher from recursing on "a.b.c. ..." runs.
SEARCH_WORD = r"[\p{L}\p{N}_]+(?:['.’][\p{L}\p{N}_]+)*+"
SEARCH_PIECE = SEARCH_WORD + r"|[^\p{L}\p{N}_]+"


def model_tokens(text: Column, lowercase: bool = True) -> Column:
    """Runs of at least two word characters."""
    return F.regexp_extract_all(F.lower(text) if lowercase else text, F.lit(MODEL_WORD), 0)


def search_tokens(text: Column) -> Column:
    """G1: words in lower case, joined across inner apostrophes and dots."""
    return F.regexp_extract_all(F.lower(text), F.lit(SEARCH_WORD), 0)


def search_pieces(text: Column) -> Column:
    """Words and the stretches between them; joined together they give the text back."""
    return F.regexp_extract_all(text, F.lit(SEARCH_PIECE), 0)


def word_ngrams(words: str, sizes: tuple[int, ...] = (1, 2, 3)) -> Column:
    """N-grams of several sizes in one array, words joined by a space.

    ``words`` names a column, so that the words are split once per row.
    """
    tokens = F.col(words)
    nothing = F.array().cast("array<string>")

    def joined(n: int) -> Column:
        starts = F.sequence(F.lit(0), F.size(tokens) - n)
        grams = F.transform(
            starts, lambda i: F.concat_ws(" ", *[F.get(tokens, i + k) for k in range(n)])
        )
        return F.when(F.size(tokens) >= n, grams).otherwise(nothing)

    return F.concat(*[tokens if n == 1 else joined(n) for n in sizes])


def _running_starts(lengths: pa.Array) -> pa.Array:
    """Start offset of each piece, given the piece lengths of one row.

    One cumulative sum over the whole Arrow batch, re-based at each row.
    """
    lengths = lengths if isinstance(lengths, pa.Array) else lengths.combine_chunks()
    counts = pc.fill_null(pc.list_value_length(lengths), 0).to_numpy(zero_copy_only=False)
    flat = lengths.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    total = np.concatenate([[0], np.cumsum(flat)])
    bounds = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    starts = total[:-1] - np.repeat(total[bounds[:-1]], counts)
    return pa.ListArray.from_arrays(
        pa.array(bounds, pa.int32()), pa.array(starts, pa.int32()), mask=lengths.is_null()
    )


# Declared nondeterministic so that the optimiser neither copies the call nor
# moves it into another expression.
running_starts = F.arrow_udf(_running_starts, T.ArrayType(T.IntegerType())).asNondeterministic()


def with_starts(pieces: Column) -> Column:
    """Pieces as ARRAY<STRUCT<piece, start>>, start in characters from zero."""
    return F.arrays_zip(
        pieces.alias("piece"), running_starts(F.transform(pieces, F.length)).alias("start")
    )
