"""String cleaning, all on the JVM except the stemmer."""

from __future__ import annotations

import re
import string
import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstack.functions.stem import stem

# English stop words, and the extra corpus word at the end.
STOP_WORDS = (
    "i me my myself we our ours ourselves you you're you've you'll you'd your yours "
    "yourself yourselves he him his himself she she's her hers herself it it's its itself "
    "they them their theirs themselves what which who whom this that that'll these those "
    "am is are was were be been being have has had having do does did doing a an the and "
    "but if or because as until while of at by for with about against between into through "
    "during before after above below to from up down in out on off over under again further "
    "then once here there when where why how all any both each few more most other some such "
    "no nor not only own same so than too very s t can will just don don't should should've "
    "now d ll m o re ve y ain aren aren't couldn couldn't didn didn't doesn doesn't hadn "
    "hadn't hasn hasn't haven haven't isn isn't ma mightn mightn't mustn mustn't needn "
    "needn't shan shan't shouldn shouldn't wasn wasn't weren weren't won won't wouldn "
    "wouldn't footnote"
).split()

NON_ASCII = r"[^\x00-\x7F]"
TAG = r"<[^>]+>"
PUNCTUATION = r"[!-/:-@\[-`{-~]+"
WHITESPACE = r"[\t-\r\x1c-\x20]+"
DIGITS = r"[0-9]+"
MIN_TOKEN = 3
SNIPPET = 1000


@lru_cache(maxsize=1)
def _ascii_folds() -> tuple[str, str, dict[str, str]]:
    """ASCII remainders of every non-ASCII character under NFKD: one-to-one
    pairs as two aligned strings, and the characters that expand to several."""
    source, target, expanding = [], [], {}
    for code in range(0x80, 0x110000):
        ch = chr(code)
        folded = unicodedata.normalize("NFKD", ch).encode("ascii", "ignore").decode()
        if len(folded) == 1:
            source.append(ch)
            target.append(folded)
        elif folded:
            expanding[ch] = folded
    return "".join(source), "".join(target), expanding


def _ranges(characters) -> str:
    """A character class of the given characters as ranges."""
    codes = sorted(map(ord, characters))
    firsts = [c for c in codes if c - 1 not in set(codes)]
    lasts = [c for c in codes if c + 1 not in set(codes)]
    return "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in zip(firsts, lasts))


def fold_accents(text: Column) -> Column:
    """NFKD, then drop what is not ASCII. Pure ASCII rows are passed through;
    only rows holding an expanding character (ligatures, fractions) are mapped
    character by character."""
    source, target, expanding = _ascii_folds()
    pairs = F.create_map(*[F.lit(x) for pair in expanding.items() for x in pair])
    in_class = "[\\x{80}-\\x{10FFFF}&&[" + _ranges(expanding) + "]]"
    expanded = F.array_join(
        F.transform(F.split(text, ""), lambda c: F.coalesce(F.try_element_at(pairs, c), c)), ""
    )
    whole = F.when(text.rlike(in_class), expanded).otherwise(text)
    folded = F.regexp_replace(F.translate(whole, source, target), NON_ASCII, "")
    return F.when(text.rlike(NON_ASCII), folded).otherwise(text)


def strip_tags(text: Column) -> Column:
    """C3"""
    return F.regexp_replace(text, TAG, "")


def punctuation_to_space(text: Column) -> Column:
    """C4"""
    return F.regexp_replace(text, PUNCTUATION, " ")


def squeeze_whitespace(text: Column) -> Column:
    """C5"""
    return F.regexp_replace(text, WHITESPACE, " ")


def drop_digits(text: Column) -> Column:
    """C6"""
    return F.regexp_replace(text, DIGITS, "")


def normalise(text: Column) -> Column:
    """C1-C6 in order."""
    return drop_digits(
        squeeze_whitespace(punctuation_to_space(strip_tags(fold_accents(F.lower(text)))))
    )


_STOPPED = frozenset(STOP_WORDS)
_TAGS = re.compile(TAG)
_BLANKED = str.maketrans(string.punctuation, " " * len(string.punctuation), string.digits)


def _words(text: str) -> list[str]:
    """The words of ``normalise`` for a text in lower case. Blanks are not squeezed, as
    the words are split at any number of them."""
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode()
    return _TAGS.sub("", text).translate(_BLANKED).split()


@lru_cache(maxsize=1 << 18)
def _kept(word: str) -> str | None:
    return word if len(word) >= MIN_TOKEN and word not in _STOPPED else None


@lru_cache(maxsize=1 << 18)
def _stemmed(word: str) -> str | None:
    return _kept(word) and stem(word)


def _each_text(function, kind: T.DataType, stored: pa.DataType):
    """An Arrow function of a text, null for null."""

    @F.arrow_udf(kind)
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else function(t) for t in texts.to_pylist()], stored)

    return run


def clean_tokens(text: Column, stem: bool = True) -> Column:
    """C7-C9 on top of ``normalise``: short words and stop words go, then stemming."""
    last = _stemmed if stem else _kept
    kind, stored = T.ArrayType(T.StringType()), pa.list_(pa.string())
    return _each_text(lambda t: list(filter(None, map(last, _words(t)))), kind, stored)(F.lower(text))


def clean_text(text: Column, stem: bool = True) -> Column:
    """The whole chain in one pass over the text, words joined by single spaces."""
    last = _stemmed if stem else _kept
    joined = _each_text(lambda t: " ".join(filter(None, map(last, _words(t)))), T.StringType(), pa.string())
    return joined(F.lower(text))


def snippet(text: Column) -> Column:
    """C11"""
    return F.substring(text, 1, SNIPPET)


def first_half(text: Column) -> Column:
    """C12, first ``length div 2`` characters"""
    return F.substring(text, F.lit(1), F.floor(F.length(text) / 2).cast("int"))


def second_half(text: Column) -> Column:
    """C12, the remaining characters"""
    return F.substring(text, (F.floor(F.length(text) / 2) + 1).cast("int"), F.length(text))


def decode_utf8(content: Column) -> Column:
    """Bytes to text, invalid bytes dropped.

    Spark substitutes U+FFFD for invalid bytes. Real U+FFFD characters are put
    under an escape first, so that only the substitutes are removed.
    """
    mark, unknown = "\ue000", "\ufffd"

    def swap(value: Column, old: str, new: str) -> Column:
        return F.replace(value, F.lit(old), F.lit(new))

    raw = content.cast("string")
    escaped = swap(swap(raw, mark, mark + "a"), unknown, mark + "b")
    kept = swap(F.make_valid_utf8(escaped), unknown, "")
    repaired = swap(swap(kept, mark + "b", unknown), mark + "a", mark)
    return F.when(F.is_valid_utf8(raw), raw).otherwise(repaired)
