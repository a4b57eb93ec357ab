"""H1, H2: sentences with character offsets, and the token stream of a document.

Everything here works inside a row: a document is never spread over tasks. Arrays
are exploded in the outer form throughout, because for the plain form the optimiser
adds a size test that would compute the whole array a second time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstack.functions.text import STOP_WORDS
from quillstack.functions.tokens import SEARCH_WORD, running_starts

# Abbreviations whose dot does not end a sentence.
ABBREVIATIONS = (
    "Mr", "Mrs", "Ms", "Dr", "Prof", "St", "Jr", "Sr", "No", "Nos", "vs", "v", "Inc", "Corp",
    "Co", "Ltd", "e.g", "i.e", "etc", "cf", "Fig", "Sec", "Art", "Cir", "Ct", "Cl", "Ann", "Stat",
)
_SHORT = "|".join(a.replace(".", r"\.") for a in ABBREVIATIONS)
ABBREVIATION = rf"(^|[^\p{{L}}\p{{N}}])({_SHORT}|[A-Z](?:\.[A-Z]){{0,5}})\."
SENTENCE_END = r"([.!?]+[\"')\]]*[ \t\r\n]+|\n[ \t\r\n]*)"
BREAK, HIDDEN_DOT = "\x01", "\x02"
BLANKS = " \t\r\n"

TOKEN = SEARCH_WORD + r"|[^\p{L}\p{N}_ \t\r\n]"
CANDIDATE = r"^[\p{L}]{3,}$"


def _parts(text: Column) -> Column:
    """The text cut behind each sentence end; the pieces join to the whole length."""
    plain = F.translate(text, BREAK + HIDDEN_DOT, "  ")
    hidden = F.regexp_replace(plain, ABBREVIATION, "$1$2" + HIDDEN_DOT)
    return F.split(F.regexp_replace(hidden, SENTENCE_END, "$1" + BREAK), BREAK)


def with_sentences(docs: DataFrame, text: str = "text", out: str = "sentences") -> DataFrame:
    """H1: adds ARRAY<STRUCT<text, start_char, end_char>>; blank stretches are left out.

    The text of a sentence is its part with the hidden dots put back. Only where the
    document holds the two signs itself is it cut from the document, which counts the
    characters of the whole document for each sentence."""

    def part(p: Column) -> Column:
        return F.struct(F.length(p).alias("size"), F.rtrim(p, F.lit(BLANKS)).alias("kept"))

    cut = docs.withColumn("__parts", F.transform(_parts(F.col(text)), part)).withColumn(
        "__signs", F.contains(F.col(text), F.lit(BREAK)) | F.contains(F.col(text), F.lit(HIDDEN_DOT))
    )
    placed = cut.withColumn("__starts", running_starts(F.transform("__parts", lambda p: p["size"])))

    def span(p: Column, s: Column) -> Column:
        length = F.length(p["kept"])
        own = F.when(F.col("__signs"), F.substring(F.col(text), s + 1, length)).otherwise(
            F.translate(p["kept"], HIDDEN_DOT, ".")
        )
        return F.struct(own.alias("text"), s.alias("start_char"), (s + length).alias("end_char"))

    kept = F.filter(F.zip_with("__parts", "__starts", span), lambda s: s["end_char"] > s["start_char"])
    return placed.withColumn(out, kept).drop("__parts", "__starts", "__signs")


def sentences(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """H1: (key, sentence, text, start_char, end_char)"""
    split = with_sentences(docs.select(key, text), text, "__s")
    return (
        split.select(key, F.posexplode_outer("__s").alias("sentence", "s"))
        .filter(F.col("s").isNotNull())
        .select(key, "sentence", "s.*")
    )


def sentence_tokens(sentence: Column) -> Column:
    """Words and single punctuation marks of a sentence."""
    return F.regexp_extract_all(sentence, F.lit(TOKEN), 0)


def is_candidate(word: Column) -> Column:
    """H2: at least three letters, nothing else, and no stop word. ``word`` is in lower case."""
    return word.rlike(CANDIDATE) & ~word.isin(STOP_WORDS)


def with_token_stream(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``sentences`` and the aligned arrays ``words`` (candidates in lower
    case, null elsewhere) and ``word_sentence`` (sentence numbers), and ``word_lines``, the
    same in one string: a line for each sentence, words with blanks between them, and
    nothing where the arrays have null. Candidates hold neither blanks nor line ends."""

    def line(sentence: Column) -> Column:
        low = F.transform(sentence_tokens(sentence["text"]), F.lower)
        return F.array_join(F.transform(low, lambda t: F.when(is_candidate(t), t).otherwise("")), " ")

    split = with_sentences(docs, text).withColumn("word_lines", F.array_join(F.transform("sentences", line), "\n"))
    stream = F.flatten(
        F.transform(
            "sentences",
            lambda s, i: F.transform(
                sentence_tokens(s["text"]),
                lambda t: F.struct(F.lower(t).alias("word"), i.alias("sentence")),
            ),
        )
    )
    streamed = split.withColumn("__stream", stream)
    return streamed.withColumns(
        {
            "words": F.transform("__stream", lambda t: F.when(is_candidate(t["word"]), t["word"])),
            "word_sentence": F.transform("__stream", lambda t: t["sentence"]),
        }
    ).drop("__stream")
