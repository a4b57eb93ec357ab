"""Token counts of a word-end BPE vocabulary by the whole-token shortcut.

Before any text is read, every vocabulary string is put through the tokenizer: those
that come back as their own single id are proven to count one wherever the splitter
yields them. A text is normalised and split; matches among the proven strings are
counted directly, the merges run only for the others.
"""

from __future__ import annotations

import functools
import json
import os
import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstack.llm.byte_bpe import byte_characters
from quillstack.llm.common import rows, shared_bytes

CACHE_LIMIT = 300_000
CACHE_LENGTH = 64
#: Characters up to U+017F, where composing changes nothing and lower case goes by
#: single characters; the classes below are exact for them.
PLAIN = re.compile("[\x00-ſ]*")


class Counter(dict):
    """Tokens of each string that the splitter yields; computed when first asked."""

    def __init__(self, definition: str):
        from tokenizers import Tokenizer

        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        whole = Tokenizer.from_str(definition)
        parts = json.loads(definition)
        added = [t["content"] for t in parts["added_tokens"]]
        if any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"]
               for t in parts["added_tokens"]):
            raise ValueError("special strings must match as they stand")
        self.special = re.compile("|".join(map(re.escape, added)) or r"(?!)")
        steps = parts["pre_tokenizer"]["pretokenizers"]
        kinds = [s["type"] for s in steps], [s["type"] for s in parts["normalizer"]["normalizers"]]
        if kinds != (["Split", "ByteLevel"], ["NFC", "Replace", "Lowercase"]):
            raise ValueError(f"unknown steps {kinds}")
        self.normalise = whole.normalizer.normalize_str
        self.split_any = _splitter(steps[0]["pattern"]["Regex"])
        self.split_plain = re.compile(_plain_pattern(steps[0]["pattern"]["Regex"])).findall
        self.model = whole.model
        self.shown = {b: c for b, c in enumerate(byte_characters())}
        self.proven = self._prove(whole, set(added))
        self.update(self.proven)

    def _prove(self, whole, added: set[str]) -> dict[str, int]:
        """Vocabulary strings that stand alone as one token: encoding the string
        gives its own id and nothing else."""
        back = {c: b for b, c in self.shown.items()}
        found = {}
        vocabulary = whole.get_vocab()
        for piece, number in vocabulary.items():
            if piece in added or not piece.endswith("</w>"):
                continue
            try:
                text = bytes(back[c] for c in piece[:-4]).decode()
            except (KeyError, UnicodeDecodeError):
                continue
            found[text] = number
        texts = sorted(found)
        encoded = whole.encode_batch(texts, add_special_tokens=False)
        return {t: 1 for t, e in zip(texts, encoded) if e.ids == [found[t]]}

    def __missing__(self, match: str) -> int:
        plain = match.isascii() and match.isprintable()
        mapped = match if plain else match.encode().decode("latin-1").translate(self.shown)
        count = len(self.model.tokenize(mapped))
        if len(match) <= CACHE_LENGTH:
            if len(self) >= len(self.proven) + CACHE_LIMIT:
                self.clear()
                self.update(self.proven)
            self[match] = count
        return count

    def matches(self, segment: str) -> list[str]:
        if PLAIN.fullmatch(segment):
            return self.split_plain(segment.lower())
        return self.split_any(self.normalise(segment))

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        total = 0
        segments = self.special.split(text)
        total += len(segments) - 1  # each special string is one token
        for segment in segments:
            total += sum(map(self.__getitem__, self.matches(segment)))
        return total


def _splitter(pattern: str):
    """The library's own splitter, for texts beyond the plain characters."""
    from tokenizers import Regex, pre_tokenizers

    split = pre_tokenizers.Split(Regex(pattern), "removed", invert=True).pre_tokenize_str
    return lambda text: [match for match, _ in split(text)]


def _plain_pattern(pattern: str) -> str:
    """The same pattern with its character classes written out up to U+017F."""
    import unicodedata

    def cls(test):
        return "".join(re.escape(chr(c)) for c in range(0x180) if test(chr(c)))

    letters = cls(lambda c: unicodedata.category(c)[0] == "L")
    numbers = cls(lambda c: unicodedata.category(c)[0] == "N")
    spaces = re.escape(" \t\n\v\f\r\x85\xa0")
    return (pattern.replace(r"[\p{L}]", f"[{letters}]").replace(r"[\p{N}]", f"[{numbers}]")
            .replace(r"\s", spaces).replace(r"\p{L}", letters).replace(r"\p{N}", numbers))


@functools.lru_cache(maxsize=2)
def counter(definition: bytes) -> Counter:
    return Counter(definition.decode())


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 2048,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_bytes, n_tokens, over_limit)`` of every whole text; null and empty
    texts count 0. Special strings inside a text count one token each, as the library
    does by default. Repeated rows stay repeated, other columns are not looked at."""
    shared = shared_bytes(docs.sparkSession, tokenizer_path)

    def run(batches):
        count = counter(shared.value).count
        for part in rows(batches, "t"):
            counts = [count(t) for t in part.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column("i"), pc.binary_length(part.column("t")).cast(pa.int64()).fill_null(0),
                 pa.array(counts, pa.int64())], [id_col, "n_bytes", "n_tokens"]
            )

    picked = docs.select(docs[id_col].alias("i"), docs[text_col].alias("t"))
    kind = picked.schema["i"].dataType.simpleString()
    out = picked.mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
