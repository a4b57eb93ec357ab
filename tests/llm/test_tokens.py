"""Byte-level BPE and token counts against the libraries themselves."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillstack.llm import byte_bpe, token_counts

RANKS, WORDS = P.path("byte_bpe_50k.tiktoken"), P.path("word_bpe_49k.json")
TEXTS = [
    None, "", " ", "\n\n  x", "it's I'll 'S 's", "naïve Größe ÉCOLE", "a" * 70_000, "ab " * 9000,
    "日本語のテキスト。", "🙂👍🏽 emoji", "İstanbul ΣΑΣ ﬁ", "é Å", "\x1c\x1d\x85\xa0x", "١٢٣ ½ 12345",
    "<|endoftext|> a<|startoftext|>b", "<|endoftext", "</w> x</w>", "tab\tnew\r\nline", "#$%&|<>",
    "the the the", "\x00\x01", "Ǆ ẞ K", "ÀÉÎ ŸŁ",
]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    ranges = [(0, 0x180), (0x180, 0x2FF0), (0x3000, 0xD7FF), (0xE000, 0x1FFFF)]
    made = ["".join(chr(rng.randint(*rng.choice(ranges[: 1 + k % 4]))) for _ in range(60)) for k in range(400)]
    sweep = [f"a{chr(c)}1 {chr(c)}{chr(c)}b" for c in (*range(0xD800), *range(0xE000, 0x11000))]
    return TEXTS + made + sweep


def test_encode_equals_library(texts):
    data = open(RANKS, "rb").read()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    found = byte_bpe.Encoder(data, P.PATTERN).encode(texts)
    for text, ids in zip(texts, found):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text or ""), repr(text)[:80]


def test_every_token_round_trip():
    data = open(RANKS, "rb").read()
    encoder = byte_bpe.Encoder(data, P.PATTERN)
    for token, rank in byte_bpe.read_ranks(data).items():
        mapped = encoder.map(token)
        assert mapped in encoder.direct or encoder.model.encode(mapped) == [rank]


def test_count_equals_library(texts):
    library = Tokenizer.from_file(WORDS)
    counter = token_counts.Counter(open(WORDS).read())
    for text in texts:
        expected = len(library.encode(text or "", add_special_tokens=False).ids)
        assert counter.count(text) == expected, repr(text)[:80]
    assert len(counter.proven) > 20_000


def test_cache_bound_changes_nothing(monkeypatch):
    monkeypatch.setattr(byte_bpe, "CACHE_LIMIT", 3)
    monkeypatch.setattr(token_counts, "CACHE_LIMIT", 3)
    words = ["qzx vbn wrtp lkjh mnbv zzyx", "vbn qzx qqqq wwww eeee"]
    data = open(RANKS, "rb").read()
    a = byte_bpe.Encoder(data, P.PATTERN)
    monkeypatch.undo()
    assert [a.encode([w]) for w in words] == [byte_bpe.Encoder(data, P.PATTERN).encode([w]) for w in words]


def test_frames(spark):
    rows = [(i, t, "x", 1) for i, t in enumerate(TEXTS)] + [(5, "again", "x", 1), (None, "no id", "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens int")
    out = byte_bpe.decode(byte_bpe.encode(docs, RANKS, P.PATTERN), RANKS).collect()
    assert len(out) == len(rows)
    want = sorted((str(i), (t or "").encode()) for i, t, *_ in rows)
    assert sorted((str(r.doc_id), bytes(r.decoded)) for r in out) == want
    counts = token_counts.count_tokens(docs, WORDS, limit=10).collect()
    assert {r.n_bytes for r in counts if r.doc_id == 0} == {0}
    assert all(r.over_limit == (r.n_tokens > 10) for r in counts) and len(counts) == len(rows)
    empty = docs.limit(0)
    assert byte_bpe.decode(byte_bpe.encode(empty, RANKS, P.PATTERN), RANKS).count() == 0
    assert token_counts.count_tokens(empty, WORDS).count() == 0


def test_queries(spark):
    from quillstack.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    texts = dict(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect())
    library = Tokenizer.from_file(WORDS)
    for r in QUERIES["op5_byte_bpe"](spark, folder).collect():
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    counts = QUERIES["op7_whole_token_counts"](spark, folder).collect()
    assert len(counts) == len(texts)
    for r in counts:
        assert r.n_tokens == len(library.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert r.n_bytes == len(texts[r.doc_id].encode())
