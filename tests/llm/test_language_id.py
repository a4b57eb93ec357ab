import zlib

import numpy as np

from quillstack.llm import language
from quillstack.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"


def test_grams_by_hand():
    points, owner = language.letter_runs(["Ab--c", None, "é 1"])
    assert [chr(p) for p in points] == list(" ab c ") + [" "] + list(" é ")
    assert owner.tolist() == [0] * 6 + [1] + [2] * 3
    keys, owner = language.grams(["Ab--c", None, "é 1"])
    assert np.bincount(owner, minlength=3).tolist() == [3 + 4 + 3, 0, 1 + 1]


def test_masks_and_false_positives():
    rng = np.random.default_rng(0)
    profiles = [rng.integers(0, 2**63, 500).astype(np.uint64) for _ in range(70)]
    f = language.Filters.build([f"l{k}" for k in range(70)], profiles)
    for k in (0, 63, 64, 69):
        assert all((f.masks(profiles[k])[k // 64] >> np.uint64(k % 64)) & np.uint64(1))
    other = rng.integers(0, 2**63, 200_000).astype(np.uint64)
    for k in (1, 65):
        seen = ((f.masks(other)[k // 64] >> np.uint64(k % 64)) & np.uint64(1)).mean()
        assert abs(seen - f.false_rate[k]) < 0.002


def test_held_out_accuracy(spark):
    found = QUERIES["op1_language_bitmask"](spark, FOLDER)
    assert found.columns[:4] == ["doc_id", "held_out", "lang_pred", "score"]
    docs = {r.doc_id: r for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    right = total = 0
    for r in found.collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1
        if r.held_out:
            total, right = total + 1, right + (r.lang_pred == docs[r.doc_id].lang)
    assert total > 300 and right / total > 0.95, right / total


def test_odd_rows(spark):
    rows = [(1, "the cat sat on the mat and that was that", "en", 1), (2, "der hund und die katze", "de", 1),
            (3, None, "en", 1), (4, "", "de", 1), (5, "123 !", None, 1), (6, "the hat", None, 1),
            (6, "the hat", None, 1), (None, "die katze " * 20_000, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    out = language.predict(docs, language.train(docs)).collect()
    assert len(out) == len(rows)
    got = {r.doc_id: r.lang_pred for r in out}
    assert (got[3], got[4], got[5], got[6], got[None]) == ("und", "und", "und", "en", "de")
    empty = language.train(docs.limit(0))
    assert {r.lang_pred for r in language.predict(docs, empty).collect()} == {"und"}
    assert language.predict(docs.limit(0), empty).count() == 0


def by_characters(text, profiles, bits_per_gram=16, hashes=3):
    """Prediction of one text with a set of bit positions per language, a gram at a time."""
    wide = 2**64 - 1

    def mixed(x):
        for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
            x = ((x ^ x >> 33) * factor) & wide
        return x ^ x >> 33

    size = 1
    while size < max(map(len, profiles.values())) * bits_per_gram:
        size *= 2

    def places(key):
        return [(key + k * (key >> 32 | 1)) & wide & (size - 1) for k in range(hashes)]

    line = " "
    for ch in (text or "").lower() + " ":
        ch = ch if ch.isalpha() else " "
        line += "" if ch == " " and line[-1] == " " else ch
    keys = []
    for n in (1, 3, 4):
        for s in range(len(line) - n + 1):
            if n > 1 or line[s] != " ":
                key = n
                for ch in line[s:s + n]:
                    key = (key * 0x1FFFFF + ord(ch)) & wide
                keys.append(mixed(key))
    counts = {}
    for name, profile in profiles.items():
        bits = {p for key in profile for p in places(key)}
        rate = (len(bits) / size) ** hashes
        counts[name] = (sum(all(p in bits for p in places(k)) for k in keys) - len(keys) * rate) / (1 - rate)
    if not keys:
        return "und", 0.0
    best = max(sorted(counts), key=counts.__getitem__)
    mass = sum(max(c, 0.0) for c in counts.values())
    return best, max(counts[best], 0.0) / mass if mass > 0 else 0.0


def test_predictions_by_characters(spark, monkeypatch):
    """The whole query on a whole table, with the learned profiles in plain sets."""
    seen = {}
    plain = language.Filters.build.__func__

    def build(cls, languages, profiles, *args, **named):
        seen.update(zip(languages, [[int(k) for k in p] for p in profiles]))
        return plain(cls, languages, profiles, *args, **named)

    monkeypatch.setattr(language.Filters, "build", classmethod(build))
    folder = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in QUERIES["op1_language_bitmask"](spark, folder).collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    assert len(got) == len(docs) > 100 and len(seen) > 2
    for r in docs:
        name, score = by_characters(r.text, seen)
        assert got[r.doc_id].lang_pred == name and abs(got[r.doc_id].score - score) < 1e-9, r.doc_id
