import random
import unicodedata

from pyspark.sql import functions as F

from quillstack.functions import text as tx
from quillstack.functions.stem import stem
from quillstack.functions.tokens import model_tokens, search_tokens, word_ngrams

# Pairs worked out from the published rules.
STEMS = {
    "caresses": "caress", "ponies": "poni", "caress": "caress", "cats": "cat", "feed": "feed",
    "agreed": "agre", "plastered": "plaster", "bled": "bled", "motoring": "motor", "sing": "sing",
    "conflated": "conflat", "troubled": "troubl", "sized": "size", "hopping": "hop",
    "tanned": "tan", "falling": "fall", "hissing": "hiss", "fizzed": "fizz", "failing": "fail",
    "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat",
    "conditional": "condit", "rational": "ration", "digitizer": "digit", "operator": "oper",
    "feudalism": "feudal", "decisiveness": "decis", "hopefulness": "hope", "formaliti": "formal",
    "sensitiviti": "sensit", "triplicate": "triplic", "formative": "form", "formalize": "formal",
    "electrical": "electr", "hopeful": "hope", "goodness": "good", "revival": "reviv",
    "allowance": "allow", "inference": "infer", "airliner": "airlin", "adjustable": "adjust",
    "defensible": "defens", "irritant": "irrit", "replacement": "replac", "adjustment": "adjust",
    "dependent": "depend", "adoption": "adopt", "communism": "commun", "activate": "activ",
    "homologous": "homolog", "effective": "effect", "probate": "probat", "rate": "rate",
    "cease": "ceas", "controll": "control", "roll": "roll", "dying": "die", "texts": "text",
    "enjoy": "enjoy", "flies": "fli", "dies": "die", "died": "die",
}


def test_stems():
    assert {w: stem(w) for w in STEMS} == STEMS


def cleaned(text):
    """The chain restated in plain Python."""
    t = unicodedata.normalize("NFKD", text.lower()).encode("ascii", "ignore").decode()
    import re

    t = re.sub("<[^>]+>", "", t)
    t = re.sub(r"[!-/:-@\[-`{-~]+", " ", t)
    t = re.sub("[0-9]+", "", re.sub(r"\s+", " ", t))
    return " ".join(stem(w) for w in t.split() if len(w) >= 3 and w not in tx.STOP_WORDS)


def test_clean_text(spark):
    raw = [
        "<i>Höhe</i> und a<br>b num34bers_here — ﬁnal ½ ß straße",
        "it's, the FOOTNOTE\x1ctexting\ttexted texter 007!!",
        "ÀÉÎ ①② ㎏ Ｆｕｌｌ ｗｉｄｔｈ ℡   x² 漢字",
        "",
        "plain ascii words only",
    ]
    df = spark.createDataFrame(list(enumerate(raw)), "id int, t string")
    got = [r["c"] for r in df.select("id", tx.clean_text(F.col("t")).alias("c")).orderBy("id").collect()]
    assert got == [cleaned(t) for t in raw]


def test_clean_null_stays_null(spark):
    df = spark.createDataFrame([(None,), ("cats",)], "t string")
    assert [r[0] for r in df.select(tx.clean_tokens(F.col("t"))).collect()] == [None, ["cat"]]


def test_decode_drops_invalid_bytes(spark):
    rng = random.Random(3)
    pool = [b"a", b"\xc3\xa9", b"\xef\xbf\xbd", b"\xee\x80\x80", b"\xff", b"\xe2\x82", b"\xf0\x9f\x98\x80", b"\x80", b"b"]
    rows = [bytearray(b"".join(rng.choices(pool, k=8))) for _ in range(300)]
    df = spark.createDataFrame([(i, b) for i, b in enumerate(rows)], "id int, b binary")
    got = df.select("id", tx.decode_utf8(F.col("b")).alias("t")).orderBy("id").collect()
    assert [r["t"] for r in got] == [bytes(b).decode("utf-8", "ignore") for b in rows]


def test_halves_join_to_the_text(spark):
    df = spark.createDataFrame([("",), ("a",), ("abc",), ("abcd",)], "t string")
    rows = df.select("t", tx.first_half(F.col("t")).alias("a"), tx.second_half(F.col("t")).alias("b")).collect()
    assert all(r["a"] + r["b"] == r["t"] and len(r["a"]) == len(r["t"]) // 2 for r in rows)


def test_tokens_and_ngrams(spark):
    df = spark.createDataFrame([("The U.S. don't a b_c 1,000",)], "t string")
    row = df.select(model_tokens(F.col("t")).alias("m"), search_tokens(F.col("t")).alias("s")).first()
    assert row["m"] == ["the", "don", "b_c", "000"]
    assert row["s"] == ["the", "u.s", "don't", "a", "b_c", "1", "000"]
    grams = spark.createDataFrame([(["a", "b", "c"],), (["a"],), ([],)], "w array<string>")
    got = [r[0] for r in grams.select(word_ngrams("w")).collect()]
    assert got == [["a", "b", "c", "a b", "b c", "a b c"], ["a"], []]


def test_long_runs_do_not_overflow(spark):
    df = spark.createDataFrame([("a." * 30_000,)], "t string")
    assert df.select(F.size(search_tokens(F.col("t")))).first()[0] == 1


def test_cleaning_is_one_pass(spark):
    df = spark.createDataFrame([("Höhe",)], "t string")
    plan = df.select(tx.clean_text(F.col("t")), tx.clean_tokens(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan and "lambdafunction" not in plan


def test_tokens_without_stems(spark):
    df = spark.createDataFrame([("The naïve cats<br> r4unning\x1cＸＹＺ",), (None,), ("<>",)], "t string")
    rows = df.select(tx.clean_tokens(F.col("t"), stem=False), tx.clean_text(F.col("t"), stem=False)).collect()
    assert [tuple(r) for r in rows] == [(["naive", "cats", "running", "xyz"], "naive cats running xyz"), (None, None), ([], "")]
