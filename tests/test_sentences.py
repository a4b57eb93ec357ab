import time

from quillstack.operators import sentences as sent


def test_many_sentences_of_one_text(spark):
    """60,000 sentences: cutting each from the whole text did not end within 90 seconds."""
    text = "Ab é, e.g. cd. " * 60_000
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.time()
    rows = sent.sentences(df, "doc_id").collect()
    assert time.time() - began < 30
    assert len(rows) == 60_000 and all(text[r["start_char"]:r["end_char"]] == r["text"] for r in rows)


def test_texts_with_the_signs_of_cuts(spark):
    texts = ["One\x01 two. Three \x02e.g. four \x01 \n five.\x02", "No e.g. sign. Dr. é \n\n end  ", "\x02", " \x01 ", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = sent.with_sentences(df).orderBy("doc_id").collect()
    assert rows[5]["sentences"] is None
    for text, r in zip(texts[:5], rows):
        assert all(text[s["start_char"]:s["end_char"]] == s["text"] for s in r["sentences"])
    assert [len(r["sentences"]) for r in rows[:5]] == [3, 3, 0, 0, 0]
    assert rows[1]["sentences"][0]["text"] == "No e.g. sign."
