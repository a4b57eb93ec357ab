import datetime as dt

from pyspark.sql import functions as F

from quillstack.session import new_path
from quillstack.sources import corpus, files, search_log, tables

T0 = dt.datetime(2024, 1, 1)
VERSIONS = "key string, version_id string, last_modified timestamp, size long, deleted boolean, content binary"


def versions(spark):
    rows = [
        ("bob/a.txt", "v1", T0, 1, False, bytearray(b"1")),
        ("bob/a.txt", "v2", T0 + dt.timedelta(1), 1, False, bytearray(b"2")),
        ("bob/b.txt", "v1", T0, 1, False, bytearray(b"x\xff")),
        ("bob/b.txt", "v2", T0 + dt.timedelta(2), 0, True, None),
        ("bobby/a.txt", "v1", T0, 1, False, bytearray(b"y")),
    ]
    return spark.createDataFrame(rows, VERSIONS)


def test_many_text_files_share_folders(spark, tmp_path):
    rows = [(f"doc={i:06d}", f"text {i}\u00e9\n{i}") for i in range(2_400)] + [("doc=900000", None), ("doc=900001", "")]
    rows += [("doc=900002", "a"), ("doc=900002", "a")]
    docs = spark.createDataFrame(rows, "name string, text string").repartition(2, "name")
    path = str(tmp_path / "texts")
    corpus.write_text_files(docs, path)
    got = corpus.read_text_files(spark, path, r"/doc=([0-9]+)-", recursive=True)
    want = {i: f"text {i}\u00e9\n{i}\n" for i in range(2_400)} | {900000: "\n", 900001: "\n", 900002: "a\na\n"}
    found = got.collect()
    assert len(found) == len(want) and {r["doc_id"]: r["text"] for r in found} == want
    assert len(list((tmp_path / "texts").iterdir())) <= 4


def test_text_files(spark, tmp_path):
    for i, t in enumerate(["one\ntwo", "", "drei ü"]):
        (tmp_path / f"{i:06d}.txt").write_text(t, encoding="utf-8")
    (tmp_path / "note.md").write_text("x")
    rows = corpus.read_text_files(spark, str(tmp_path)).orderBy("doc_id").collect()
    assert [tuple(r) for r in rows if r["text"]] == [(0, "one\ntwo"), (2, "drei ü")]
    loaded = corpus.read_stored_files(spark, str(tmp_path)).collect()
    assert sorted(r["text"] for r in loaded if r["size"]) == ["drei ü", "one\ntwo", "x"]
    listed = corpus.list_stored_files(spark, str(tmp_path)).filter("size > 0")
    assert listed.count() == 3


def test_metadata_round_trip(spark):
    rows = [(1, 'a|b "q" \n c', None), (2, "", "x"), (3, None, " y ")]
    df = spark.createDataFrame(rows, "doc_id long, case_name string, issue string")
    path = new_path(spark, "meta")
    corpus.write_metadata(df, path)
    back = corpus.read_metadata(spark, path, df.schema).orderBy("doc_id").collect()
    assert [tuple(r) for r in back] == rows


def test_listing_pages(spark):
    df = versions(spark)
    prefix = files.owner_prefix("bob")
    df = df.dropDuplicates(["key"])
    first, token = files.list_page(df, prefix, 1)
    assert [r["key"] for r in first.collect()] == ["bob/a.txt"] and token == "bob/a.txt"
    second, token = files.list_page(df, prefix, 5, token)
    assert [r["key"] for r in second.collect()] == ["bob/b.txt"] and token is None
    assert files.list_page(df, prefix, 5, token)[0].count() == 0


def test_page_exactly_full(spark):
    df = versions(spark).dropDuplicates(["key"])
    page, token = files.list_page(df, files.owner_prefix("bob"), 2)
    assert page.count() == 2 and token is None


def test_turn_thousand(spark):
    rows = [("k", f"v{n:03d}", T0 + dt.timedelta(minutes=n), 1, False, bytearray(b"x")) for n in (998, 999, 1000)]
    df = spark.createDataFrame(rows, VERSIONS)
    assert files.latest_versions(df).first()["version_id"] == "v1000"
    assert [r["version_id"] for r in files.list_versions(df).filter("is_latest").collect()] == ["v1000"]


def test_versions(spark):
    df = versions(spark)
    listed = {(r["key"], r["version_id"]): r["is_latest"] for r in files.list_versions(df).collect()}
    assert listed == {
        ("bob/a.txt", "v1"): False, ("bob/a.txt", "v2"): True,
        ("bob/b.txt", "v1"): False, ("bobby/a.txt", "v1"): True,
    }
    asked = spark.createDataFrame(
        [("bob/a.txt", None), ("bob/b.txt", None), ("bob/b.txt", "v1"), ("nobody", None)],
        "key string, version_id string",
    )
    got = {(r["key"], r["version_id"]): (r["status"], r["text"]) for r in files.read_files(df, asked).collect()}
    assert got == {
        ("bob/a.txt", "v2"): ("ok", "2"), ("bob/b.txt", None): ("missing", None),
        ("bob/b.txt", "v1"): ("ok", "x"), ("nobody", None): ("missing", None),
    }
    left = files.delete_files(
        df,
        spark.createDataFrame([("bob/a.txt", "v2"), ("bobby/a.txt", None)], "key string, version_id string"),
        F.lit(T0 + dt.timedelta(9)),
    )
    latest = {r["key"]: (r["version_id"], r["deleted"]) for r in files.latest_versions(left).collect()}
    assert latest["bob/a.txt"] == ("v1", False) and latest["bobby/a.txt"][1]


def test_tables(spark):
    table = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    updates = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "doc_id long, text string, seq int")
    merged = tables.upsert(table, updates, "doc_id", "seq").orderBy("doc_id").collect()
    assert [tuple(r) for r in merged] == [(1, "a"), (2, "d"), (3, "e")]
    new = spark.createDataFrame([(2, "x"), (4, "y"), (5, "z"), (5, "z")], "doc_id long, text string")
    stored, rejected = tables.insert_only(table, new, "doc_id")
    assert sorted(r["doc_id"] for r in stored.collect()) == [1, 2, 4]
    assert sorted(r["doc_id"] for r in rejected.collect()) == [2, 5, 5]
    path = new_path(spark, "corpus")
    assert tables.set_up_table(table, path).count() == 2
    assert tables.set_up_table(table.limit(1), path).count() == 2
    assert tables.set_up_table(table.limit(1), path, "overwrite").count() == 1


def test_search_log(spark):
    source, log, progress = (new_path(spark, n) for n in ("searches", "log", "progress"))
    rows = [(T0 + dt.timedelta(hours=h), f"q{h}") for h in (2, 1)]
    spark.createDataFrame(rows, search_log.LOG_SCHEMA).write.parquet(source)
    for _ in range(2):
        stream = spark.readStream.schema(search_log.LOG_SCHEMA).parquet(source)
        search_log.stream_searches(stream, log, progress).awaitTermination()
    texts = search_log.search_texts(search_log.read_searches(spark, log)).collect()
    assert [r["search_text"] for r in texts] == ["q1", "q2"]
