import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from quillstack.functions.text import clean_text
from quillstack.operators import classify, topics
from quillstack.operators.search_index import CELL, SearchIndex
from quillstack.operators.similar import SimilarIndex
from quillstack.plans.enrich import Models, Options, corpus_matrix, enrich
from quillstack.session import new_path, read_table
from quillstack.streaming.incremental import ArrivalJob, enrich_arrivals, latest_enriched, take_arrivals


def test_batch_and_incremental_agree(spark):
    docs = read_table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text", "lang")
    cleaned = docs.withColumn("clean_text", clean_text(F.col("text"))).cache()
    names = classify.class_numbers(cleaned, "lang")
    coded = cleaned.join(names.select(F.col("code").alias("label"), F.col("name").alias("lang")), "lang")
    model = topics.train_topics(cleaned, "nmf", components=4, rounds=3)
    models = Models(
        classify.train(coded, "label"), names, {"nmf": model}, {"nmf": SimilarIndex.build(corpus_matrix(cleaned, model))},
        coded.select("doc_id", "text", "label"),
    )
    options = Options(kp_algos=("textrank", "yake"), show_topics=True, sim_count=2)
    source = docs.select("doc_id", "text")
    batch = enrich(source, models, options)
    assert batch.columns == [
        "doc_id", "summary", "keyphrases_textrank", "entities", "pred_label_num", "pred_label_str",
        "keyphrases_yake", "doc_topics_nmf", "sim_nmf", "topics_nmf",
    ]
    arrivals, target, progress = (new_path(spark, n) for n in ("arrivals", "enriched", "progress"))
    source.repartition(3).write.parquet(arrivals)
    for _ in range(2):
        enrich_arrivals(
            spark, arrivals, source.schema, lambda b: enrich(b, models, options), target, progress, 2
        ).awaitTermination()
    hit = batch.filter("size(sim_nmf) = 2").first()["sim_nmf"][0]
    assert hit["doc"]["text"] and hit["doc"]["actual_label_str"] and len(hit["doc"]["doc_topics"]) == 3
    latest = latest_enriched(spark, target)
    assert sorted(map(str, latest.select(batch.columns).collect())) == sorted(map(str, batch.collect()))
    off = enrich(source, Models(), Options(classify=False, entities=False, summary=False, kp_algos=()))
    assert off.columns == ["doc_id"] and off.count() == docs.count()


def state(spark, job):
    """Every output as plain rows."""
    matrix = job.matrix(spark, "nmf")
    return (
        sorted(map(str, job.enriched(spark).collect())),
        sorted(map(tuple, job.search(spark).docs.drop(CELL).collect()), key=str),
        sorted(map(tuple, job.search(spark).words.collect())),
        sorted((r["doc_id"], tuple(round(x, 9) for x in r["vec"])) for r in matrix.vectors().collect()),
    )


@pytest.mark.parametrize("broken", ["search", "matrix"])
def test_a_failed_batch_is_repeated(spark, monkeypatch, broken):
    """A batch that fails between its outputs and is taken again leaves what a smooth run
    leaves."""
    rows = [(i, f"The {w} court of {w} held that the {w} case {i % 5} was decided. It was {w}.")
            for i, w in enumerate(["tax", "labor", "union", "tribal", "patent"] * 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    cleaned = docs.withColumn("clean_text", clean_text(F.col("text"))).cache()
    model = topics.train_topics(cleaned, "nmf", components=3, rounds=3)
    names = spark.createDataFrame([(0, "x")], "code int, name string")
    models = Models(None, names, {"nmf": model})
    options = Options(kp_algos=(), entities=False, sim_count=2)
    arrivals = new_path(spark, "arrivals")
    docs.repartition(4, "doc_id").write.parquet(arrivals)
    done = {}
    for way in ("smooth", "broken"):
        path = new_path(spark, way)
        job = ArrivalJob.start(spark, path, docs.schema, models, options)
        if way == "broken":
            kind = SearchIndex if broken == "search" else SimilarIndex
            plain, calls = kind.add, []

            def add(self, *args, **named):
                if named.get("batch") == "arrivals-1" and not calls:
                    calls.append(1)
                    raise RuntimeError("lost")
                return plain(self, *args, **named)

            with monkeypatch.context() as m:
                m.setattr(kind, "add", add)
                with pytest.raises(StreamingQueryException):
                    take_arrivals(spark, arrivals, docs.schema, job, f"{path}/progress", 2).awaitTermination()
        take_arrivals(spark, arrivals, docs.schema, job, f"{path}/progress", 2).awaitTermination()
        done[way] = state(spark, job)
        assert len(done[way][0]) == len(done[way][1]) == len(done[way][3]) == 40
    assert done["smooth"] == done["broken"]
    job.take(spark.read.schema(docs.schema).parquet(arrivals), 1)
    assert state(spark, job) == done["smooth"]
