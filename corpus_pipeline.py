"""The corpus pipeline: stages of the operators in ``quillstack.llm``."""

from __future__ import annotations

from quillstack.llm import queries as q
from quillstack.session import new_path, read_table, ship_package

STAGES = [
    ("toxicity", q.toxicity_stage),
    ("line_dedup", q.line_stage),
    ("jaccard_join", q.near_duplicate_stage),
    ("mixing", q.mixing_stage),
    ("byte_bpe", q.encode_stage),
]

#: The toxicity stage is a trained model, which SQL cannot state.
ORACLE_SQL = None


def run(spark, sf_dir):
    """Applies the stages to ``documents``, each stored before the next reads it: toxic
    documents go, repeated runs of lines are deleted, one document of each group of
    similar ones stays, the rest is sampled to the target mix and encoded."""
    ship_package(spark)
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = new_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
