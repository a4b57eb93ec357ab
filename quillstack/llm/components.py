"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstack.session import materialise


def components(links: DataFrame) -> DataFrame:
    """``(node, component)`` for every end of the links ``(a, b)``: the smallest node
    that can be reached. Each round takes the smallest label among the neighbours and
    then the label of that label, so labels travel ever further. A node of very many
    links is only ever aggregated, and its join can be split. Links with a null end or
    from a node to itself say nothing; without links the result is empty."""
    both = links.select("a", "b").union(links.select("b", "a")).filter("a <> b").distinct()
    edges = materialise(both.toDF("node", "next"), "links")
    labels = materialise(
        edges.groupBy("node").agg(F.min("next").alias("m"))
        .select("node", F.least("node", "m").alias("component")), "labels")
    while True:
        of_next = labels.select(F.col("node").alias("next"), F.col("component").alias("c"))
        near = edges.join(of_next, "next").groupBy("node").agg(F.min("c").alias("c"))
        new = materialise(
            labels.join(near, "node").select("node", "component", F.least("component", "c").alias("new")), "labels")
        jump = new.select(F.col("node").alias("new"), F.col("new").alias("further"))
        after = materialise(
            new.join(jump, "new").select("node", "component", F.least("new", "further").alias("new")), "labels")
        changed = after.filter("component <> new").limit(1).count()
        labels = after.select("node", F.col("new").alias("component"))
        if not changed:
            return labels
