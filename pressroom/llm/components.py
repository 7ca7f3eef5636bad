"""Connected components of an edge table, by contraction: every vertex takes its smallest
neighbour as parent if that is smaller, parents are followed to their roots, and the edges between
different roots go on. Every round at least halves the vertices that still have edges; nothing but
counts comes to the driver, and every round's tables are written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressroom.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every vertex of ``edges`` (a, b): the smallest vertex that it reaches.
    Loops and repeated edges do no harm; no edges, no rows."""
    edges = written(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    labels = None
    while not edges.isEmpty():
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents = written(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("parent")), "parents")
        while True:
            above = parents.select(F.col("node").alias("parent"), F.col("parent").alias("root"))
            followed = written(parents.join(above, "parent").select("node", F.col("root").alias("parent"), (F.col("root") != F.col("parent")).alias("moved")), "parents")
            parents = followed.select("node", "parent")
            if followed.filter("moved").isEmpty():
                break
        if labels is None:
            labels = parents.select("node", F.col("parent").alias("component"))
        else:
            up = parents.select(F.col("node").alias("component"), F.col("parent").alias("up"))
            labels = written(labels.join(up, "component", "left").select("node", F.coalesce("up", "component").alias("component")), "labels")
        a, b = (parents.select(F.col("node").alias(c), F.col("parent").alias(f"root_{c}")) for c in "ab")
        edges = written(edges.join(a, "a").join(b, "b").select(F.col("root_a").alias("a"), F.col("root_b").alias("b")).filter("a <> b").distinct(), "edges")
    return labels if labels is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
