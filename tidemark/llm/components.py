"""Connected components by contraction: every node joins its smallest neighbour, then edges shrink.

Each round maps the ends of the edges to their parents (twice, which halves chains) and drops
loops; the smallest node of a component maps to itself always, so it is the one that stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from . import store


def _mapped(edges: DataFrame, parent: DataFrame, side: str) -> DataFrame:
    p = parent.select(F.col("id").alias(side), F.col("parent").alias("p"))
    return edges.join(p, side, "left").withColumn(side, F.coalesce("p", side)).drop("p")


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every id in ``edges``(a, b); component is the smallest id reachable."""
    edges = store.materialise(edges.filter("a <> b").distinct(), "edges")
    labels: DataFrame | None = None
    while not edges.isEmpty():
        both = edges.select("a", "b").union(edges.select("b", "a")).toDF("id", "near")
        parent = both.groupBy("id").agg(F.least("id", F.min("near")).alias("parent"))
        parent = store.materialise(parent, "parent")
        up = parent.select(F.col("id").alias("parent"), F.col("parent").alias("p"))
        parent = store.materialise(parent.join(up, "parent", "left").select("id", F.coalesce("p", "parent").alias("parent")), "parent")
        if labels is None:
            labels = parent.select("id", F.col("parent").alias("component"))
        else:
            up = parent.select(F.col("id").alias("component"), F.col("parent").alias("p"))
            labels = store.materialise(labels.join(up, "component", "left").select("id", F.coalesce("p", "component").alias("component")), "labels")
        short = _mapped(_mapped(edges, parent, "a"), parent, "b").filter("a <> b")
        short = short.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        old, edges = edges, store.materialise(short, "edges")
        store.discard(old)
    if labels is None:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return labels
