"""Connected components by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.store import stored


def components(edges: DataFrame) -> DataFrame:
    """(key, component) of every vertex of ``edges`` (a, b); the component is its least key.

    Each round every vertex points at its least neighbour, chains of pointers are shortened to
    their ends, and the edges are drawn between the ends. A round leaves at most half of the
    vertices that still have edges, so the rounds are logarithmic; vertices and edges stay in
    Spark. A hub is only ever looked up, never gathered.
    """
    edges = stored(edges.where("a <> b").select("a", "b").distinct(), "graph-edges")
    labels = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("b"))
        parents = stored(parents.select(F.col("a").alias("key"), F.col("b").alias("component")), "graph-parents")
        while True:
            next_up = parents.select(F.col("key").alias("component"), F.col("component").alias("_up"))
            shorter = stored(
                parents.join(next_up, "component", "left").select(
                    "key",
                    F.coalesce("_up", "component").alias("component"),
                    (F.coalesce("_up", "component") != F.col("component")).alias("_moved"),
                ),
                "graph-parents",
            )
            parents = shorter.drop("_moved")
            if shorter.where("_moved").isEmpty():
                break
        if labels is None:
            labels = parents
        else:
            top = parents.select(F.col("key").alias("component"), F.col("component").alias("_top"))
            labels = stored(
                labels.join(top, "component", "left").select(
                    "key", F.coalesce("_top", "component").alias("component")
                ),
                "graph-labels",
            )
        a = parents.select(F.col("key").alias("a"), F.col("component").alias("_a"))
        b = parents.select(F.col("key").alias("b"), F.col("component").alias("_b"))
        edges = stored(
            edges.join(a, "a").join(b, "b").where("_a <> _b")
            .select(F.col("_a").alias("a"), F.col("_b").alias("b")).distinct(),
            "graph-edges",
        )
    if labels is None:
        labels = edges.select(F.col("a").alias("key"), F.col("b").alias("component"))
    return labels
