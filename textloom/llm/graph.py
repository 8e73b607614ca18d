"""Connected components of links in Spark, by contraction.

Each round maps the links to the present roots and drops those inside a component. Every
remaining root takes the smallest root next to it, and chains are shortened by pointer
jumps. All steps are aggregates that combine before the shuffle, and equi-joins. Lineage
is cut by written tables. Nothing is collected but the number of remaining links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.sources.scratch import settle


def _jump(parents: DataFrame) -> DataFrame:
    """Each root's parent's parent."""
    up = parents.select(F.col("root").alias("parent"), F.col("parent").alias("up"))
    return parents.join(up, "parent", "left").select("root", F.coalesce("up", "parent").alias("parent"))


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b); the component is its smallest node.

    Empty links give an empty table; self-links, repeated and both-way links are harmless.
    """
    edges = settle(
        links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(),
        "edges",
    )
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    labels = None
    rest = edges
    while not rest.isEmpty():
        near = rest.select(F.col("b").alias("root"), F.col("a").alias("parent")).groupBy("root").agg(F.min("parent").alias("parent"))
        parents = settle(_jump(near), "parents")
        parents = settle(_jump(parents), "parents")
        if labels is None:
            labels = nodes.join(parents.withColumnRenamed("root", "node"), "node", "left").select(
                "node", F.coalesce("parent", "node").alias("component")
            )
        else:
            labels = labels.join(parents.withColumnRenamed("root", "component"), "component", "left").select(
                "node", F.coalesce("parent", "component").alias("component")
            )
        labels = settle(labels, "labels")
        to = parents.withColumnRenamed("root", "a").withColumnRenamed("parent", "to_a")
        rest = rest.join(to, "a", "left").select(F.coalesce("to_a", "a").alias("a"), "b")
        to = to.toDF("b", "to_b")
        rest = rest.join(to, "b", "left").select("a", F.coalesce("to_b", "b").alias("b"))
        rest = settle(
            rest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "edges"
        )
    return labels if labels is not None else nodes.select("node", F.col("node").alias("component"))
