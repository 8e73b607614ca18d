"""Minimum spanning forests and connected components of an edge table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import settle


@dataclass
class Forest:
    """Forest edges (trial, a, b, weight) and components (trial, id, component)."""

    edges: DataFrame
    components: DataFrame


def roots(hooks: DataFrame) -> DataFrame:
    """Follow parents to the root, doubling the step in each round."""
    hooks = settle(hooks, "hooks")
    while True:
        up = hooks.select("trial", F.col("node").alias("parent"), F.col("parent").alias("above"))
        stepped = settle(
            hooks.join(up, ["trial", "parent"], "left").select(
                "trial", "node", F.coalesce("above", "parent").alias("parent"),
                (F.coalesce("above", "parent") != F.col("parent")).alias("moved"),
            ),
            "hooks",
        )
        hooks = stepped.drop("moved")
        if not stepped.where("moved").limit(1).count():
            return hooks


def choose_lightest(live: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each component's lightest edge (trial, node, weight, a, b), and the root (trial, node, parent) it joins.

    ``live`` has edges (trial, u, v, weight, a, b) between the components u and v that hold a and b.  Ties fall to
    the smaller ids, so the choices form no cycle and do not depend on partitioning.
    """
    edge = F.struct("weight", "a", "b")
    ends = live.select("trial", F.col("u").alias("node"), F.col("v").alias("other"), edge.alias("e")).union(
        live.select("trial", F.col("v").alias("node"), F.col("u").alias("other"), edge.alias("e"))
    )
    best = settle(
        ends.groupBy("trial", "node").agg(F.min(F.struct("e", "other")).alias("m")).select(
            "trial", "node", F.col("m.other").alias("parent"), "m.e.weight", "m.e.a", "m.e.b"
        ),
        "best",
    )
    # Of two components that chose each other, the smaller becomes the root.
    back = best.select("trial", F.col("node").alias("parent"), F.col("parent").alias("back"))
    hooks = best.join(back, ["trial", "parent"]).select(
        "trial", "node",
        F.when((F.col("back") == F.col("node")) & (F.col("node") < F.col("parent")), F.col("node"))
        .otherwise(F.col("parent")).alias("parent"),
    )
    return best.drop("parent"), roots(hooks)


def contract(live: DataFrame, root: DataFrame) -> DataFrame:
    """The lightest edge between each pair of the components that the roots make."""
    edge = F.struct("weight", "a", "b")
    u = root.select("trial", F.col("node").alias("u"), F.col("parent").alias("ru"))
    v = root.select("trial", F.col("node").alias("v"), F.col("parent").alias("rv"))
    return settle(
        live.join(u, ["trial", "u"]).join(v, ["trial", "v"]).where("ru <> rv")
        .groupBy("trial", F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v"))
        .agg(F.min(edge).alias("e"))
        .select("trial", "u", "v", "e.weight", "e.a", "e.b"),
        "live",
    )


def spanning_forest(edges: DataFrame) -> Forest:
    """Minimum spanning forest of the edges (trial, a, b, weight), for all trials at once.

    In each round every component takes its lightest outgoing edge, and the edge
    table shrinks to the lightest edge between each pair of components.  Ties
    fall to the smaller ids, so the forest does not depend on partitioning.
    The number of rounds grows with the logarithm of the number of points.
    """
    live = settle(
        edges.where("a <> b").select(
            "trial", F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"), "weight",
            F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"),
        ),
        "live",
    )
    names = settle(
        live.select("trial", F.col("a").alias("id"))
        .union(live.select("trial", F.col("b").alias("id")))
        .distinct()
        .withColumn("component", F.col("id")),
        "components",
    )
    taken = []
    while live.limit(1).count():
        best, root = choose_lightest(live)
        taken.append(best.select("trial", "a", "b", "weight").distinct())
        live = contract(live, root)
        moved = root.select("trial", F.col("node").alias("component"), F.col("parent").alias("root"))
        names = settle(
            names.join(moved, ["trial", "component"], "left").select(
                "trial", "id", F.coalesce("root", "component").alias("component")
            ),
            "components",
        )
    forest = taken[0] if taken else live.select("trial", "a", "b", "weight")
    for more in taken[1:]:
        forest = forest.union(more)
    # Components are named by their smallest id.
    smallest = names.groupBy("trial", "component").agg(F.min("id").alias("first"))
    named = names.join(smallest, ["trial", "component"]).select(
        "trial", "id", F.col("first").alias("component")
    )
    return Forest(forest, named)
