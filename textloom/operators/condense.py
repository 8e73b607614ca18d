"""Flat clusters of a spanning tree of any size, by contraction in bounded groups.

Edges join from the lightest up.  A component of at least ``min_cluster_size`` rows is a cluster;
smaller ones are loose points.  A row of the vertex table sums up a finished subtree: its rows, and either
its loose points (fewer than a cluster's) or its cluster with what selection needs to know of it.

1. Every leaf of space joins, in parallel, whatever no edge to another leaf comes before.
2. The lightest of the edges that are left join next, a bounded number at a time; equal weights join at once.
   Where more edges than that have one weight, their components are summed up by grouping.
3. A cluster that ends has its stability, its parent, and whether it is chosen over those below it.  Steps of
   doubled length over the clusters' parents find the highest chosen one above each.

Each table shrinks with the edges.  The points that fall out of a cluster are written when they do.
"""

from __future__ import annotations

from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import settle
from .forest import spanning_forest

DENSEST = 1e280  # stands for the density of copies
GROUP_ROWS = 1 << 18  # edges that one task joins

VERTEX, MOVED, FALLEN, ENDED = range(4)
STATE = ["size", "ca", "cb", "total", "mass", "below", "kids", "members"]
CLUSTER = ["ca", "cb", "pa", "pb", "born", "chosen"]
# A cluster's name is its smallest point and how many clusters deep it is above its first one.
EVENTS = (
    "kind int, id bigint, rep bigint, size bigint, ca bigint, cb int, total bigint, mass double, below double, "
    "kids boolean, members array<bigint>, pa bigint, pb int, born double, chosen boolean"
)
NAMES = [c.split()[0] for c in EVENTS.split(", ")]


def density(weight: Column) -> Column:
    return F.when(weight > 0, F.least(1 / weight, F.lit(DENSEST))).otherwise(DENSEST)


class _Blob:
    """A component: its rows, its loose points or its cluster, and the density of the first edge that it must wait for."""

    __slots__ = ("rep", "size", "members", "cluster", "total", "mass", "below", "kids", "limit")

    def __init__(self, row: dict):
        self.rep, self.size, self.limit = int(row["id"]), int(row["size"]), float(row["limit"])
        self.cluster = None if pd.isna(row["ca"]) else (int(row["ca"]), int(row["cb"]))
        self.total, self.mass, self.below, self.kids = 0, 0.0, 0.0, False
        self.members = [int(m) for m in row["members"]]
        if self.cluster:
            self.total, self.mass, self.below, self.kids = int(row["total"]), float(row["mass"]), float(row["below"]), bool(row["kids"])


def _join(blobs: list[_Blob], at: float, min_cluster_size: int, out: list[dict]) -> _Blob:
    """The component of all these at this density; the first one stands for it."""
    whole = blobs[0]
    clusters = [b for b in blobs if b.cluster]
    loose = [m for b in blobs if not b.cluster for m in b.members]
    count = sum(b.size for b in blobs if not b.cluster)
    size, rep = sum(b.size for b in blobs), min(b.rep for b in blobs)
    if len(clusters) > 1:
        name = (min(b.cluster[0] for b in clusters), max(b.cluster[1] for b in clusters) + 1)
        total, below = sum(b.total for b in clusters), 0.0
        for b in clusters:
            stability = b.mass - at * b.total
            chosen = not b.kids or stability >= b.below
            below += stability if chosen else b.below
            out.append({"kind": ENDED, "ca": b.cluster[0], "cb": b.cluster[1], "pa": name[0], "pb": name[1], "born": at, "chosen": chosen})
        state = (name, total, total * at, below, True)
    elif clusters:
        b = clusters[0]
        state = (b.cluster, b.total, b.mass, b.below, b.kids)
    elif size >= min_cluster_size:
        state = ((min(loose), 0), 0, 0.0, 0.0, False)
    else:
        state = (None, 0, 0.0, 0.0, False)
    whole.cluster, whole.total, whole.mass, whole.below, whole.kids = state
    whole.size, whole.rep, whole.members = size, rep, loose
    if whole.cluster and loose:
        whole.total += count
        whole.mass += count * at
        out.append({"kind": FALLEN, "ca": whole.cluster[0], "cb": whole.cluster[1], "members": loose})
        whole.members = []
    return whole


def join_group(vertices: pd.DataFrame, edges: pd.DataFrame, min_cluster_size: int) -> pd.DataFrame:
    """Joins all that can be joined of a group of vertices; edges to others are in the vertices' ``limit``."""
    out: list[dict] = []
    blobs = [_Blob(r) for r in vertices.to_dict("records")]
    first = [b.rep for b in blobs]
    ids = vertices["id"].to_numpy()
    order = np.argsort(ids)
    a, b = (order[np.searchsorted(ids, edges[c].to_numpy(), sorter=order)] for c in "ab")
    with np.errstate(divide="ignore"):
        dense = np.minimum(1.0 / edges["weight"].to_numpy(), DENSEST)
    by = np.argsort(-dense, kind="stable")
    root = list(range(len(blobs)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for at, group in groupby(zip(dense[by].tolist(), a[by].tolist(), b[by].tolist()), key=lambda e: e[0]):
        # What the edges of this density connect joins at once, or waits as a whole.
        near: dict[int, int] = {}

        def top(i: int) -> int:
            while near.setdefault(i, i) != i:
                i = near[i]
            return i

        for _, i, j in group:
            i, j = top(find(i)), top(find(j))
            if i != j:
                near[max(i, j)] = min(i, j)
        together: dict[int, list[int]] = {}
        for i in list(near):
            together.setdefault(top(i), []).append(i)
        for parts in together.values():
            if len(parts) < 2:
                continue
            if max(blobs[i].limit for i in parts) >= at:
                for i in parts:
                    blobs[i].limit = max(blobs[i].limit, at)
                continue
            limit = max(blobs[i].limit for i in parts)
            parts.sort(key=lambda i: -blobs[i].size)
            whole = _join([blobs[i] for i in parts], at, min_cluster_size, out)
            whole.limit = limit
            for i in parts[1:]:
                root[i] = parts[0]
    for i, b in enumerate(blobs):
        if root[i] == i:
            row = {"kind": VERTEX, "id": b.rep, "size": b.size, "total": b.total, "mass": b.mass, "below": b.below, "kids": b.kids, "members": b.members}
            if b.cluster:
                row |= {"ca": b.cluster[0], "cb": b.cluster[1]}
            out.append(row)
        rep = blobs[find(i)].rep
        if rep != first[i]:
            out.append({"kind": MOVED, "id": first[i], "rep": rep})
    table = pd.DataFrame(out, columns=NAMES)
    whole = {c: "Int64" for c in ("id", "rep", "size", "ca", "total", "pa")} | {"cb": "Int32", "pb": "Int32", "kids": "boolean", "chosen": "boolean"}
    table["members"] = [m if isinstance(m, list) else None for m in table["members"]]
    return table.astype(whole)


def _begin(points: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """Vertex rows of (id, w), and the points that are a cluster by themselves as fallen."""
    big = F.col("w") >= least
    own = {
        "ca": F.when(big, F.col("id")), "cb": F.when(big, 0), "total": F.when(big, F.col("w")), "mass": F.when(big, F.col("w") * DENSEST),
        "below": F.when(big, 0.0), "kids": F.when(big, False),
    }
    members = F.when(big, F.array().cast("array<bigint>")).otherwise(F.array("id")).alias("members")
    state = [v.alias(c) for c, v in own.items()]
    return points.select("id", F.col("w").alias("size"), *state, members), points.where(big).select(F.col("id").alias("ca"), F.lit(0).alias("cb"), "id")


class _Contraction:
    """The tables of one tree that shrink, and the events written so far."""

    def __init__(self, points: DataFrame, edges: DataFrame, least: int, group_rows: int):
        self.least, self.group_rows = least, group_rows
        self.vertices, big = _begin(points, least)
        self.edges = edges.select("a", "b", "weight")
        self.fallen, self.ended = [big], []

    def step(self, new: DataFrame, moved: DataFrame, fallen: DataFrame, ended: DataFrame, untouched: DataFrame | None, left: DataFrame) -> None:
        self.fallen.append(fallen)
        self.ended.append(ended)
        self.vertices = settle(new if untouched is None else untouched.unionByName(new), "vertices")
        for end in "ab":
            left = left.join(moved.select(F.col("id").alias(end), F.col("rep").alias("to")), end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
        self.edges = settle(left.where("a <> b").select("a", "b", "weight"), "edges")

    def groups(self, vertices: DataFrame, edges: DataFrame, untouched: DataFrame | None, left: DataFrame) -> None:
        """Join inside groups of vertices (``key``, ``limit``) and edges (``key``); ``left`` are the edges that may stay."""
        least = self.least

        def run(pts: pd.DataFrame, tree: pd.DataFrame) -> pd.DataFrame:
            return join_group(pts, tree, least) if len(pts) else pd.DataFrame(columns=NAMES)

        found = vertices.groupBy("key").cogroup(edges.groupBy("key")).applyInPandas(run, EVENTS)
        events = settle(found, "events")
        of = {k: events.where(F.col("kind") == k) for k in (VERTEX, MOVED, FALLEN, ENDED)}
        fallen = of[FALLEN].select("ca", "cb", F.explode("members").alias("id"))
        self.step(of[VERTEX].select("id", *STATE), of[MOVED].select("id", "rep"), fallen, of[ENDED].select(*CLUSTER), untouched, left)

    def by_place(self, places: DataFrame) -> None:
        """Join inside the places (id, key) of the vertices, as far as no edge to another place comes before."""
        edges = self.edges
        for end in "ab":
            edges = edges.join(places.select(F.col("id").alias(end), F.col("key").alias(f"at_{end}")), end)
        edges = settle(edges, "placed edges")
        inner = edges.where("at_a = at_b").select(F.col("at_a").alias("key"), "a", "b", "weight")
        across = edges.where("at_a <> at_b")
        ends = across.select(F.col("a").alias("id"), "weight").union(across.select(F.col("b").alias("id"), "weight"))
        limits = ends.groupBy("id").agg(F.max(density(F.col("weight"))).alias("limit"))
        placed = self.vertices.join(places, "id").join(limits, "id", "left").withColumn("limit", F.coalesce("limit", F.lit(0.0)))
        self.groups(placed, inner, None, self.edges)

    def lightest(self) -> bool:
        """Join about ``group_rows`` of the lightest edges; False if there are none."""
        n = self.edges.count()
        if not n:
            return False
        now, later = self.edges, self.edges.limit(0)
        if n > self.group_rows:
            bound = self.edges.agg(F.percentile_approx("weight", self.group_rows / n, max(10_000, 20 * n // self.group_rows))).first()[0]
            below, equal = self.edges.agg(F.count_if(F.col("weight") < bound), F.count_if(F.col("weight") == bound)).first()
            if below + equal <= 2 * self.group_rows:
                now, later = self.edges.where(F.col("weight") <= bound), self.edges.where(F.col("weight") > bound)
            elif below:
                now, later = self.edges.where(F.col("weight") < bound), self.edges.where(F.col("weight") >= bound)
            else:
                self.ties(bound)
                return True
        touched = settle(now.select(F.col("a").alias("id")).union(now.select(F.col("b").alias("id"))).distinct(), "touched")
        vertices = self.vertices.join(touched, "id", "left_semi").withColumn("limit", F.lit(0.0)).withColumn("key", F.lit(0))
        self.groups(vertices, now.withColumn("key", F.lit(0)), self.vertices.join(touched, "id", "left_anti"), later)
        return True

    def ties(self, weight: float) -> None:
        """Join all edges of the least weight, however many."""
        at = min(1 / weight, DENSEST) if weight > 0 else DENSEST
        equal = self.edges.where(F.col("weight") == weight)
        parts = spanning_forest(equal.select(F.lit(0).alias("trial"), "a", "b", "weight")).components.select("id", "component")
        parts = settle(parts, "tied")
        stability = F.col("mass") - at * F.col("total")
        chosen = ~F.col("kids") | (stability >= F.col("below"))
        held = F.col("ca").isNotNull()
        joined = self.vertices.join(parts, "id").withColumn("chosen", F.when(held, chosen))
        joined = settle(joined.withColumn("value", F.when(F.col("chosen"), stability).otherwise(F.col("below"))), "joined")
        sums = joined.groupBy("component").agg(
            F.sum("size").alias("size"), F.count("ca").alias("clusters"), F.coalesce(F.sum("total"), F.lit(0)).alias("rows"), F.sum("value").alias("value"),
            F.min("ca").alias("ca"), F.max("cb").alias("cb"), F.max(F.when(held, F.struct("total", "mass", "below", "kids"))).alias("one"),
            F.coalesce(F.sum(F.when(~held, F.col("size"))), F.lit(0)).alias("loose"), F.min(F.when(~held, F.array_min("members"))).alias("first"),
        )
        many, one = F.col("clusters") > 1, F.col("clusters") == 1
        born = (F.col("clusters") == 0) & (F.col("size") >= self.least)
        state = sums.select(
            F.col("component").alias("id"), "size", "clusters",
            F.when(many | one, F.col("ca")).when(born, F.col("first")).alias("ca"),
            F.when(many, F.col("cb") + 1).when(one, F.col("cb")).when(born, 0).alias("cb"),
            F.when(many | one | born, F.col("rows") + F.col("loose")).alias("total"),
            F.when(many | born, (F.col("rows") + F.col("loose")) * at).when(one, F.col("one.mass") + F.col("loose") * at).alias("mass"),
            F.when(many, F.col("value")).when(one, F.col("one.below")).when(born, 0.0).alias("below"),
            F.when(many, True).when(one, F.col("one.kids")).when(born, False).alias("kids"),
        )
        state = settle(state, "state")
        name = state.select(F.col("id").alias("component"), F.col("ca").alias("na"), F.col("cb").alias("nb"), "clusters")
        named = joined.join(name, "component")
        # Fewer points than a cluster has.
        loose = named.where("na is null").groupBy(F.col("component").alias("id")).agg(F.flatten(F.collect_list("members")).alias("members"))
        new = state.drop("clusters").join(loose, "id", "left").withColumn("members", F.coalesce("members", F.array().cast("array<bigint>")))
        ended = named.where(held & (F.col("clusters") > 1)).select(
            "ca", "cb", F.col("na").alias("pa"), F.col("nb").alias("pb"), F.lit(at).alias("born"), "chosen"
        )
        fallen = named.where(~held & F.col("na").isNotNull()).select(F.col("na").alias("ca"), F.col("nb").alias("cb"), F.explode("members").alias("id"))
        moved = parts.where("id <> component").select("id", F.col("component").alias("rep"))
        self.step(new.select("id", *STATE), moved, fallen, ended, self.vertices.join(parts, "id", "left_anti"), self.edges.where(F.col("weight") > weight))

    def clusters(self) -> tuple[DataFrame, bool]:
        """(ca, cb, pa, pb, born, chosen) of all clusters; the tops last until density 0.  Whether there is one top only, which is never chosen."""
        tops = self.vertices.where("ca is not null")
        single = tops.limit(2).count() == 1
        chosen = F.lit(False) if single else ~F.col("kids") | (F.col("mass") >= F.col("below"))
        rows = tops.select("ca", "cb", F.lit(None).cast("bigint").alias("pa"), F.lit(None).cast("int").alias("pb"), F.lit(0.0).alias("born"), chosen.alias("chosen"))
        for more in self.ended:
            rows = rows.unionByName(more)
        return settle(rows, "clusters"), single


def _climbed(clusters: DataFrame, single: bool, epsilon: float) -> DataFrame:
    """Clusters of which none chosen is born above the density 1 / epsilon, where a cluster above can stand for it."""
    own, above = F.struct("ca", "cb"), F.struct(F.col("pa").alias("ca"), F.col("pb").alias("cb"))
    root = clusters.where("pa is null").select(F.col("ca").alias("pa"), F.col("cb").alias("pb"), F.lit(single).alias("only"))
    known = clusters.join(root, ["pa", "pb"], "left")
    climbs = (F.col("born") > 1 / epsilon) & F.col("pa").isNotNull() & ~F.coalesce("only", F.lit(False))
    steps = settle(known.select(own.alias("c"), F.when(climbs, above).otherwise(own).alias("at")), "steps")
    while True:
        next_step = steps.select(F.col("c").alias("at"), F.col("at").alias("to"))
        steps = settle(steps.join(next_step, "at").select("c", F.col("to").alias("at"), (F.col("at") != F.col("to")).alias("moved")), "steps")
        if not steps.where("moved").limit(1).count():
            break
        steps = steps.drop("moved")
    taken = clusters.where("chosen").select(own.alias("c")).join(steps, "c").select("at.ca", "at.cb").distinct().withColumn("taken", F.lit(True))
    return clusters.join(taken, ["ca", "cb"], "left").withColumn("chosen", F.coalesce("taken", F.lit(False))).drop("taken")


def _highest_chosen(clusters: DataFrame) -> DataFrame:
    """(ca, cb, top): the highest chosen cluster at or above each, by steps of doubled length."""
    own = F.struct("ca", "cb")
    rows = clusters.select(
        own.alias("c"), F.when(F.col("pa").isNotNull(), F.struct(F.col("pa").alias("ca"), F.col("pb").alias("cb"))).alias("up"),
        F.when(F.col("chosen"), own).alias("top"),
    )
    rows = settle(rows, "tops")
    while rows.where("up is not null").limit(1).count():
        above = rows.select(F.col("c").alias("up"), F.col("up").alias("next"), F.col("top").alias("higher"))
        rows = rows.join(above, "up", "left").select("c", F.col("next").alias("up"), F.coalesce("higher", "top").alias("top"))
        rows = settle(rows, "tops")
    return rows.where("top is not null").select("c.ca", "c.cb", "top")


def _numbered(found: DataFrame) -> DataFrame:
    """(top, clust_id): clusters numbered from 0 by their smallest id."""
    first = found.groupBy("top").agg(F.min("id").alias("first"))
    dealt = settle(first.repartitionByRange("first").withColumn("part", F.spark_partition_id()), "first")
    counts = dealt.groupBy("part").agg(F.count("*").alias("n"))  # one row for each partition
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("part").orderBy("first"))
    return dealt.withColumn("place", place).join(F.broadcast(offsets), "part").select("top", (F.col("before") + F.col("place") - 1).cast("int").alias("clust_id"))


def condense(points: DataFrame, edges: DataFrame, least: int, epsilon: float = 0.0, places: DataFrame | None = None, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Rows (id, w, clust_id) of the points (id, w) of one tree (a, b, weight); noise is -1.

    ``places`` (id, key) deals the points to groups that join in parallel first.  No task joins more than about twice
    ``group_rows`` edges or one place.
    """
    work = _Contraction(points, edges, least, group_rows)
    if places is not None:
        work.by_place(places)
    while work.lightest():
        pass
    clusters, single = work.clusters()
    if epsilon > 0:
        clusters = settle(_climbed(clusters, single, epsilon), "climbed")
    fallen = work.fallen[0]
    for more in work.fallen[1:]:
        fallen = fallen.unionByName(more)
    found = settle(fallen.join(_highest_chosen(clusters), ["ca", "cb"]).select("id", "top"), "found")
    labels = found.join(_numbered(found), "top").select("id", "clust_id")
    return points.select("id", "w").join(labels, "id", "left").withColumn("clust_id", F.coalesce("clust_id", F.lit(-1)))
