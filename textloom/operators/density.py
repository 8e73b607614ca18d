"""Density clustering: cuts at one density, and the hierarchy over all densities.

Every distinct place is a weighted point.  Cells of space bound the work of a task on
neighbours and on the tree, bounded groups of edges that on the hierarchy.  After
Campello, Moulavi and Sander (2013).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import groupby
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import settle
from .condense import DENSEST, GROUP_ROWS, condense
from .forest import spanning_forest
from .knn import CHUNK, coordinates, core_distances, distances
from .reach import leaf_tree, spanning_tree
from .space import LEAF_ROWS, Leaves, dealt, distinct_points, into_leaves, visits

EDGE = "trial int, a bigint, b bigint, weight double"


def _leaf_tree(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf[np.isfinite(pdf["core"])].sort_values("id", ignore_index=True)
    ids = pdf["id"].to_numpy()
    a, b, weight = leaf_tree(coordinates(pdf), pdf["core"].to_numpy())
    trial = pdf["trial"].iloc[0] if len(pdf) else 0
    return pd.DataFrame({"trial": trial, "a": ids[a], "b": ids[b], "weight": weight})


def reach_tree(
    leaves: Leaves, trials: Sequence[int], cores: DataFrame | None = None, held: Sequence[int] = ()
) -> tuple[DataFrame, DataFrame]:
    """Points (trial, id, w, level, cell) and the edges of their mutual-reachability tree, for each sample size.

    ``cores`` is a core table of the sample sizes ``held``.
    """
    if cores is None:
        cored = core_distances(leaves, trials)
    else:
        cored = cores.withColumn("cores", F.array(*[F.col("cores")[held.index(ms)] for ms in trials]))
    pairs = F.explode(
        F.transform("cores", lambda core, i: F.struct(i.alias("trial"), core.alias("core")))
    )
    cored = cored.select("*", pairs.alias("t"))
    points = cored.select(
        F.col("t.trial").alias("trial"), "id", "p", "w", F.col("t.core").alias("core"), "level", "cell"
    )
    points = settle(points, "cores")
    plain = points.select("trial", "id", "w", "level", "cell")
    if leaves.single:
        return plain, dealt(points, "trial", "level", "cell").groupBy("trial", "level", "cell").applyInPandas(_leaf_tree, EDGE)
    return plain, spanning_tree(points, leaves)


def _condense(min_cluster_size: int, epsilon: float, points: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
    """Flat clusters of one spanning tree over a bounded number of places.

    Joins are taken from the lightest edge up.  A cluster is a component of at
    least ``min_cluster_size`` rows; it is born where two such meet or at the
    top, and its rows leave it where their own part falls below that size.
    """
    ids = points["id"].to_numpy()
    order = np.argsort(ids)
    ids, rows = ids[order], points["w"].to_numpy()[order]
    n = len(ids)
    edges = edges.sort_values(["weight", "a", "b"])
    a = np.searchsorted(ids, edges["a"].to_numpy()).tolist()
    b = np.searchsorted(ids, edges["b"].to_numpy()).tolist()
    with np.errstate(divide="ignore"):
        density = np.minimum(1.0 / edges["weight"].to_numpy(), DENSEST).tolist()

    root = list(range(n))
    size = rows.tolist()
    members = [[i] for i in range(n)]  # points of a component that has no cluster yet
    cluster = [-1] * n  # cluster of a component that is big enough
    owner = np.full(n, -1, np.int64)  # cluster each point falls out of
    parent: list[int] = []
    children: list[list[int]] = []
    mass: list[float] = []  # sum of rows times density of leaving
    total: list[int] = []  # rows under the cluster
    born: list[float] = []

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def new_cluster(kids: list[int]) -> int:
        c = len(parent)
        parent.append(-1)
        children.append(kids)
        mass.append(0.0)
        total.append(sum(total[k] for k in kids))
        born.append(0.0)
        return c

    def leave(c: int, points_out: list[int], at: float) -> None:
        if not points_out:
            return
        count = sum(int(rows[i]) for i in points_out)
        owner[points_out] = c
        mass[c] += count * at
        total[c] += count

    # A place that is big enough by itself is a cluster from the start.
    for i in range(n):
        if size[i] >= min_cluster_size:
            cluster[i] = new_cluster([])
            leave(cluster[i], members[i], DENSEST)
            members[i] = []
    def part(i: int) -> tuple[list[int], list[int]]:
        """Clusters and loose points of a component."""
        return ([cluster[i]], []) if cluster[i] >= 0 else ([], members[i])

    # Edges of equal weight join at once, so the order of ties does not matter.
    for at, group in groupby(zip(density, a, b), key=lambda e: e[0]):
        joined: dict[int, tuple[list[int], list[int]]] = {}
        for _, i, j in group:
            i, j = find(i), find(j)
            if i == j:
                continue
            if size[i] < size[j]:
                i, j = j, i
            kids, loose = joined.pop(i, None) or part(i)
            kids2, loose2 = joined.pop(j, None) or part(j)
            if len(loose) < len(loose2):
                loose, loose2 = loose2, loose
            loose.extend(loose2)
            root[j] = i
            size[i] += size[j]
            joined[i] = (kids + kids2, loose)
        for i, (kids, loose) in joined.items():
            if len(kids) > 1:
                c = new_cluster(kids)
                for k in kids:
                    parent[k], born[k] = c, at
                    mass[c] += total[k] * at
            elif kids:
                c = kids[0]
            elif size[i] >= min_cluster_size:
                c = new_cluster([])
            else:
                members[i] = loose
                continue
            leave(c, loose, at)
            cluster[i], members[i] = c, []

    # The tops of all trees are parts of one root, which is never chosen itself.
    m = len(parent)
    tops = [c for c in range(m) if parent[c] < 0]
    only_root = tops[0] if len(tops) == 1 else -1
    stability = [mass[c] - born[c] * total[c] for c in range(m)]
    chosen = [False] * m
    for c in range(m):  # children come before their parents
        below = sum(stability[k] for k in children[c])
        if c == only_root:
            continue
        if not children[c] or stability[c] >= below:
            chosen[c] = True
        else:
            stability[c] = below
    if epsilon > 0:
        limit = 1.0 / epsilon
        for c in range(m):
            if chosen[c] and born[c] > limit:
                up = c
                while parent[up] >= 0 and parent[up] != only_root and born[up] > limit:
                    up = parent[up]
                chosen[c], chosen[up] = False, True
    label = [-1] * m
    for c in range(m - 1, -1, -1):  # the highest chosen cluster wins
        if parent[c] >= 0 and label[parent[c]] >= 0:
            label[c] = label[parent[c]]
        elif chosen[c]:
            label[c] = c
    found = np.array(label + [-1], np.int64)[owner]
    named: dict[int, int] = {-1: -1}
    for c in found.tolist():  # ids ascend, so clusters are numbered by their smallest id
        if c not in named:
            named[c] = len(named) - 1
    return pd.DataFrame({"id": ids, "clust_id": np.array([named[c] for c in found.tolist()], np.int32)})


def flat_clusters(
    points: DataFrame, edges: DataFrame, settings: Sequence[tuple[int, float]], group_rows: int = GROUP_ROWS
) -> DataFrame:
    """Rows (trial, id, w, clust_id): one flat clustering for each trial.

    ``settings`` has (min_cluster_size, epsilon) for each trial.  Trees of up to ``group_rows`` points are
    condensed in one task each, larger ones in many.
    """

    def run(key: tuple, pts: pd.DataFrame, tree: pd.DataFrame) -> pd.DataFrame:
        size, epsilon = settings[int(key[0])]
        out = _condense(size, epsilon, pts, tree)
        out = out.merge(pts[["id", "w"]], on="id")
        out.insert(0, "trial", int(key[0]))
        return out[["trial", "id", "w", "clust_id"]]

    if points.where("trial = 0").limit(group_rows + 1).count() <= group_rows:
        return (
            dealt(points.select("trial", "id", "w"), "trial").groupBy("trial")
            .cogroup(dealt(edges, "trial").groupBy("trial"))
            .applyInPandas(run, "trial int, id bigint, w bigint, clust_id int")
        )
    whole = None
    for i, (size, epsilon) in enumerate(settings):
        own = points.where(F.col("trial") == i)
        places = own.select("id", F.struct("level", "cell").alias("key"))
        found = condense(own.select("id", "w"), edges.where(F.col("trial") == i), size, epsilon, places, group_rows)
        found = found.select(F.lit(i).alias("trial"), "id", "w", "clust_id")
        whole = found if whole is None else whole.union(found)
    return whole


def cluster_points(
    leaves: Leaves, settings: Sequence[tuple[int, int, float]], group_rows: int = GROUP_ROWS, cores: DataFrame | None = None,
    held: Sequence[int] = (),
) -> DataFrame:
    """Labels of weighted points for each (min_cluster_size, min_samples, epsilon)."""
    points, edges = reach_tree(leaves, [ms for _, ms, _ in settings], cores, held)
    return flat_clusters(points, edges, [(size, eps) for size, _, eps in settings], group_rows)


def label_rows(df: DataFrame, dims: list[str], points: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows with the label (id, clust_id) of their point."""
    own = points.join(labels, "id").select(*[F.col("p")[i].alias(f"_d{i}") for i in range(len(dims))], "clust_id")
    same = [F.col(d).cast("double").eqNullSafe(F.col(f"_d{i}")) for i, d in enumerate(dims)]
    return df.join(own, reduce(and_, same), "left").drop(*[f"_d{i}" for i in range(len(dims))])


def hdbscan(
    df: DataFrame,
    dims: list[str],
    min_cluster_size: int = 15,
    min_samples: int | None = None,
    epsilon: float = 0.0,
    key: str = "doc_id",
    leaf_rows: int = LEAF_ROWS,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """Adds ``clust_id``: clusters numbered from 0 by their smallest key, noise -1.

    Copies of a place are one point with a weight; the tree is that of all pairs of points, whatever the sizes
    of leaves and groups.
    """
    min_samples = min_cluster_size if min_samples is None else min_samples
    points = settle(distinct_points(df, key, dims), "points")
    leaves = into_leaves(points, max(leaf_rows, 4 * min_samples))
    labels = cluster_points(leaves, [(min_cluster_size, min_samples, epsilon)], group_rows)
    return label_rows(df, dims, points, settle(labels.select("id", "clust_id"), "clusters"))


# One density.


def _local_components(pdf: pd.DataFrame) -> pd.DataFrame:
    """Components of the core points of one leaf that lie within reach of each other."""
    ids, eps = pdf["id"].to_numpy(), float(pdf["eps"].iloc[0])
    order = np.argsort(ids)
    p, core = coordinates(pdf)[order], pdf["core"].to_numpy()[order]
    a, b, weight = leaf_tree(p, core)
    root = list(range(len(ids)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, j, w in zip(a.tolist(), b.tolist(), weight.tolist()):
        if w <= eps:
            i, j = find(i), find(j)
            root[max(i, j)] = min(i, j)
    ids = ids[order]
    out = pdf.iloc[order][["id", "p", "level", "cell"]].copy()
    out["part"] = [ids[find(i)] for i in range(len(ids))]
    return out


def _meeting_parts(leaf: pd.DataFrame, callers: pd.DataFrame) -> pd.DataFrame:
    """Pairs of parts of two leaves that have points within reach."""
    pairs: set[tuple[int, int]] = set()
    if len(leaf) and len(callers):
        p, part = coordinates(leaf), leaf["part"].to_numpy()
        q, home, eps = np.stack(callers["q"]), callers["home"].to_numpy(), callers["r"].to_numpy()
        for start in range(0, len(q), CHUNK):
            near = distances(q[start : start + CHUNK], p) <= eps[start : start + CHUNK, None]
            for i, j in np.argwhere(near):
                pairs.add((int(home[start + i]), int(part[j])))
    return pd.DataFrame(sorted(pairs), columns=["a", "b"]).astype("int64")


def tree_cuts(points: DataFrame, min_samples: int, cuts: Sequence[float], leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """Rows (cut, id, component): what the hierarchy's tree holds together at each density.

    The same components as ``density_cut`` gives, for many cuts from one tree.
    """
    leaves = into_leaves(points, max(leaf_rows, 4 * min_samples))
    cores = settle(core_distances(leaves, [min_samples]).select(
        F.lit(0).alias("trial"), "id", "p", "w", F.col("cores")[0].alias("core"), "level", "cell"
    ), "cores")
    tree = cores.groupBy("trial", "level", "cell").applyInPandas(_leaf_tree, EDGE) if leaves.single else spanning_tree(cores, leaves)
    at = F.posexplode(F.array(*[F.lit(float(c)) for c in cuts])).alias("trial", "cut")
    kept = tree.select("a", "b", "weight", at).where("weight <= cut").select("trial", "a", "b", "weight")
    joined = spanning_forest(kept).components
    dense = cores.select("id", "core", at).where("core <= cut")
    return dense.join(joined, ["trial", "id"], "left").select("cut", "id", F.coalesce("component", "id").alias("component"))


def density_cut(points: DataFrame, min_samples: int, eps: float, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """Rows (id, component) of the points whose core distance is at most ``eps``.

    Points are together when a chain of core points with steps of at most ``eps``
    joins them; a component has the name of its smallest id.  Exact for any
    number of leaves: parts of leaves meet where a point reaches into another leaf.
    """
    leaves = into_leaves(points, max(leaf_rows, 4 * min_samples))
    cores = core_distances(leaves, [min_samples]).select(
        "id", "p", "level", "cell", F.col("cores")[0].alias("core"), F.lit(float(eps)).alias("eps")
    ).where(F.col("core") <= eps)
    schema = "id bigint, p array<double>, level int, cell array<int>, part bigint"
    local = cores.groupBy("level", "cell").applyInPandas(_local_components, schema)
    if leaves.single:
        return local.select("id", F.col("part").alias("component"))
    local = settle(local, "parts")
    balls = local.select(
        "id", "p", "part", F.lit(float(eps)).alias("r"),
        F.col("level").alias("own_level"), F.col("cell").alias("own_cell"),
    )
    calls = visits(balls, leaves).where(
        (F.col("level") != F.col("own_level")) | (F.to_json("cell") != F.to_json("own_cell"))
    )
    meetings = (
        local.groupBy("level", "cell")
        .cogroup(
            calls.select(
                F.col("p").alias("q"), F.col("part").alias("home"), "r",
                F.col("level").alias("to_level"), F.col("cell").alias("to_cell"),
            ).groupBy("to_level", "to_cell")
        )
        .applyInPandas(_meeting_parts, "a bigint, b bigint")
        .select(F.lit(0).alias("trial"), "a", "b", F.lit(0.0).alias("weight"))
    )
    joined = spanning_forest(meetings).components.select(F.col("id").alias("part"), "component")
    return local.join(joined, "part", "left").select("id", F.coalesce("component", "part").alias("component"))
