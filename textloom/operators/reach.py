"""The spanning tree of all points under mutual reachability, exact for any number of leaves.

The lightest edge that leaves a set of points is in the tree.  A leaf's own spanning tree
holds the lightest edge of any cut inside the leaf, and every edge of a point to another leaf
weighs at least the point's core distance and its distance to the leaf's border.  So most joins
are sure inside a leaf.  What is left are parts of leaves; they join in rounds.  In each round
every component takes its lightest edge.  Where the edges at hand do not prove it, the points
that might have a lighter one look it up in the leaves that their ball touches, leaves of the same
component left out.  After March, Ram and Gray (2010).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import settle
from .buckets import BUCKET, Buckets, bucket_order, spanning_edges
from .forest import choose_lightest, contract
from .knn import coordinates
from .space import Leaves, dealt, parent, visits

CALLERS = 1 << 16  # points that look into one leaf in one task
PLAIN_ROWS = 1024  # points of which all pairs are looked at

LEAF = ["trial", "level", "cell"]
POINT, SURE, OPEN = range(3)
LOCAL = (
    "trial int, kind int, a bigint, b bigint, u bigint, v bigint, weight double, "
    "p array<double>, core double, level int, cell array<int>"
)
FOUND = "trial int, u bigint, v bigint, weight double, a bigint, b bigint"


def leaf_tree(p: np.ndarray, core: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spanning tree of all points of a leaf under mutual reachability."""
    n = len(p)
    if n > PLAIN_ROWS:
        return spanning_edges(p, core)
    axes = [np.ascontiguousarray(p[:, i]) for i in range(p.shape[1])]
    best, source = np.full(n, np.inf), np.zeros(n, np.int64)
    open_core = core.astype(float).copy()  # infinite once a point is in the tree
    reach, step = np.empty(n), np.empty(n)
    a, b, weight = [], [], []
    at = 0
    for _ in range(n - 1):
        open_core[at] = best[at] = np.inf
        reach[:] = 0
        for axis in axes:
            np.subtract(axis, axis[at], out=step)
            np.multiply(step, step, out=step)
            reach += step
        np.sqrt(reach, out=reach)
        np.maximum(reach, core[at], out=reach)
        np.maximum(reach, open_core, out=reach)
        closer = np.flatnonzero(reach < best)
        best[closer], source[closer] = reach[closer], at
        at = int(best.argmin())
        if best[at] == np.inf:  # only unreachable points are left
            break
        a.append(source[at])
        b.append(at)
        weight.append(best[at])
    return np.array(a, np.int64), np.array(b, np.int64), np.array(weight, float)


def sure_joins(
    a: np.ndarray, b: np.ndarray, weight: np.ndarray, safe: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Part of each point, named by its first point, and which edges of a leaf's tree are in the whole tree.

    ``safe`` is what any edge of a point to another leaf weighs at least.  The edges come in
    their order by weight.
    """
    n = len(safe)
    part, sure, live = np.arange(n), np.zeros(len(a), bool), np.arange(len(a))
    while True:
        u, v = part[a[live]], part[b[live]]
        between = u != v
        live, u, v = live[between], u[between], v[between]
        if not len(live):
            return part, sure
        place = np.arange(len(live))
        best, bound = np.full(n, len(live)), np.full(n, np.inf)
        np.minimum.at(best, u, place)
        np.minimum.at(best, v, place)
        np.minimum.at(bound, part, safe)
        own = np.flatnonzero(best < len(live))
        chosen = np.unique(best[own[weight[live[best[own]]] <= bound[own]]])
        if not len(chosen):
            return part, sure
        sure[live[chosen]] = True
        root = list(range(n))

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for x, y in zip(u[chosen].tolist(), v[chosen].tolist()):
            x, y = find(x), find(y)
            root[max(x, y)] = min(x, y)
        part = np.array([find(i) for i in range(n)])[part]


def _parts_of_leaf(low: list[float], extent: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf[np.isfinite(pdf["core"])].sort_values("id", ignore_index=True)
        if not len(pdf):
            return pd.DataFrame(columns=[c.split()[0] for c in LOCAL.split(", ")])
        ids, core, p = pdf["id"].to_numpy(), pdf["core"].to_numpy(), coordinates(pdf)
        level, cell = int(pdf["level"].iloc[0]), np.array(pdf["cell"].iloc[0])
        width = extent / 2.0**level
        # No points lie beyond the border of the whole space.
        left = np.where(cell > 0, p - (np.array(low) + cell * width), np.inf)
        right = np.where(cell < 2**level - 1, np.array(low) + (cell + 1) * width - p, np.inf)
        gap = np.minimum(left, right).min(axis=1) - 1e-9 * width
        safe = np.maximum(core, gap)
        a, b, weight = leaf_tree(p, core)
        a, b = np.minimum(a, b), np.maximum(a, b)
        order = np.lexsort((b, a, weight))
        a, b, weight = a[order], b[order], weight[order]
        part, sure = sure_joins(a, b, weight, safe)
        trial = pdf["trial"].iloc[0]
        points = pd.DataFrame({"trial": trial, "kind": POINT, "a": ids, "u": ids[part], "weight": safe})
        points = points.join(pdf[["p", "core", "level", "cell"]])
        left_over = part[a] != part[b]
        use = sure | left_over
        edges = pd.DataFrame(
            {
                "trial": trial, "kind": np.where(sure, SURE, OPEN)[use], "a": ids[a[use]], "b": ids[b[use]],
                "u": ids[part[a[use]]], "v": ids[part[b[use]]], "weight": weight[use],
            }
        )
        both = pd.concat([points, edges.assign(p=None, cell=None)], ignore_index=True)
        return both[[c.split()[0] for c in LOCAL.split(", ")]].astype({"b": "Int64", "v": "Int64", "level": "Int32"})

    return run


def _distance(p: Column, q: Column, dim: int) -> Column:
    total = F.lit(0.0)
    for i in range(dim):
        total = total + (p[i] - q[i]) * (p[i] - q[i])
    return F.sqrt(total)


def _links_over_cells(points: DataFrame, dim: int) -> DataFrame:
    """Edges that join all leaves: from a point of each cell to a point of the cell above it."""
    reps = points.groupBy(*LEAF).agg(F.min(F.struct("core", "id", "p", "part")).alias("r"))
    lineage = reps.select("trial", "r", "level", "cell", F.explode(F.sequence(F.lit(0), "level")).alias("at"))
    cells = settle(
        lineage.groupBy("trial", "at", parent(F.col("cell"), F.col("level") - F.col("at")).alias("key")).agg(F.min("r").alias("r")),
        "cells",
    )
    below = cells.where("at > 0").select("trial", (F.col("at") - 1).alias("at"), parent(F.col("key"), 1).alias("key"), F.col("r").alias("s"))
    both = below.join(cells, ["trial", "at", "key"]).where("r.part <> s.part")
    first, second = F.when(F.col("r.id") < F.col("s.id"), F.col("r")), F.when(F.col("r.id") < F.col("s.id"), F.col("s"))
    both = both.select("trial", first.otherwise(F.col("s")).alias("x"), second.otherwise(F.col("r")).alias("y"))
    weight = F.greatest("x.core", "y.core", _distance(F.col("x.p"), F.col("y.p"), dim))
    return both.select("trial", F.col("x.part").alias("u"), F.col("y.part").alias("v"), weight.alias("weight"), F.col("x.id").alias("a"), F.col("y.id").alias("b"))


def _lightest(leaf: pd.DataFrame, callers: pd.DataFrame) -> pd.DataFrame:
    """For each component that calls, its lightest edge below the callers' radius to another component of the leaf."""
    best: dict[int, tuple] = {}
    leaf = leaf[leaf["core"] < callers["r"].max()] if len(callers) else leaf
    if len(leaf) and len(callers):
        b = Buckets(coordinates(leaf))
        ids, core, comp = b.padded(leaf["id"].to_numpy(), -1), b.padded(leaf["core"].to_numpy(), np.inf), b.padded(leaf["comp"].to_numpy(), -1)
        ids, core, comp = (x.reshape(b.count, b.size) for x in (ids, core, comp))
        callers = callers.iloc[bucket_order(coordinates(callers))]
        q, names = coordinates(callers), callers["qid"].to_numpy()
        components, own = np.unique(callers["comp"].to_numpy(), return_inverse=True)
        own_core, r = callers["core"].to_numpy(), callers["r"].to_numpy()
        limit = np.full(len(components), np.inf)  # what a component's next edge weighs at most
        for low in range(0, len(q), BUCKET):
            rows = np.arange(low, min(low + BUCKET, len(q)))
            within = np.minimum(r[rows], np.nextafter(limit[own[rows]], np.inf))
            rows, within = rows[own_core[rows] < within], within[own_core[rows] < within]
            if not len(rows):
                continue
            taken = np.flatnonzero(b.near(q[rows].min(axis=0), q[rows].max(axis=0)) < within.max())
            if not len(taken):
                continue
            reach = np.maximum(b.distances(q[rows], taken), core[taken].reshape(1, -1))
            np.maximum(reach, own_core[rows, None], out=reach)
            reach[components[own[rows], None] == comp[taken].reshape(1, -1)] = np.inf
            least, near_ids, near_comp = reach.min(axis=1), ids[taken].ravel(), comp[taken].ravel()
            for i in np.flatnonzero(least < within).tolist():
                at = np.flatnonzero(reach[i] == least[i])
                x = int(names[rows[i]])
                u, v = np.minimum(near_ids[at], x), np.maximum(near_ids[at], x)
                k = np.lexsort((v, u))[0]
                edge = (float(least[i]), int(u[k]), int(v[k]), int(near_comp[at[k]]))
                c = int(own[rows[i]])
                if c not in best or edge < best[c]:
                    best[c], limit[c] = edge, edge[0]
    trial = int(callers["trial"].iloc[0]) if len(callers) else 0
    rows = [(trial, int(components[c]), e[3], e[0], e[1], e[2]) for c, e in best.items()]
    return pd.DataFrame(rows, columns=["trial", "u", "v", "weight", "a", "b"])


def _look_up(queries: DataFrame, leaves: Leaves, points: DataFrame, leaf_parts: DataFrame, parts: DataFrame, callers: int) -> DataFrame:
    """Edges (trial, u, v, weight, a, b): for each calling component u the lightest one that a query has below its radius in another leaf."""
    balls = queries.select(
        F.struct("trial", "id").alias("id"), "p", "r", "trial", "comp", "core", F.col("id").alias("qid"),
        F.col("level").alias("own_level"), F.col("cell").alias("own_cell"),
    )
    members = parts.select("trial", "part", "comp")
    state = leaf_parts.join(members, ["trial", "part"]).groupBy(*LEAF).agg(
        F.min("comp").alias("first"), F.max("comp").alias("last"), F.min("core").alias("least")
    )
    calls = visits(balls, leaves).where((F.col("level") != F.col("own_level")) | (F.to_json("cell") != F.to_json("own_cell")))
    calls = calls.join(state, LEAF).where("least < r and (first <> last or first <> comp)")
    calls = settle(calls.select(*LEAF, "qid", "p", "core", "comp", "r"), "calls")
    salts = calls.groupBy(*LEAF).agg(F.ceil(F.count("*") / callers).alias("salts"))
    dealt = calls.join(salts, LEAF).withColumn("salt", F.pmod(F.xxhash64("qid"), "salts"))
    copies = salts.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1))).drop("salts")
    visited = points.join(copies, LEAF).join(members, ["trial", "part"]).select(*LEAF, "salt", "id", "p", "core", "comp")
    found = visited.groupBy(*LEAF, "salt").cogroup(dealt.drop("salts").groupBy(*LEAF, "salt")).applyInPandas(_lightest, FOUND)
    edge = F.min(F.struct("weight", "a", "b", "v")).alias("e")
    return settle(
        found.groupBy("trial", "u").agg(edge).select("trial", "u", "e.v", "e.weight", "e.a", "e.b"), "found"
    )


def spanning_tree(points: DataFrame, leaves: Leaves, callers: int = CALLERS) -> DataFrame:
    """Edges (trial, a, b, weight) of the spanning tree of (trial, id, p, core, level, cell), for all trials at once.

    Points with an infinite core distance are left out.
    """
    local = dealt(points, *LEAF).groupBy(*LEAF).applyInPandas(_parts_of_leaf(leaves.low, leaves.extent), LOCAL)
    local = settle(local, "local")
    sure = local.where(F.col("kind") == SURE).select("trial", "a", "b", "weight")
    placed = local.where(F.col("kind") == POINT).select(
        "trial", F.col("a").alias("id"), "p", "core", "level", "cell", F.col("u").alias("part"), F.col("weight").alias("safe")
    )
    parts = settle(
        placed.groupBy("trial", "part").agg(F.min("safe").alias("safe")).select("trial", "part", "safe", F.col("part").alias("comp"), F.lit(0.0).alias("floor")),
        "parts",
    )
    leaf_parts = settle(placed.groupBy(*LEAF, "part").agg(F.min("core").alias("core")), "leaf parts")
    columns = ["trial", "u", "v", "weight", "a", "b"]
    live = settle(local.where(F.col("kind") == OPEN).select(*columns).union(_links_over_cells(placed, leaves.dim)), "live")
    taken = [sure]
    low = F.greatest("safe", "floor")
    while live.limit(1).count():
        ends = live.select("trial", F.col("u").alias("comp"), "weight").union(live.select("trial", F.col("v").alias("comp"), "weight"))
        bounds = parts.groupBy("trial", "comp").agg(F.min(low).alias("bound"))
        doubtful = ends.groupBy("trial", "comp").agg(F.min("weight").alias("r")).join(bounds, ["trial", "comp"])
        doubtful = settle(doubtful.where("r > bound").select("trial", "comp", "r"), "doubtful")
        if doubtful.limit(1).count():
            who = parts.select("trial", "part", "comp", "floor").join(doubtful, ["trial", "comp"])
            members = settle(
                placed.join(who, ["trial", "part"]).withColumn("low", low).where("low < r")
                .select("trial", "comp", "low", "id", "p", "core", "level", "cell", "r"),
                "members",
            )
            # One point of each component first, which bounds how far the others look.
            whole = F.struct("low", "id", "p", "core", "level", "cell", "r")
            one = members.groupBy("trial", "comp").agg(F.min(whole).alias("m")).select("trial", "comp", "m.*")
            near = _look_up(one, leaves, placed, leaf_parts, parts, callers)
            tighter = near.select("trial", F.col("u").alias("comp"), F.col("weight").alias("w"))
            rest = members.join(tighter, ["trial", "comp"], "left").withColumn("r", F.least("r", "w")).where("low < r")
            found = _look_up(rest, leaves, placed, leaf_parts, parts, callers)
            live = settle(live.select(*columns).union(near.select(*columns)).union(found.select(*columns)), "live")
        best, root = choose_lightest(live)
        taken.append(best.select("trial", "a", "b", "weight").distinct())
        lightest = best.select("trial", F.col("node").alias("comp"), "weight")
        moved = root.select("trial", F.col("node").alias("comp"), F.col("parent").alias("root"))
        parts = settle(
            parts.join(lightest, ["trial", "comp"], "left").join(moved, ["trial", "comp"], "left").select(
                "trial", "part", "safe", F.coalesce("root", "comp").alias("comp"),
                F.greatest("floor", F.coalesce("weight", F.lit(0.0))).alias("floor"),
            ),
            "parts",
        )
        live = contract(live, root)
    tree = taken[0]
    for more in taken[1:]:
        tree = tree.union(more)
    return settle(tree, "tree")
