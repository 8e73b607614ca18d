"""Neighbours and density work over many cells against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.operators import density, knn, space


def brute(points, k):
    ids = np.array([i for i, _, _ in points])
    p = np.array([q for _, q, _ in points])
    d = knn.distances(p, p)
    np.fill_diagonal(d, np.inf)
    return {
        int(ids[i]): [(int(ids[j]), d[i, j]) for j in np.lexsort((ids, d[i]))[:k]] for i in range(len(ids))
    }


@pytest.fixture(scope="module")
def uneven(spark):
    """A dense spot beside lone points, in two and in three dimensions."""
    rng = np.random.default_rng(3)
    tables = {}
    for dim in (2, 3):
        p = np.concatenate([rng.normal(0, 0.01, (260, dim)), rng.uniform(-5, 5, (90, dim)), [[40.0] * dim]])
        rows = [(i, [float(x) for x in q], 1) for i, q in enumerate(p)]
        tables[dim] = (rows, spark.createDataFrame(rows, "id long, p array<double>, w long").cache())
    return tables


@pytest.mark.parametrize("dim", [2, 3])
def test_neighbours_over_many_leaves(uneven, dim):
    rows, table = uneven[dim]
    k = 5
    leaves = space.into_leaves(table, 20)
    assert not leaves.single
    assert leaves.points.groupBy("level", "cell").count().agg(F.max("count")).first()[0] <= 20
    got = {r.id: [(n.id, n.d) for n in r.nbrs] for r in knn.neighbour_lists(leaves, k).collect()}
    assert got == brute(rows, k)


def test_cores_with_copies(spark):
    rows = [(0, [0.0, 0.0], 4), (1, [1.0, 0.0], 1), (2, [3.0, 0.0], 2), (3, [9.0, 0.0], 1)]
    table = spark.createDataFrame(rows, "id long, p array<double>, w long")
    got = {r.id: r.cores for r in knn.core_distances(space.into_leaves(table), [1, 3, 4, 8]).collect()}
    inf = float("inf")
    assert got == {0: [0, 0, 1, inf], 1: [1, 1, 1, inf], 2: [0, 3, 3, inf], 3: [6, 8, 9, inf]}
    lists = space.into_leaves(table)
    listed = knn.neighbour_lists(lists, 3).select("id", knn.core_from_list(4).alias("c"))
    assert {r.id: r.c for r in listed.collect()} == {0: 1, 1: 1, 2: 3, 3: 9}


def components(points, eps, cores):
    kept = [i for i in range(len(points)) if cores[i] <= eps]
    label = {i: i for i in kept}
    d = knn.distances(np.array([points[i][1] for i in kept]), np.array([points[i][1] for i in kept]))
    changed = True
    while changed:
        changed = False
        for a, i in enumerate(kept):
            low = min(label[kept[b]] for b in np.flatnonzero(d[a] <= eps))
            if low < label[i]:
                label[i], changed = low, True
    return label


def test_density_cut_over_many_leaves(uneven):
    rows, table = uneven[2]
    cores = [n[-1][1] for _, n in sorted(brute(rows, 4).items())]
    for eps in (0.004, 0.8):
        got = {r.id: r.component for r in density.density_cut(table, 4, eps, leaf_rows=20).collect()}
        assert got == components(rows, eps, cores)


def test_visits_neither_shuffle_nor_repeat(spark):
    """Queries of one high cell do not meet in one task, and each leaf that a ball touches comes once."""
    p = np.random.default_rng(6).uniform(0, 1, (400, 2)) ** 2
    rows = [(i, [float(x) for x in r], 1, float(0.4 * (i % 7) / 7)) for i, r in enumerate(p)]
    df = spark.createDataFrame(rows, "id long, p array<double>, w long, r double")
    leaves = space.into_leaves(df.drop("r"), 20)
    got = space.visits(df.select("id", "p", "r"), leaves)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "Aggregate" not in plan
    sizes = leaves.sizes.select("level", "cell")
    near = leaves.gap(F.col("p"), F.col("level"), F.col("cell")) <= F.col("r") * (1 + 1e-9)
    want = df.crossJoin(sizes).where(near).select("id", "level", "cell").collect()
    assert sorted(got.select("id", "level", "cell").collect()) == sorted(want)
