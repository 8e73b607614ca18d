"""The spanning tree over many leaves against all pairs, and contraction in groups against one group."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textloom.operators import buckets, condense, density, knn, reach, space
from textloom.sources.scratch import settle


def blobs(seed, rows=100, spread=0.5, noise=40):
    rng = np.random.default_rng(seed)
    return np.concatenate([c + rng.normal(0, spread, (rows, 2)) for c in rng.uniform(0, 10, (4, 2))] + [rng.uniform(-5, 15, (noise, 2))])


def outlier(seed):
    rng = np.random.default_rng(seed)
    return np.concatenate([rng.uniform(0, 1, (250, 3)), rng.uniform(50, 51, (150, 3)), [[500.0, 500.0, 500.0]]])


def lattice(n):
    return np.stack(np.meshgrid(np.arange(float(n)), np.arange(float(n))), -1).reshape(-1, 2)


def weights_of_all_pairs(p, min_samples):
    core = np.sort(knn.distances(p, p), axis=1)[:, min_samples]
    return np.sort(reach.leaf_tree(p, core)[2])


@pytest.mark.parametrize(
    "p, samples, leaf_rows, callers",
    [(blobs(1, 60, noise=30), [5, 3], 60, 1 << 16), (outlier(2), [4], 70, 20), (lattice(15), [4], 40, 7)],
)
def test_tree_of_all_pairs(spark, p, samples, leaf_rows, callers):
    df = spark.createDataFrame([(i, [float(x) for x in r], 1) for i, r in enumerate(p)], "id long, p array<double>, w long")
    leaves = space.into_leaves(df, leaf_rows)
    assert leaves.points.select("level", "cell").distinct().count() > 4
    pairs = F.explode(F.transform("cores", lambda core, i: F.struct(i.alias("trial"), core.alias("core")))).alias("t")
    points = settle(knn.core_distances(leaves, samples).select("*", pairs).select("t.trial", "id", "p", "w", "t.core", "level", "cell"))
    tree = reach.spanning_tree(points, leaves, callers).toPandas()
    for i, ms in enumerate(samples):
        own = tree[tree.trial == i]
        assert len(own) == len(p) - 1
        np.testing.assert_allclose(np.sort(own.weight), weights_of_all_pairs(p, ms), atol=1e-12)


@pytest.mark.parametrize("dim, samples, whole", [(2, 5, True), (2, 60, False), (3, 4, False), (1, 3, True)])
def test_tree_from_buckets_is_that_of_all_pairs(dim, samples, whole):
    rng = np.random.default_rng(dim + samples)
    p = rng.normal(0, 1, (900, dim)) + 4 * rng.integers(0, 3, (900, 1))
    p = np.unique(p if whole else np.round(p, 2), axis=0)
    core = np.sort(knn.distances(p, p), axis=1)[:, samples]
    want = np.sort(reach.leaf_tree(p, core)[2])
    for size in (4, 64):
        a, b, weight = buckets.spanning_edges(p, core, size)
        assert (np.sort(weight) == want).all() and len(set(zip(a.tolist(), b.tolist()))) == len(p) - 1
        np.testing.assert_allclose(weight, np.maximum(np.linalg.norm(p[a] - p[b], axis=1), np.maximum(core[a], core[b])))
    core[::9] = np.inf
    assert len(buckets.spanning_edges(p, core)[2]) == np.isfinite(core).sum() - 1


def test_a_leaf_looks_at_few_of_its_pairs(monkeypatch):
    p = np.random.default_rng(2).uniform(0, 1, (6000, 2))
    looked, plain = [], buckets.Buckets.distances

    def counted(self, q, taken):
        looked.append(len(q) * len(taken) * self.size)
        return plain(self, q, taken)

    monkeypatch.setattr(buckets.Buckets, "distances", counted)
    ids = np.arange(len(p))
    table = pa.table({"id": ids, "p": list(p), "w": np.ones(len(p), np.int64), "level": ids * 0, "cell": list(np.zeros((len(p), 2), int))})
    found = knn._leaf_cores(20)(table)
    core = np.array([ds[19] for _, ds in sorted(zip(found["id"].to_pylist(), found["ds"].to_pylist()))])
    near = np.sort(knn.distances(p[:50], p), axis=1)[:, 20]
    np.testing.assert_allclose(core[:50], near)
    reach.leaf_tree(p, core)
    assert 0 < sum(looked) < len(p) ** 2 / 3


def test_sure_joins_are_in_the_tree():
    # Two pairs with a border near the second one: its own join is not sure.
    a, b, weight = np.array([0, 2, 1]), np.array([1, 3, 2]), np.array([1.0, 1.5, 9.0])
    part, sure = reach.sure_joins(a, b, weight, np.array([5.0, 5.0, 1.2, 1.2]))
    assert sure.tolist() == [True, False, False] and part.tolist() == [0, 0, 2, 3]


@pytest.mark.parametrize(
    "p, size, samples, epsilon, group_rows, width, weighted",
    [
        (blobs(3), 5, 3, 0.0, 120, 2.0, False),
        (blobs(4), 8, 4, 0.6, 100, 2.0, False),
        (blobs(5, 60), 10, 4, 0.0, 70, None, True),
        (np.concatenate([lattice(12), lattice(12) + 100, lattice(6) * 0.5 + 300]), 5, 4, 0.0, 50, 10.0, False),
    ],
)
def test_groups_give_the_clusters_of_one(spark, p, size, samples, epsilon, group_rows, width, weighted):
    n = len(p)
    core = np.sort(knn.distances(p, p), axis=1)[:, samples]
    a, b, weight = reach.leaf_tree(p, core)
    rows = np.random.default_rng(1).integers(1, 20, n) if weighted else np.ones(n, np.int64)
    points, edges = pd.DataFrame({"id": np.arange(n), "w": rows}), pd.DataFrame({"a": a, "b": b, "weight": weight})
    want = density._condense(size, epsilon, points, edges).set_index("id").clust_id.sort_index()
    assert want.max() > 0
    places = None
    if width:
        cells = np.floor(p / width).astype(int)
        places = spark.createDataFrame(pd.DataFrame({"id": np.arange(n), "key": cells[:, 0] * 1000 + cells[:, 1]}))
    got = condense.condense(spark.createDataFrame(points), spark.createDataFrame(edges), size, epsilon, places, group_rows)
    got = got.toPandas().set_index("id").sort_index()
    assert got.clust_id.tolist() == want.tolist() and got.w.tolist() == rows.tolist()


def test_nothing_to_join(spark):
    points = spark.createDataFrame([(1, 3), (2, 20), (3, 1)], "id long, w long")
    edges = spark.createDataFrame([], "a long, b long, weight double")
    assert [r.clust_id for r in condense.condense(points, edges, 5).orderBy("id").collect()] == [-1, -1, -1]
    assert condense.condense(points.limit(0), edges, 5).collect() == []
    two = spark.createDataFrame([(1, 7), (2, 20), (3, 1)], "id long, w long")
    assert [r.clust_id for r in condense.condense(two, edges, 5).orderBy("id").collect()] == [0, 1, -1]


def test_six_blobs_at_any_setting(spark):
    rng = np.random.default_rng(7)
    centres = np.array([[0, 0], [10, 0], [0, 10], [10, 10], [20, 0], [20, 10]], float)
    p = np.concatenate([c + rng.normal(0, 0.7, (500, 2)) for c in centres])
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(p)], "doc_id long, x double, y double")
    whole = density.hdbscan(df, ["x", "y"], 50, 10).select("doc_id", "clust_id").toPandas().sort_values("doc_id")
    assert whole.clust_id.max() == 5 and (whole.clust_id < 0).mean() < 0.2
    parts = density.hdbscan(df, ["x", "y"], 50, 10, leaf_rows=400, group_rows=500).select("doc_id", "clust_id").toPandas().sort_values("doc_id")
    assert parts.clust_id.tolist() == whole.clust_id.tolist()
