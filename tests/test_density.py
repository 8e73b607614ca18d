"""The hierarchy against a plain restatement, planted blobs, binning and the search."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textloom.operators import density, knn, search, space
from textloom.plans import fixtures as fx


def plain_hierarchy(p, min_size, min_samples):
    """Clusters by the definition: drop edges from the heaviest down and look at the parts."""
    n = len(p)
    d = knn.distances(p, p)
    core = np.sort(d, axis=1)[:, min_samples]
    reach = np.maximum(d, np.maximum(core[:, None], core[None]))

    def parts(points, limit):
        left, out = set(points), []
        while left:
            todo, part = [left.pop()], []
            while todo:
                i = todo.pop()
                part.append(i)
                near = [j for j in left if reach[i, j] < limit]
                left.difference_update(near)
                todo += near
            out.append(sorted(part))
        return out

    def grow(points, born):
        """(stability, chosen clusters) of the cluster that starts with these points."""
        own, now, inside = 0.0, points, np.unique(reach[np.ix_(points, points)])[::-1]
        for limit in inside:
            split = parts(now, limit)
            if len(split) == 1:
                continue
            big = [s for s in split if len(s) >= min_size]
            gone = len(now) - sum(map(len, big)) if len(big) == 1 else len(now)
            own += gone * (1 / limit - born)
            if len(big) == 1:
                now = big[0]
                continue
            below = [grow(s, 1 / limit) for s in big]
            if below and sum(b for b, _ in below) > own:
                return sum(b for b, _ in below), [c for _, cs in below for c in cs]
            return own, [points]
        return own, [points]

    now = list(range(n))
    for limit in np.unique(reach)[::-1]:
        big = [s for s in parts(now, limit) if len(s) >= min_size]
        if len(big) == 1:
            now = big[0]
        elif len(big) > 1:
            chosen = [c for s in big for c in grow(s, 1 / limit)[1]]
            break
        else:
            return [-1] * n
    else:
        return [-1] * n
    labels = [-1] * n
    for i, c in enumerate(sorted(chosen)):
        for j in c:
            labels[j] = i
    return labels


@pytest.mark.parametrize("seed, min_size, min_samples", [(1, 5, 5), (2, 4, 2), (3, 8, 4), (4, 5, 3)])
def test_same_as_the_definition(spark, seed, min_size, min_samples):
    rng = np.random.default_rng(seed)
    centres = rng.uniform(0, 10, (4, 2))
    p = np.concatenate([c + rng.normal(0, 0.6, (15, 2)) for c in centres] + [rng.uniform(-2, 12, (12, 2))])
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(p)], "doc_id long, x double, y double")
    got = density.hdbscan(df, ["x", "y"], min_size, min_samples).orderBy("doc_id").collect()
    assert [r.clust_id for r in got] == plain_hierarchy(p, min_size, min_samples)


@pytest.fixture(scope="module")
def pts(spark):
    return fx.in_spark(spark, "/root/testdata/sf0.01", fx.PTS)


def purity(df):
    """Rows in the main blob of their cluster, over all clustered rows."""
    blob = F.concat(F.round(F.col("x") / 10), F.lit(":"), F.round(F.col("y") / 10))
    counts = df.where("clust_id >= 0").groupBy("clust_id", blob.alias("b")).count()
    best = counts.groupBy("clust_id").agg(F.max("count").alias("m"), F.sum("count").alias("n"))
    r = best.agg(F.sum("m").alias("m"), F.sum("n").alias("n"), F.count("*").alias("k")).first()
    return r.m / r.n, r.k


def test_planted_blobs_over_leaves_and_groups(pts):
    exact = density.hdbscan(pts, ["x", "y"], 15, key="id").select("id", "x", "y", "clust_id").cache()
    share, k = purity(exact)
    assert k == 10 and share > 0.97
    sizes = [r["count"] for r in exact.where("clust_id >= 0").groupBy("clust_id").count().collect()]
    assert min(sizes) >= 15 and exact.count() == 500
    many = density.hdbscan(pts, ["x", "y"], 15, key="id", leaf_rows=60, group_rows=90).select("id", "clust_id")
    assert exact.join(many, ["id", "clust_id"]).count() == 500


def test_copies_of_one_row_count(pts):
    copies = pts.where("id = 5").select(F.explode(F.sequence(F.lit(10_000), F.lit(10_250))).alias("id"), "x", "y")
    got = density.hdbscan(pts.union(copies), ["x", "y"], 15, key="id")
    assert got.count() == 751
    assert got.where("id >= 10000").select("clust_id").distinct().count() == 1
    assert got.where("id >= 10000 and clust_id = -1").count() == 0


def test_epsilon_stops_splits(pts):
    fine = density.hdbscan(pts, ["x", "y"], 5, 3, key="id").agg(F.max("clust_id")).first()[0]
    coarse = density.hdbscan(pts, ["x", "y"], 5, 3, epsilon=12.0, key="id").agg(F.max("clust_id")).first()[0]
    assert coarse < fine


def test_search(pts):
    found = search.cluster_search(pts, ["x", "y"], key="id")
    trials = found.trials.orderBy("trial").collect()
    assert [t.min_cluster_size for t in trials[:2]] == [514, 514] and trials[1].min_samples == 257
    assert all(t.n_outliers == 500 for t in trials[:2])
    assert found.rows.count() == 500 and found.rows.select("id").distinct().count() == 500
    best = found.chosen.first()
    assert best.n_clusters == found.rows.where("clust_id >= 0").select("clust_id").distinct().count()
    assert best.n_outliers == found.rows.where("clust_id = -1").count()


@pytest.mark.parametrize("leaf_rows", [40, 10_000])
def test_core_table(spark, leaf_rows):
    p = np.random.default_rng(4).uniform(0, 1, (120, 2))
    for weights in (np.ones(120, int), np.random.default_rng(5).integers(1, 4, 120)):
        rows = [(i, [float(x) for x in r], int(w)) for i, (r, w) in enumerate(zip(p, weights))]
        leaves = space.into_leaves(spark.createDataFrame(rows, "id long, p array<double>, w long"), leaf_rows)
        got = {r.id: r.cores for r in knn.core_table(leaves, 9).collect()}
        for ms in (1, 2, 5, 9):
            want = {r.id: r.cores[0] for r in knn.core_distances(leaves, [ms]).collect()}
            assert {i: c[ms - 1] for i, c in got.items()} == pytest.approx(want)
        some = {r.id: r.cores for r in knn.core_table(leaves, 9, [2, 9]).collect()}
        assert some == {i: [c[1], c[8]] for i, c in got.items()}


def trial_table(spark, rows):
    return spark.createDataFrame(
        [(i, 5, 5, n, 0, float(p)) for i, (n, p) in enumerate(rows)],
        "trial int, min_cluster_size int, min_samples int, n_clusters long, n_outliers long, pct_outliers double",
    )


@pytest.mark.parametrize(
    "rows, most, fewest",
    [
        ([(5, 10), (9, 20), (9, 25), (30, 26), (40, 0)], 1, 0),
        ([(5, 30), (12, 40), (20, 35)], 2, 2),
        ([(5, 30), (4, 40), (3, 30)], 0, 0),
        ([(50, 0), (60, 0)], 0, 0),
    ],
)
def test_choice(spark, rows, most, fewest):
    table = trial_table(spark, rows)
    assert search.choose_trial(table, 10).first().trial == most
    assert search.choose_trial(table, 10, prefer="fewest").first().trial == fewest


def test_bounds():
    sizes = [1, 100, 101, 1000, 1001, 10000, 10001]
    assert [search.search_bounds(n) for n in sizes] == [
        (5, 10), (5, 10), (10, 50), (10, 50), (20, 80), (20, 80), (50, 120)
    ]


def test_search_fits_several_steps_at_once(spark, monkeypatch):
    """A search that goes down by many steps makes few passes, and has the trials that single steps give."""
    rng = np.random.default_rng(3)
    rows = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.normal(0, 1, (150, 2)))]
    pts = spark.createDataFrame(rows, "id long, x double, y double")
    passes, plain = [], search.cluster_points

    def counted(leaves, settings, *more):
        passes.append(len(settings))
        return plain(leaves, settings, *more)

    monkeypatch.setattr(search, "cluster_points", counted)
    together = search.cluster_search(pts, ["x", "y"], key="id")
    n, together = len(passes), together.trials.collect()
    monkeypatch.setattr(search, "AHEAD", 1)
    assert together == search.cluster_search(pts, ["x", "y"], key="id").trials.collect()
    assert n < len(passes) - n == len(together) // 2


def test_leaf_cores_hold_no_object_for_each_neighbour():
    rng = np.random.default_rng(1)
    n, k = 1500, 500
    table = pa.table({
        "id": np.arange(n), "p": list(rng.normal(0, 1, (n, 2))), "w": np.ones(n, np.int64),
        "level": pa.array([1] * n, pa.int32()), "cell": pa.array([[0, 0]] * n, pa.list_(pa.int32())),
    })
    tracemalloc.start()
    out = knn._leaf_cores(k)(table)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out.num_rows == n and len(out.column("ds")[0]) == k
    assert most < 4 * 8 * n * k  # before: structs as dicts, some 300 bytes each
