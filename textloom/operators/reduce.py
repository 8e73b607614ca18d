"""Dimension reduction: principal components, and a neighbour-graph layout.

The layout follows McInnes, Healy and Melville (2018) with batch gradients: an
epoch is a join of the edge table with the positions and one aggregate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import settle
from .descent import NEIGHBOURS, refine_neighbours
from .knn import CHUNK, distances
from .sample import SEED
from .spectral import spectral_start

BLOCK_ROWS = 2048
PROJECTIONS = 6
SIGMA_STEPS = 40
REPELLERS = 64
EPOCHS = 30


def attach_dims(df: DataFrame, dims: DataFrame, key: str = "doc_id") -> DataFrame:
    """Brings ``Dim*`` columns of another table to the rows by key."""
    return df.join(dims, key)


def dim_columns(k: int) -> list[str]:
    return [f"Dim{i}" for i in range(k)]


def reduce_pca(df: DataFrame, n_components: int = 3, vector_col: str = "embeddings") -> DataFrame:
    """Adds Dim0.. with the first principal components.  Fitting is one aggregate."""
    vectors = df.withColumn("_v", array_to_vector(vector_col))
    model = PCA(k=n_components, inputCol="_v", outputCol="_pc").fit(vectors.select("_v"))
    parts = model.transform(vectors).withColumn("_a", vector_to_array("_pc"))
    return parts.select(
        *df.columns, *[F.col("_a")[i].alias(c) for i, c in enumerate(dim_columns(n_components))]
    )


def _block_neighbours(ids: np.ndarray, v: np.ndarray, k: int) -> pd.DataFrame:
    """Entries (id, to, d) of the k nearest in the block, as plain numbers."""
    far, to = [], []
    for start in range(0, len(ids), CHUNK):
        q = v[start : start + CHUNK]
        d = np.sqrt(np.maximum((q**2).sum(1)[:, None] + (v**2).sum(1)[None] - 2 * q @ v.T, 0))
        rows = np.arange(len(q))
        d[rows, start + rows] = np.inf
        m = min(k, len(ids) - 1)
        near = np.argpartition(d, m - 1, axis=1)[:, :m] if m > 0 else np.zeros((len(q), 0), int)
        far.append(np.take_along_axis(d, near, axis=1).ravel())
        to.append(ids[near].ravel())
    each = min(k, len(ids) - 1)
    return pd.DataFrame({"id": np.repeat(ids, each), "to": np.concatenate(to), "d": np.concatenate(far)})


def vector_neighbours(
    df: DataFrame, k: int, vector_col: str = "embeddings", key: str = "doc_id",
    projections: int = PROJECTIONS, block_rows: int = BLOCK_ROWS, seed: int = SEED,
) -> DataFrame:
    """Nearest neighbours (id, nbrs) of vectors in many dimensions, approximately.

    Rows are ranked along a few random directions and compared inside blocks of that order
    with borders at fixed ranks, each overlapping the next by half.  Work grows with rows
    times ``block_rows`` whatever the data, since equal vectors spread over blocks by their
    key.  A table that fits one block is exact; for larger ones the neighbours of neighbours are
    compared in rounds until few entries change.  The answer does not depend on partitions.
    """
    width = df.select(F.size(vector_col)).first()[0]
    lines = np.random.default_rng(seed).standard_normal((projections, width))
    step = max(1, block_rows // 2)

    def along(direction: np.ndarray) -> Column:
        weights = F.array(*[F.lit(float(x)) for x in direction])
        return F.aggregate(
            F.zip_with(vector_col, weights, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x
        )

    spread = df.select(
        F.col(key).alias("id"), F.posexplode(F.array(*[along(line) for line in lines])).alias("line", "at")
    )
    ordered = spread.repartitionByRange("line", "at", "id").sortWithinPartitions("line", "at", "id")

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, met = TaskContext.get().partitionId(), {}
        for batch in batches:
            batch["part"] = part
            batch["pos"] = batch.groupby("line").cumcount() + batch["line"].map(met).fillna(0).astype("int64")
            for line, n in batch["line"].value_counts().items():
                met[line] = met.get(line, 0) + n
            yield batch[["id", "line", "part", "pos"]]

    numbered = settle(ordered.mapInPandas(number, "id bigint, line int, part int, pos bigint"), "numbered")
    before = Window.partitionBy("line").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = numbered.groupBy("line", "part").agg(F.count("*").alias("n"))
    sizes = sizes.select("line", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    home = F.floor((F.col("before") + F.col("pos")) / step)
    blocks = numbered.join(sizes, ["line", "part"]).select("id", "line", F.explode(F.array(home, home - 1)).alias("block"))
    vectors = df.select(F.col(key).alias("id"), F.col(vector_col).alias("v"))

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id")
        return _block_neighbours(rows["id"].to_numpy(), np.stack(rows["v"].to_numpy()).astype(float), k)

    found = blocks.join(vectors, "id").groupBy("line", "block").applyInPandas(compare, "id bigint, to bigint, d double")
    near = found.groupBy("id", "to").agg(F.min("d").alias("d"))
    merged = near.groupBy("id").agg(F.collect_list(F.struct("d", F.col("to").alias("id"))).alias("nbrs"))
    alone = F.array().cast(NEIGHBOURS)
    lists = vectors.select("id").distinct().join(merged, "id", "left").select(
        "id", F.slice(F.array_sort(F.coalesce("nbrs", alone)), 1, k).alias("nbrs")
    )
    if df.limit(block_rows + 1).count() <= block_rows:
        return lists
    narrow = vectors.select("id", F.col("v").cast("array<float>").alias("v")).dropDuplicates(["id"])
    return refine_neighbours(settle(lists, "rough neighbours"), narrow, k, seed=seed)


def fuzzy_graph(lists: DataFrame, k: int) -> DataFrame:
    """Edges (a, b, weight), a < b, of the fuzzy union of local neighbourhoods.

    Each point scales distances so that its weights sum to log2(k): the nearest
    neighbour has weight 1, and the scale is found by bisection.
    """
    near = lists.select(
        "id", "nbrs", F.transform("nbrs", lambda n: n["d"]).alias("ds")
    ).withColumn("rho", F.array_min("ds"))

    def weight(d: Column, sigma: Column) -> Column:
        return F.exp(-F.greatest(F.lit(0.0), d - F.col("rho")) / sigma)

    def step(acc: Column, _: Column) -> Column:
        total = F.aggregate("ds", F.lit(0.0), lambda s, d: s + weight(d, acc["mid"]))
        high = total > F.log2(F.lit(float(k)))
        lo = F.when(high, acc["lo"]).otherwise(acc["mid"])
        hi = F.when(high, acc["mid"]).otherwise(acc["hi"])
        mid = F.when(hi == float("inf"), acc["mid"] * 2).otherwise((lo + hi) / 2)
        return F.struct(lo.alias("lo"), hi.alias("hi"), mid.alias("mid"))

    begin = F.struct(F.lit(0.0).alias("lo"), F.lit(float("inf")).alias("hi"), F.lit(1.0).alias("mid"))
    scaled = near.withColumn(
        "sigma", F.aggregate(F.sequence(F.lit(1), F.lit(SIGMA_STEPS)), begin, step)["mid"]
    )
    arrows = scaled.select("id", "rho", "sigma", F.explode("nbrs").alias("n")).select(
        F.least("id", "n.id").alias("a"), F.greatest("id", "n.id").alias("b"),
        weight(F.col("n.d"), F.col("sigma")).alias("w"),
    )
    both = F.when(F.count("*") == 2, F.min("w") * F.max("w")).otherwise(0.0)
    return arrows.groupBy("a", "b").agg((F.sum("w") - both).alias("weight"))


def curve(min_dist: float, spread: float = 1.0) -> tuple[float, float]:
    """The a and b for which 1 / (1 + a d^2b) is closest to the wanted fall-off."""
    x = np.linspace(0, 3 * spread, 300)[1:]
    wanted = np.where(x < min_dist, 1.0, np.exp(-(x - min_dist) / spread))
    a, b, width = 1.5, 1.0, 1.0
    for _ in range(30):
        grid = [(a + i * width / 8, b + j * width / 16) for i in range(-8, 9) for j in range(-8, 9)]
        grid = [(p, q) for p, q in grid if p > 0 and q > 0]
        a, b = min(grid, key=lambda g: ((1 / (1 + g[0] * x ** (2 * g[1])) - wanted) ** 2).sum())
        width *= 0.7
    return a, b


def layout(
    start: DataFrame, edges: DataFrame, n_components: int, min_dist: float = 0.1,
    epochs: int = EPOCHS, seed: int = SEED,
) -> DataFrame:
    """Positions (id, Dim0..) after pulling along edges and pushing off random rows.

    In each epoch every row pushes off about REPELLERS random rows of the whole table,
    other ones for other rows.  Positions are written to a table after each epoch, so a
    lost executor costs one epoch.
    """
    dims = dim_columns(n_components)
    a, b = curve(min_dist)
    ways = edges.select(F.col("a").alias("id"), F.col("b").alias("to"), "weight").union(
        edges.select(F.col("b").alias("id"), F.col("a").alias("to"), "weight")
    )
    ways = settle(ways.repartition("to"), "edges")
    at = settle(start.select("id", *dims), "positions")
    groups = max(1, at.count() // REPELLERS)
    for epoch in range(epochs):
        rate = 1.0 - epoch / epochs
        # Each epoch deals the rows into new random groups; a row pushes off its own group.
        drawn = at.withColumn("_g", F.pmod(F.xxhash64(F.lit(seed), F.lit(epoch), "id"), F.lit(groups)))
        others = drawn.groupBy("_g").agg(F.sort_array(F.collect_list(F.array(*dims))).alias("_far"))
        there = at.select(F.col("id").alias("to"), *[F.col(c).alias(f"_{c}") for c in dims])
        gaps = [F.col(c) - F.col(f"_{c}") for c in dims]
        d2 = sum((g * g for g in gaps[1:]), gaps[0] * gaps[0])
        pull = (
            F.when(d2 > 0, 2 * a * b * F.pow(d2, b - 1) / (1 + a * F.pow(d2, F.lit(b))))
            .otherwise(0.0) * F.col("weight")
        )
        pulled = (
            ways.join(there, "to").join(at, "id")
            .groupBy("id")
            .agg(*[F.sum(-pull * g).alias(f"pull{i}") for i, g in enumerate(gaps)], F.sum("weight").alias("pulls"))
        )

        def push(i: int) -> Column:
            def one(s: Column, o: Column) -> Column:
                ds = [F.col(c) - o[j] for j, c in enumerate(dims)]
                q = sum((d * d for d in ds[1:]), ds[0] * ds[0])
                return s + 2 * b * ds[i] / ((0.001 + q) * (1 + a * F.pow(q, F.lit(b))))

            return F.aggregate("_far", F.lit(0.0), one) / F.size("_far")

        share = 1 / F.nullif(F.col("pulls"), F.lit(0.0))
        moved = drawn.join(pulled, "id", "left").join(others, "_g").select(
            "id",
            *[
                (
                    F.col(c)
                    + rate * F.greatest(F.lit(-4.0), F.least(F.lit(4.0),
                        F.coalesce(F.col(f"pull{i}") * share, F.lit(0.0)) + push(i)))
                ).alias(c)
                for i, c in enumerate(dims)
            ],
        )
        at = settle(moved, "positions")
    return at


def reduce_umap(
    df: DataFrame, n_components: int = 3, n_neighbors: int = 15, min_dist: float = 0.1,
    vector_col: str = "embeddings", key: str = "doc_id", epochs: int = EPOCHS, seed: int = SEED, start: str = "pca",
) -> DataFrame:
    """Adds Dim0.. from a neighbour-graph layout.

    It starts at the principal components, or with ``start='spectral'`` at the graph's smoothest coordinates.
    """
    dims = dim_columns(n_components)
    lists = settle(vector_neighbours(df, n_neighbors, vector_col, key, seed=seed), "neighbours")
    edges = settle(fuzzy_graph(lists, n_neighbors), "graph")
    if start == "pca":
        rows = reduce_pca(df.select(F.col(key).alias("id"), vector_col), n_components, vector_col).select("id", *dims)
    elif start == "spectral":
        rows, _ = spectral_start(edges, df.select(F.col(key).alias("id")), n_components, seed=seed)
    else:
        raise ValueError(f"unknown start {start}")
    rows = settle(rows, "start")
    spread = rows.agg(*[F.stddev(c).alias(c) for c in dims]).first()
    # A little noise parts rows that start at one place.
    noise = [F.xxhash64(F.lit(seed), F.lit(i), "id") / 2.0**63 * (1e-3 if start == "spectral" else 0.0) for i in range(n_components)]
    first = rows.select("id", *[(F.col(c) / (spread[c] or 1.0) * 5 + e).alias(c) for c, e in zip(dims, noise)])
    placed = layout(first, edges, n_components, min_dist, epochs, seed)
    return attach_dims(df, placed.withColumnRenamed("id", key), key)


def reduce_dimensions(
    df: DataFrame, n_components: int = 3, method: str = "pca", vector_col: str = "embeddings",
    key: str = "doc_id", **options,
) -> DataFrame:
    if method == "pca":
        return reduce_pca(df, n_components, vector_col)
    if method == "umap":
        return reduce_umap(df, n_components, vector_col=vector_col, key=key, **options)
    raise ValueError(f"unknown method {method}")
