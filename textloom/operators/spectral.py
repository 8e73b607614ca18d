"""Smoothest coordinates of a weighted graph: eigenvectors of its normalised Laplacian.

Block power iteration: a step joins the edge table with the positions and sums; the columns
are made orthonormal with the small matrix of their inner products.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import settle
from .sample import SEED

SPARE = 3  # columns more than wanted, which speed up the wanted ones
STEPS = 4  # between two orthonormal blocks
ROUNDS = 30
CHANGE = 1e-5


def _inner(rows: DataFrame, left: list[str], right: list[str]) -> np.ndarray:
    sums = [F.sum(F.col(x) * F.col(y)) for x in left for y in right]
    return np.array(rows.agg(*sums).first(), float).reshape(len(left), len(right))


def _combined(columns: list[str], weights: np.ndarray, names: list[str]) -> list[Column]:
    """Linear combinations of the columns, one for each column of the weights."""
    return [
        sum((F.col(c) * float(w) for c, w in zip(columns[1:], column[1:])), F.col(columns[0]) * float(column[0])).alias(name)
        for column, name in zip(weights.T, names)
    ]


def spectral_start(
    edges: DataFrame, ids: DataFrame, n_components: int, rounds: int = ROUNDS, change: float = CHANGE, seed: int = SEED
) -> tuple[DataFrame, np.ndarray]:
    """Positions (id, Dim0..) of the ``ids``, unit columns, and the Laplacian's eigenvalues from the second smallest on.

    ``edges`` has (a, b, weight) once for each pair.  Rows without an edge are at 0.
    """
    ways = edges.select(F.col("a").alias("id"), F.col("b").alias("to"), "weight").union(
        edges.select(F.col("b").alias("id"), F.col("a").alias("to"), "weight")
    )
    degrees = settle(ways.groupBy("id").agg(F.sqrt(F.sum("weight")).alias("root")).where("root > 0"), "degrees")
    other = degrees.select(F.col("id").alias("to"), F.col("root").alias("other"))
    ways = ways.join(degrees, "id").join(other, "to")
    ways = settle(ways.select("id", "to", (F.col("weight") / (F.col("root") * F.col("other"))).alias("w")), "ways")
    # The first column is the known smoothest vector, which the others stay orthogonal to.
    size = min(n_components + 1 + SPARE, degrees.count())
    x = [f"x{i}" for i in range(size)]
    draw = [(F.xxhash64(F.lit(seed), F.lit(i), "id") / 2.0**63).alias(c) for i, c in enumerate(x)]
    at = settle(degrees.select("id", F.col("root").alias(x[0]), *draw[1:]), "start")

    def stepped(now: DataFrame) -> DataFrame:
        there = now.select(F.col("id").alias("to"), *x)
        pulled = ways.join(there, "to").groupBy("id").agg(*[F.sum(F.col("w") * F.col(c)).alias(f"_{c}") for c in x])
        # Half of the row itself keeps all eigenvalues between 0 and 1.
        return now.join(pulled, "id").select("id", *[((F.col(c) + F.col(f"_{c}")) / 2).alias(c) for c in x])

    def orthonormal(rows: DataFrame) -> DataFrame:
        values, vectors = np.linalg.eigh(_inner(rows, x, x))
        kept = np.maximum(values, values.max() * 1e-14)
        return settle(rows.select("id", *_combined(x, vectors / np.sqrt(kept), x)), "block")

    at, before = orthonormal(at), np.zeros(size)
    for _ in range(rounds):
        for _ in range(STEPS):
            at = stepped(at)
        at = orthonormal(settle(at, "powers"))
        once = settle(at.join(stepped(at).select("id", *[F.col(c).alias(f"m{c}") for c in x]), "id"), "once")
        inner = _inner(once, x, [f"m{c}" for c in x])
        values, vectors = np.linalg.eigh((inner + inner.T) / 2)
        values, vectors = values[::-1], vectors[:, ::-1]
        done = np.abs(values - before)[: n_components + 1].max() < change
        before = values
        if done:
            break
    wanted = slice(1, n_components + 1)
    dims = [f"Dim{i}" for i in range(n_components)]
    found = at.select("id", *_combined(x, vectors[:, wanted], dims[: size - 1]))
    missing = [F.lit(0.0).alias(c) for c in dims[size - 1 :]]
    placed = ids.select("id").join(found.select("id", *dims[: size - 1], *missing), "id", "left")
    return placed.select("id", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in dims]), 2 - 2 * values[wanted]
