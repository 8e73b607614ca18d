"""Semantic near-duplicates: similarity to a group's centre, and pairs above a threshold."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import settle
from .sample import SEED

GROUPS = 600
THRESHOLD = 0.9999
DIRECTIONS = 4
TILE_ROWS = 1024  # rows of a cell that meet as many others in one task
SLACK = 1e-9  # what products of matrices may differ from the plain sum


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x
    )


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def kmeans_groups(
    df: DataFrame, k: int = GROUPS, vector_col: str = "embeddings", seed: int = SEED
) -> DataFrame:
    """Adds ``klabel``, the k-means group of the vector."""
    vectors = df.withColumn("_v", array_to_vector(vector_col))
    model = KMeans(k=k, seed=seed, featuresCol="_v", predictionCol="klabel").fit(vectors.select("_v"))
    return model.transform(vectors).drop("_v")


def centroid_similarity(
    df: DataFrame, group: str = "klabel", vector_col: str = "embeddings"
) -> DataFrame:
    """Adds ``cosine_sim``, the cosine of the vector and its group's mean.

    Means are partial sums on the map side, so a big group does not meet in one
    task; the table of means is small and joins by broadcast.
    """
    means = settle(
        df.select(group, array_to_vector(vector_col).alias("_v"))
        .groupBy(group)
        .agg(vector_to_array(Summarizer.mean(F.col("_v"))).alias("_mean")),
        "means",
    )
    return (
        df.join(means, group)
        .withColumn("cosine_sim", cosine(F.col(vector_col), F.col("_mean")))
        .drop("_mean")
    )


def flag_similar(df: DataFrame, threshold: float = THRESHOLD, literal: bool = False) -> DataFrame:
    """Adds ``similar`` and ``Drop``; ``literal`` drops the rows that are not similar."""
    similar = F.coalesce(F.col("cosine_sim") > threshold, F.lit(False))
    flagged = df.withColumn("similar", similar)
    return flagged.withColumn("Drop", ~F.col("similar") if literal else F.col("similar"))


def sdedup(
    df: DataFrame, k: int = GROUPS, threshold: float = THRESHOLD, vector_col: str = "embeddings",
    literal: bool = False, seed: int = SEED,
) -> DataFrame:
    grouped = settle(kmeans_groups(df, k, vector_col, seed), "groups")
    return flag_similar(centroid_similarity(grouped, "klabel", vector_col), threshold, literal)


def _confirmed(pairs: DataFrame, units: DataFrame, threshold: float) -> DataFrame:
    """The rows (first) of the pairs (first, other) whose cosine is above the threshold."""
    there = units.select(F.col("first").alias("other"), F.col("u").alias("other_u"))
    near = pairs.join(units, "first").join(there, "other").where(dot(F.col("u"), F.col("other_u")) > threshold)
    return near.select("first").distinct()


def _tile(threshold: float):
    """Rows of a tile that repeat an earlier one, and pairs too close to the threshold to tell by a product of matrices."""

    def run(asking: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        sure, pairs = [], []
        if len(asking) and len(held):
            first, other = asking["first"].to_numpy(), held["first"].to_numpy()
            cosines = np.stack(asking["u"].to_numpy()) @ np.stack(held["u"].to_numpy()).T
            cosines[other[None, :] >= first[:, None]] = -2.0
            found = (cosines > threshold + SLACK).any(axis=1)
            sure = first[found].tolist()
            i, j = np.nonzero((np.abs(cosines - threshold) <= SLACK) & ~found[:, None])
            pairs = list(zip(first[i].tolist(), other[j].tolist()))
        rows = [(f, None) for f in sure] + pairs
        return pd.DataFrame(rows, columns=["first", "other"]).astype({"first": "int64", "other": "Int64"})

    return run


def _crowded(asking: DataFrame, home: DataFrame, units: DataFrame, cells: DataFrame, threshold: float, tile_rows: int) -> DataFrame:
    """Rows (first, other) of crowded cells as ``_tile`` gives them: every task compares one tile with another."""
    tiles = cells.select(
        "cell", F.ceil(F.col("held") / tile_rows).alias("holders"), F.ceil(F.col("asked") / tile_rows).alias("askers")
    )

    def dealt(rows: DataFrame, own: str, across: str) -> DataFrame:
        """Each row in a tile of its own side, once for every tile of the other side."""
        number = F.sequence(F.lit(0).cast("long"), F.col(across) - 1)
        return rows.join(tiles, "cell").select(
            "cell", "first", F.pmod(F.xxhash64("first"), F.col(own)).alias(own[0]), F.explode(number).alias(across[0])
        ).join(units, "first")

    keys = ["cell", "a", "h"]
    left, right = dealt(asking, "askers", "holders"), dealt(home, "holders", "askers")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(_tile(threshold), "first bigint, other bigint")
    return settle(found, "tiles")


def semantic_dedup(
    df: DataFrame, group: str = "klabel", threshold: float = THRESHOLD, vector_col: str = "embeddings",
    key: str = "doc_id", seed: int = SEED, tile_rows: int = TILE_ROWS,
) -> DataFrame:
    """Rows without an earlier row of their group whose cosine is above the threshold.

    Equal vectors collapse first, so a group of copies stays one row.  Vectors
    that close lie within a small distance, hence within it along any direction:
    rows meet only where their cells along a few random directions do.  A cell is
    two such distances wide, so a row looks into two cells for each direction,
    and no close pair is missed.  A row first meets the earliest row of each cell; only
    rows that are not close to one of these meet the other rows of their cells.  Cells hold
    keys; vectors join the pairs of small cells, and the tiles of crowded ones, of which a task
    compares two.
    """
    reach = math.sqrt(2 - 2 * threshold) * (1 + 1e-6) + 1e-9
    width = df.select(F.size(vector_col)).first()[0]
    lines = np.random.default_rng(seed).standard_normal((DIRECTIONS, width))
    lines /= np.linalg.norm(lines, axis=1, keepdims=True)

    wide = F.transform(vector_col, lambda x: x.cast("double"))
    firsts = df.select(key, group, wide.alias("v")).groupBy(group, "v").agg(F.min(key).alias("first"))
    norm = F.sqrt(dot(F.col("v"), F.col("v")))
    unit = firsts.withColumn("_n", norm).select(
        group, "first", F.when(F.col("_n") > 0, F.transform("v", lambda x: x / F.col("_n"))).alias("u")
    )
    unit = settle(unit, "units")
    units = unit.where("u is not null").select("first", "u")
    along = [
        dot(F.col("u"), F.array(*[F.lit(float(x)) for x in line])) / (2 * reach) for line in lines
    ]
    placed = unit.where("u is not null").select(group, "first", F.array(*along).alias("_at"))
    home = placed.select(F.struct(group, F.transform("_at", lambda x: F.floor(x)).alias("at")).alias("cell"), "first")
    looked = placed
    for i in range(DIRECTIONS):
        at = F.col("_at")[i]
        own = F.floor(at)
        side = F.when(at - own < 0.5, own - 1).otherwise(own + 1)
        looked = looked.withColumn(f"_c{i}", F.explode(F.array(own, side)))
    looked = looked.select(F.struct(group, F.array(*[F.col(f"_c{i}") for i in range(DIRECTIONS)]).alias("at")).alias("cell"), "first")
    earliest = home.groupBy("cell").agg(F.count("*").alias("held"), F.min("first").alias("other"))
    looked = settle(looked.join(earliest, "cell").where(F.col("other") < F.col("first")), "looked")
    # The earliest row of a cell settles most of a crowd of near copies, one pair for each row.
    settled = settle(_confirmed(looked.select("first", "other"), units, threshold), "settled")
    # Only rows that it leaves open meet the other rows of their cells.
    asking = settle(looked.where("held > 1").join(settled, "first", "left_anti"), "open")
    cells = settle(asking.groupBy("cell").agg(F.max("held").alias("held"), F.count("*").alias("asked")), "cells")
    crowded = F.col("held") * F.col("asked") > tile_rows
    few = asking.select("cell", "first").join(cells.where(~crowded), "cell").drop("held", "asked")
    pairs = few.join(home.withColumnRenamed("first", "other"), "cell").where(F.col("other") < F.col("first")).select("first", "other")
    many = cells.where(crowded)
    if many.limit(1).count():
        in_tiles = _crowded(asking.select("cell", "first"), home, units, many, threshold, tile_rows)
        pairs = pairs.union(in_tiles.where("other is not null"))
        settled = settled.union(in_tiles.where("other is null").select("first"))
    repeats = settled.union(_confirmed(pairs, units, threshold)).distinct()
    kept = unit.select(F.col("first").alias(key)).join(repeats.withColumnRenamed("first", key), key, "left_anti")
    return df.join(kept, key, "left_semi")
