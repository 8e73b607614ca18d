"""Better neighbour lists by looking at the neighbours of neighbours.

A row's neighbourhood is its own nearest rows and the rows that have it among theirs, a bounded number
of each.  Rows that meet in a neighbourhood are likely to be near each other, so each round compares
all rows of every neighbourhood, and lists keep what is nearer.  Rounds end when few entries
change.  After Dong, Charikar and Li (2011).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import settle
from .sample import SEED, top_k_per_group

NEAR = 16  # own neighbours, and rows that name one, of a neighbourhood
GROUP = 256  # neighbourhoods that a task compares at once
CHANGES = 0.01  # share of entries that must change for another round
ROUNDS = 12
NEIGHBOURS = "array<struct<d: double, id: bigint>>"


def _meetings(k: int):
    """Entries that are nearer than the k-th of a member, from all neighbourhoods of a group."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["u", "id"])
        ids, worst, old = pdf["id"].to_numpy(), pdf["worst"].to_numpy(), pdf["old"].to_numpy()
        v = np.stack(pdf["v"].to_numpy()).astype(np.float64)
        norms = (v * v).sum(axis=1)
        cuts = np.flatnonzero(np.diff(pdf["u"].to_numpy(), prepend=np.nan) != 0).tolist() + [len(pdf)]
        rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for a, b in zip(cuts[:-1], cuts[1:]):
            q = v[a:b]
            d = norms[a:b, None] + norms[None, a:b] - 2 * (q @ q.T)
            d = np.sqrt(np.maximum(d, 0))
            np.fill_diagonal(d, np.inf)
            d[old[a:b, None] & old[None, a:b]] = np.inf  # these met in an earlier round
            if b - a - 1 > k:
                worst_here = np.partition(d, k - 1, axis=1)[:, k - 1]
                i, j = np.nonzero((d < worst[a:b, None]) & (d <= worst_here[:, None]))
            else:
                i, j = np.nonzero(d < worst[a:b, None])
            rows.append((ids[a + i], ids[a + j], d[i, j]))
        x, y, d = (np.concatenate([r[c] for r in rows]) for c in range(3))
        found = pd.DataFrame({"id": x, "to": y, "d": d})
        return found.sort_values("d").drop_duplicates(["id", "to"]).groupby("id").head(k)

    return run


def refine_neighbours(lists: DataFrame, vectors: DataFrame, k: int, near: int = NEAR, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """Lists (id, nbrs) of at most k entries, from lists of rough ones and the vectors (id, v) with one row an id.

    An entry that is older than the last round meets only newer ones, so no two rows are compared in one
    neighbourhood twice.
    """
    entries = lists.select("id", F.explode("nbrs").alias("n")).select("id", F.col("n.id").alias("to"), F.col("n.d").alias("d"))
    entries = settle(entries.withColumn("round", F.lit(0)), "entries")
    rows = vectors.count()
    groups = max(1, rows // GROUP)
    for turn in range(1, rounds + 1):
        worst = entries.groupBy("id").agg(F.when(F.count("*") >= k, F.max("d")).otherwise(F.lit(float("inf"))).alias("worst"))
        links = entries.select(F.col("id").alias("u"), F.col("to").alias("id"), "d", "round")
        back = entries.select(F.col("to").alias("u"), "id", "d", "round")
        order = (F.desc("round"), F.col("d"), F.col("id"))
        both = top_k_per_group(links, ["u"], order, near).union(top_k_per_group(back, ["u"], order, near))
        own = entries.select("id").distinct().select(F.col("id").alias("u"), "id", F.lit(-1).alias("round"))
        members = both.select("u", "id", "round").union(own).groupBy("u", "id").agg(F.max("round").alias("round"))
        members = members.select("u", "id", (F.col("round") < turn - 1).alias("old"))
        held = members.join(worst, "id", "left").withColumn("worst", F.coalesce("worst", F.lit(float("inf")))).join(vectors, "id")
        part = F.pmod(F.xxhash64(F.lit(seed), "u"), F.lit(groups)).alias("part")
        found = held.select(part, "u", "id", "old", "worst", "v").groupBy("part").applyInPandas(_meetings(k), "id bigint, to bigint, d double")
        found = settle(found, "meetings")
        known = entries.select("id", "to", F.lit(True).alias("known"))
        fresh = found.groupBy("id", "to").agg(F.min("d").alias("d")).join(known, ["id", "to"], "left").where("known is null")
        merged = entries.union(fresh.select("id", "to", "d", F.lit(turn).alias("round")))
        entries = settle(top_k_per_group(merged, ["id"], (F.col("d"), F.col("to")), k).drop("rank"), "entries")
        if entries.where(F.col("round") == turn).count() < CHANGES * k * rows:
            break
    pairs = entries.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("d", F.col("to").alias("id")))).alias("nbrs"))
    alone = F.array().cast(NEIGHBOURS)
    return vectors.select("id").join(pairs, "id", "left").select("id", F.coalesce("nbrs", alone).alias("nbrs"))
