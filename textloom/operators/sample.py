"""Ranking and sampling inside clusters.

A cluster may hold a third of all rows, so no window here ranks a whole cluster
in one task.  Top-k ranks in two steps, and full ranks are built from many small
hash buckets.  Only keys and numbers are ranked; texts join afterwards.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEED = 8
BUCKET_DIGITS = 3
SALTS = 64


def hash_order(key: str, seed: int = SEED) -> Column:
    """Random but repeatable order of rows."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def top_k_per_group(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int | Column, rank: str = "rank"
) -> DataFrame:
    """The first k rows of each group, with their rank from 1.

    First the best k of each (group, slice of the input), then the best k of
    those: each map task keeps k rows of a group, and no task sorts more than k
    rows from each slice.
    """
    limit = k if isinstance(k, Column) else F.lit(k)
    sliced = df.withColumn("_slice", F.spark_partition_id() % SALTS)
    first = Window.partitionBy(*group, "_slice").orderBy(*order)
    second = Window.partitionBy(*group).orderBy(*order)
    return (
        sliced.withColumn("_r", F.row_number().over(first))
        .where(F.col("_r") <= limit)
        .drop("_r", "_slice")
        .withColumn(rank, F.row_number().over(second))
        .where(F.col(rank) <= limit)
    )


def rank_by_hash(
    df: DataFrame, group: Sequence[str], hash_col: str, rank: str = "rank"
) -> DataFrame:
    """Every row with its rank in hash order inside its group, and the group's size.

    The first digits of the hash cut each group into even buckets; a row's rank
    is the number of rows in the buckets before its own plus its place in it.
    """
    keyed = df.withColumn("_bucket", F.substring(hash_col, 1, BUCKET_DIGITS))
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*group)
    offsets = (
        keyed.groupBy(*group, "_bucket")
        .agg(F.count("*").alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .withColumn("group_size", F.sum("_n").over(whole))
        .drop("_n")
    )
    inside = Window.partitionBy(*group, "_bucket").orderBy(hash_col)
    return (
        keyed.withColumn("_place", F.row_number().over(inside))
        .join(offsets, [*group, "_bucket"])
        .withColumn(rank, F.col("_before") + F.col("_place"))
        .drop("_bucket", "_place", "_before")
    )


def longest_rows(
    df: DataFrame, k: int = 40, cluster: str = "clust_id", size: str = "num_tokens", key: str = "doc_id"
) -> DataFrame:
    """The k rows of each cluster with most tokens; ties in key order."""
    return top_k_per_group(df.select(cluster, key, size), [cluster], [F.desc(size), F.col(key)], k)


def shuffled_rows(
    df: DataFrame, seed: int = SEED, cluster: str = "clust_id", key: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """All rows of each cluster that have a text, numbered in random order."""
    hashed = df.where(F.col(text_col).isNotNull()).select(
        cluster, key, hash_order(key, seed).alias("_h")
    )
    return rank_by_hash(hashed, [cluster], "_h").select(cluster, key, "rank")


def half_rows(
    df: DataFrame, seed: int = SEED, cluster: str = "clust_id", key: str = "doc_id"
) -> DataFrame:
    """A random half of each cluster; an odd half goes to the even neighbour."""
    hashed = df.select(cluster, key, hash_order(key, seed).alias("_h"))
    return (
        rank_by_hash(hashed, [cluster], "_h")
        .where(F.col("rank") <= F.bround(F.col("group_size") * 0.5))
        .select(cluster, key, "rank")
    )


def stratified_rows(
    df: DataFrame,
    stratum: str,
    seed: int = SEED,
    cluster: str = "clust_id",
    key: str = "doc_id",
    text_col: str = "text",
    carry: Sequence[str] = (),
) -> DataFrame:
    """Equally many random rows from every stratum of a cluster, in random order.

    The number is the size of the cluster's smallest stratum.  Rows without a
    stratum are left out; rows without a text leave after they were drawn.
    """
    hashed = df.where(F.col(stratum).isNotNull()).select(
        cluster, key, stratum, *carry, F.col(text_col).isNotNull().alias("_has_text"),
        hash_order(key, seed).alias("_h"),
    )
    ranked = rank_by_hash(hashed, [cluster, stratum], "_h", "_in_stratum")
    smallest = (
        hashed.groupBy(cluster, stratum)
        .agg(F.count("*").alias("_n"))
        .groupBy(cluster)
        .agg(F.min("_n").alias("_smallest"))
    )
    drawn = (
        ranked.join(smallest, cluster)
        .where((F.col("_in_stratum") <= F.col("_smallest")) & F.col("_has_text"))
        .select(cluster, key, stratum, *carry, "_h")
    )
    return rank_by_hash(drawn, [cluster], "_h").select(cluster, key, stratum, *carry, "rank")


def has_several(df: DataFrame, col: str) -> bool:
    """Whether the column holds more than one value over all rows."""
    return df.where(F.col(col).isNotNull()).select(col).distinct().limit(2).count() > 1
