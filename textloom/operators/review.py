"""Side-by-side review of two label tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import settle
from .sample import SEED, half_rows


def random_text(
    df: DataFrame, seed: int = SEED, cluster: str = "clust_id", key: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The texts of a random half of each cluster, as (cluster, rank, text).

    One row for each text, so a cluster of any size stays spread over tasks; read in
    rank order, a cluster's rows are its sample in a random order.
    """
    picks = half_rows(df, seed, cluster, key).select(key, "rank")
    texts = df.where(F.col(text_col).isNotNull()).select(cluster, key, F.col(text_col).alias("text"))
    return texts.join(picks, key).select(cluster, "rank", "text")


def random_concat(
    df: DataFrame, most: int = 40, seed: int = SEED, cluster: str = "clust_id", key: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(cluster, ``Random Text``): the first ``most`` texts of each cluster's random half, joined by spaces."""
    texts = random_text(df.where(F.col(text_col).isNotNull()), seed, cluster, key, text_col).where(F.col("rank") <= most)
    ordered = F.sort_array(F.collect_list(F.struct("rank", "text")))
    return texts.groupBy(cluster).agg(F.array_join(F.transform(ordered, lambda r: r["text"]), " ").alias("Random Text"))


def first_labels(labels: DataFrame, cols: dict[str, str]) -> DataFrame:
    """One row for each cluster with the named columns: the first in the order of these columns."""
    row = F.struct(*[F.col(f"`{src}`").alias(dst) for src, dst in cols.items()])
    return labels.groupBy("Cluster").agg(F.min(row).alias("_row")).select("Cluster", "_row.*")


def review_table(
    clustered: DataFrame,
    labels_one: DataFrame,
    labels_two: DataFrame,
    label_one: str = "CoVe_Q1",
    label_two: str = "CoVe_Q2",
    seed: int = SEED,
    skip: str | int = -1,
    text_col: str = "text",
    key: str = "doc_id",
    random_texts: int | None = None,
) -> DataFrame:
    """One row for each cluster: representative text, number of random texts, both labels.

    The random texts themselves are the rows of ``random_text``; with ``random_texts`` the column
    ``Random Text`` has up to that many of them in one text.  Noise is left out.

    ``skip`` is the id of the cluster to leave out, or ``"first"`` for the lowest
    id of the first label table.  A cluster without a second label is an error.
    """
    one = settle(first_labels(labels_one, {label_one: "CoVe_Q1_Label"}), "labels")
    two = settle(first_labels(labels_two, {label_two: "CoVe_Q2_Label", "Text": "Rep Text"}), "labels")
    if skip == "first":
        skip = one.agg(F.min("Cluster")).first()[0]
    wanted = one.where(F.col("Cluster") != skip)
    lost = wanted.join(two, "Cluster", "left_anti").limit(1).count()
    if lost:
        raise ValueError("the second label table lacks a cluster of the first")
    has_text = clustered.where(F.col(text_col).isNotNull())
    drawn = half_rows(has_text, seed, "clust_id", key).groupBy("clust_id").agg(F.count("*").alias("drawn"))
    columns = ["Cluster", "Rep Text", F.coalesce("drawn", F.lit(0)).alias("Random Texts"), "CoVe_Q1_Label", "CoVe_Q2_Label"]
    if random_texts is not None:
        joined = random_concat(clustered, random_texts, seed, "clust_id", key, text_col)
        drawn = drawn.join(joined, "clust_id", "left")
        columns.insert(2, "Random Text")
    return (
        wanted.join(two, "Cluster")
        .join(drawn.withColumnRenamed("clust_id", "Cluster"), "Cluster", "left")
        .select(*columns)
    )
