"""Counts over clusters and words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import LETTERS_ONLY, NON_SPACES, SPACES
from .sample import top_k_per_group


def cluster_counts(df: DataFrame, cluster: str = "clust_id") -> DataFrame:
    return df.groupBy(cluster).agg(F.count("*").alias("n")).orderBy(cluster)


def n_clusters(df: DataFrame, cluster: str = "clust_id") -> DataFrame:
    return df.agg(F.count_distinct(cluster).alias("n_clusters"))


def cluster_stats(df: DataFrame, cluster: str = "clust_id", weight: Column | None = None) -> DataFrame:
    """Clusters without noise, noise rows and their share in per cent.

    Two-step: rows for each cluster first, so the distinct count needs no rows.
    """
    rows = weight if weight is not None else F.lit(1)
    c = F.col(cluster)
    return (
        df.groupBy(c.alias("c"))
        .agg(F.sum(rows).alias("rows"))
        .agg(
            F.count_if(F.col("c") != -1).alias("n_clusters"),
            F.coalesce(F.sum(F.when(F.col("c") == -1, F.col("rows"))), F.lit(0)).alias("n_outliers"),
            F.sum("rows").alias("n_rows"),
        )
        .select(
            "n_clusters",
            "n_outliers",
            (F.col("n_outliers") / F.nullif(F.col("n_rows"), F.lit(0)) * 100).alias("pct_outliers"),
        )
    )


def word_counts(
    df: DataFrame, stopwords: DataFrame, by: str = "clust_id", text_col: str = "text"
) -> DataFrame:
    """Uses of each lower-cased word of letters only that is no stopword.

    The stopword test is case-sensitive, so it comes before the lower-casing.
    Words are counted before the test, and the test runs on counts.
    """
    return (
        df.select(by, F.explode(F.split(F.col(text_col), SPACES)).alias("word"))
        .where(F.col("word").rlike(LETTERS_ONLY))
        .groupBy(by, "word")
        .agg(F.count("*").alias("uses"))
        .join(stopwords.select("word"), "word", "left_anti")
        .groupBy(by, F.lower("word").alias("word"))
        .agg(F.sum("uses").alias("n"))
    )


def ordered_words(df: DataFrame, stopwords: DataFrame, text_col: str = "text", key: str = "doc_id") -> DataFrame:
    """The word list of each text, as (key, pos, word): lower-cased words of letters, in text order, without stopwords."""
    found = F.regexp_extract_all(text_col, F.lit(NON_SPACES), F.lit(0))
    words = df.select(key, F.posexplode(found).alias("pos", "word")).where(F.col("word").rlike(LETTERS_ONLY))
    return words.join(stopwords, "word", "left_anti").select(key, "pos", F.lower("word").alias("word"))


def top_words(
    df: DataFrame, stopwords: DataFrame, k: int = 10, cluster: str = "clust_id", text_col: str = "text"
) -> DataFrame:
    """The k most frequent words of each cluster; equal counts in word order."""
    counts = word_counts(df, stopwords, cluster, text_col)
    ranked = top_k_per_group(counts, [cluster], [F.desc("n"), F.col("word")], k)
    return ranked.withColumn("rank", F.col("rank").cast("int"))
