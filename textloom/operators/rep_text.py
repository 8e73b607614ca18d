"""The representative text of each cluster, cut to a token budget."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.models import TokenizerFactory
from ..functions.patterns import TEXT_SEPARATOR
from ..sources.scratch import settle
from .sample import SEED, has_several, hash_order, stratified_rows, top_k_per_group

HEAD_ROWS = 40
MIN_TOKENS = 2  # the begin and the end mark


def add_token_counts(df: DataFrame, text_col: str = "text", tokenizer: TokenizerFactory | None = None) -> DataFrame:
    """Adds ``length`` (characters of the stripped text) and ``num_tokens``.

    A tokenizer factory runs once in each task and counts the tokens of a list of texts;
    without one, words and signs are counted in the JVM.  A missing text counts as ``nan``.
    """
    text = F.col(text_col)
    if tokenizer is None:
        count = X.token_count(text)
    else:

        @F.pandas_udf("int")
        def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            count_all = tokenizer()
            for texts in batches:
                yield pd.Series(count_all(texts.tolist()), index=texts.index, dtype="int32")

        count = counted(F.coalesce(text, F.lit("nan")))
    return df.withColumn("length", X.char_length(text)).withColumn("num_tokens", count)


def filter_semdup(df: DataFrame) -> DataFrame:
    """Rows that are not flagged as semantic duplicates."""
    return df.where(~F.coalesce(F.col("Drop"), F.lit(False)))


def token_limit(max_seq_len: int, content_len: int) -> int:
    return max_seq_len // 2 - content_len


def budget_prefix(
    ranked: DataFrame,
    max_seq_len: int,
    content_len: int,
    cluster: str = "clust_id",
    rank: str = "rank",
    size: str = "num_tokens",
) -> DataFrame:
    """Rows in rank order for as long as the running token sum stays below the limit.

    The prompt's own tokens count twice: in the limit and in the running sum.
    Token counts are positive, so a filter on the running sum keeps a prefix.
    """
    running = (
        Window.partitionBy(cluster).orderBy(rank).rowsBetween(Window.unboundedPreceding, 0)
    )
    return ranked.withColumn("running", F.sum(size).over(running)).where(
        content_len + F.col("running") < token_limit(max_seq_len, content_len)
    )


def choose_rows(
    df: DataFrame,
    max_rows: int,
    random: bool = True,
    sampling_col: str | None = None,
    seed: int = SEED,
    cluster: str = "clust_id",
    key: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Rows of each cluster in the order they may enter the text.

    Not random: the longest rows.  Random: a shuffle, stratified when
    ``sampling_col`` has several values.  Of a shuffle only the first
    ``max_rows`` rows are ranked; no more can fit the budget.
    """
    has_text = F.col(text_col).isNotNull()
    if not random:
        flags = df.select(cluster, key, "num_tokens", has_text.alias("has_text"))
        by_size = [F.desc("num_tokens"), F.col(key)]
        return top_k_per_group(flags, [cluster], by_size, HEAD_ROWS).where("has_text").drop("has_text")
    if sampling_col and has_several(df, sampling_col):
        drawn = stratified_rows(df, sampling_col, seed, cluster, key, text_col, carry=["num_tokens"])
        return drawn.where(F.col("rank") <= max_rows).drop(sampling_col)
    hashed = df.where(has_text).select(cluster, key, "num_tokens", hash_order(key, seed).alias("_h"))
    return top_k_per_group(hashed, [cluster], [F.col("_h")], max(max_rows, 0)).drop("_h")


def cluster_spine(df: DataFrame, cluster: str = "clust_id") -> DataFrame:
    """Every cluster id once with its number of rows, noise included."""
    return df.groupBy(cluster).agg(F.count("*").alias("n_rows"))


def rep_text(
    df: DataFrame,
    max_seq_len: int,
    content_len: int,
    random: bool = True,
    sampling_col: str | None = None,
    sdedup: bool = False,
    seed: int = SEED,
    cluster: str = "clust_id",
    key: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Table (cluster, rep_text, n_rows): the chosen texts, one on each line.

    A cluster stays, with an empty text, when even its first row is over budget.
    The chosen keys are few; they are written to a table, so Catalyst knows their
    size and brings them to the texts, and the texts are not shuffled.
    """
    if "num_tokens" not in df.columns:
        df = df.withColumn("num_tokens", X.token_count(F.col(text_col)))
    rows = filter_semdup(df) if sdedup else df
    # Ranking needs sizes but no texts: they are written once, so the texts are
    # tokenised once and the counts do not read them again.
    present = F.when(F.col(text_col).isNotNull(), F.lit("")).alias(text_col)
    strata = [sampling_col] if sampling_col else []
    sizes = settle(rows.select(cluster, key, "num_tokens", *strata, present), "sizes")
    max_rows = token_limit(max_seq_len, content_len) // MIN_TOKENS
    order = choose_rows(sizes, max_rows, random, sampling_col, seed, cluster, key, text_col)
    picks = settle(
        budget_prefix(order, max_seq_len, content_len, cluster).select(cluster, key, "rank"), "picks"
    )
    entry = F.struct("rank", F.col(text_col).alias("text"))
    texts = (
        rows.select(key, text_col)
        .join(picks, key)
        .groupBy(cluster)
        .agg(F.sort_array(F.collect_list(entry)).alias("entries"))
        .select(cluster, F.array_join(F.col("entries.text"), TEXT_SEPARATOR).alias("rep_text"))
    )
    return (
        cluster_spine(sizes, cluster)
        .join(texts, cluster, "left")
        .select(cluster, F.coalesce("rep_text", F.lit("")).alias("rep_text"), "n_rows")
    )


def content_length(prompt: Column, system: Column) -> Column:
    """Tokens of the user prompt with its suffix plus those of the system prompt."""
    return X.token_count(prompt) + X.token_count(system)
