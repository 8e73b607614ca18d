"""Cleaning and filtering of posts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .language import LanguageDetector


def add_text_no_urls(df: DataFrame, col: str = "text") -> DataFrame:
    return df.withColumn("text_no_urls", X.remove_url(F.col(col)))


def add_extracted_urls(df: DataFrame, col: str = "text") -> DataFrame:
    return df.withColumn("extracted_urls", X.url_slug(X.extract_url(F.col(col))))


def add_length(df: DataFrame, col: str = "text") -> DataFrame:
    return df.withColumn("length", X.word_count(F.col(col)))


def add_removed(df: DataFrame, col: str = "text") -> DataFrame:
    return df.withColumn("reddit_removed", X.is_removed(F.col(col)))


def clean_posts(
    df: DataFrame,
    language: Callable[[Column], Column] | LanguageDetector,
    text_col: str = "text",
    key: str = "doc_id",
    narrow_emoji: bool = False,
) -> DataFrame:
    """Clean the text and keep rows with over two words, not removed, in an accepted language.

    ``language`` maps the cleaned text to a language code.  The cheap tests come
    first, so the language is only worked out for rows that pass them.  One
    narrow stage, no shuffle, unless a detector's profile is too large for the workers
    and has trigrams to join.
    """
    tidy = X.normalize_spaces(
        X.remove_emoji(X.remove_url(F.col(text_col)), narrow=narrow_emoji)
    )
    # Catalyst would copy the cleaning into every use of it.  A generator that
    # yields one row is not copied, so each text is cleaned once.
    facts = F.transform(
        F.array(tidy),
        lambda t: F.struct(
            t.alias("text"),
            X.normalized_word_count(t).alias("length"),
            X.is_removed(t).alias("reddit_check"),
        ),
    )
    counted = df.select(key, F.inline(facts)).where((F.col("length") > 2) & ~F.col("reddit_check"))
    if isinstance(language, LanguageDetector):
        detected = language.add(counted, "text", "lang")
    else:
        detected = counted.withColumn("lang", language(F.col("text")))
    return (
        detected
        .withColumn("lang_check", X.is_accepted_language(F.col("lang")))
        .where("lang_check")
        .select(key, "text", "lang", "length", "lang_check", "reddit_check")
    )
