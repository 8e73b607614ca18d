"""Text expressions.  Every function takes and returns a Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P


def remove_url(text: Column) -> Column:
    """Text without URLs; missing text becomes the empty string."""
    return F.coalesce(F.regexp_replace(text, P.URL, ""), F.lit(""))


def extract_url(text: Column) -> Column:
    """First URL of the text, null when there is none."""
    return F.nullif(F.regexp_extract(text, P.URL, 0), F.lit(""))


def url_slug(url: Column) -> Column:
    """Words of the last path segment that is neither empty nor starts with a digit."""
    segments = F.filter(F.split(url, "/"), lambda s: (s != "") & ~s.rlike("^[0-9]"))
    return F.replace(F.try_element_at(segments, F.lit(-1)), F.lit("-"), F.lit(" "))


def word_count(text: Column) -> Column:
    """Number of words; a missing text counts as one word."""
    return F.coalesce(F.regexp_count(text, F.lit(P.NON_SPACES)), F.lit(1))


def normalized_word_count(text: Column) -> Column:
    """Number of words of a text whose spaces are normalised: one more than its spaces."""
    spaces = F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))
    return F.when(text == "", F.lit(0)).otherwise(spaces + 1)


def is_removed(text: Column) -> Column:
    """True when the whole text is a removed or deleted marker."""
    return F.coalesce(text.isin(*P.REMOVED_MARKERS), F.lit(False))


def remove_emoji(text: Column, narrow: bool = False) -> Column:
    return F.regexp_replace(text, P.EMOJI_NARROW if narrow else P.EMOJI_WIDE, "")


def normalize_spaces(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, P.SPACES, " "))


def strip_spaces(text: Column) -> Column:
    """Text without leading and trailing space of any kind."""
    return F.regexp_replace(text, f"^{P.SPACES}|{P.SPACES}$", "")


def is_accepted_language(lang: Column) -> Column:
    return F.coalesce(lang.isin(*P.ACCEPTED_LANGUAGES), F.lit(False))


def parse_vector(text: Column) -> Column:
    """Array of doubles from text such as ``"[0.1, 0.2]"``."""
    return F.from_json(text, "array<double>")


def decode_text(data: Column) -> Column:
    """UTF-8 bytes as text, leaving out bytes that are not valid."""
    return F.replace(F.make_valid_utf8(data.cast("string")), F.lit("�"), F.lit(""))


def char_length(text: Column) -> Column:
    """Characters of the stripped text; a missing text is written ``nan`` and has three."""
    return F.length(strip_spaces(F.coalesce(text, F.lit("nan"))))


def token_count(text: Column) -> Column:
    """Tokens of the text plus a begin and an end mark."""
    return F.regexp_count(F.coalesce(text, F.lit("nan")), F.lit(P.TOKEN)) + 2


def extract_label(answer: Column, fallback: bool = False) -> Column:
    """Label of a model answer.

    The quoted text after the first colon; the whole answer when there is no
    colon form at all.  An unquoted form gives null, or the rest of its line
    when ``fallback`` is set.
    """
    found = F.regexp_extract(answer, P.LABEL, 0)
    unquoted = F.substring(found, 3, 2**31 - 1) if fallback else F.lit(None).cast("string")
    return (
        F.when(~answer.rlike(P.LABEL), answer)
        .when(found.rlike(P.LABEL_QUOTED), F.regexp_extract(answer, P.LABEL, 1))
        .otherwise(unquoted)
    )


def html_wrap(text: Column) -> Column:
    """Text with a line break mark before every run of words.

    The marks sit at positions 0, 20, 40, ... of the list that holds words and
    marks, one for each begun 20 words of the text.  So each run has 19 words
    and the last run takes the rest.
    """
    run = P.WORDS_PER_BREAK - 1
    words = F.regexp_extract_all(F.coalesce(text, F.lit("nan")), F.lit(P.NON_SPACES), F.lit(0))

    def wrap(w: Column) -> Column:
        n = F.size(w)
        last = F.ceil(n / P.WORDS_PER_BREAK).cast("int") - 1
        broken = F.transform(
            F.sequence(F.lit(0), last),
            lambda k: F.concat(
                F.array(F.lit(P.LINE_BREAK)),
                F.slice(w, k * run + 1, F.when(k < last, F.lit(run)).otherwise(n)),
            ),
        )
        return F.when(n == 0, F.lit("")).otherwise(F.array_join(F.flatten(broken), " "))

    # A lambda's body is evaluated for each element, so the words are bound first.
    return F.transform(F.array(words), wrap)[0]


def word_list(text: Column, stopwords: Column) -> Column:
    """Lower-cased words of letters only that are not in the stopword array."""
    words = F.regexp_extract_all(text, F.lit(P.NON_SPACES), F.lit(0))
    kept = F.filter(
        words, lambda w: w.rlike(P.LETTERS_ONLY) & ~F.array_contains(stopwords, w)
    )
    return F.transform(kept, F.lower)


def turn(role: str, content: Column | str) -> Column:
    """One dialogue turn: a struct of role and content."""
    body = content if isinstance(content, Column) else F.lit(content)
    return F.struct(F.lit(role).alias("role"), body.alias("content"))
