"""Language identification by character trigrams (naive Bayes).

The profile is learnt by Spark from any table with a language column.  All trigrams
count, each as itself.  A profile of up to ``MOST`` trigrams goes to the workers once, and
scoring is one narrow stage: the texts are neither exploded nor shuffled.  Of a larger one
the most frequent trigrams go there, and the others are joined once for each text and trigram.

Weights are whole numbers (ten-thousandths of a natural log), so a score does
not depend on the order in which it is summed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.blocks import text_blocks
from ..functions.patterns import NON_LETTERS
from ..sources.scratch import settle

MOST = 1 << 20  # trigrams that go to the workers
CODE_BITS = 21  # of a code point
WEIGHT_SCALE = 10_000
CHARS_AT_ONCE = 1_000_000
SCORED_BYTES = 1 << 18  # of letters at once, whose trigrams each have a row of weights

# Languages told by their script, with the Java names of the scripts.
SCRIPTS = {
    "ko": r"\p{IsHangul}",
    "zh": r"\p{IsHan}",
    "ru": r"\p{IsCyrillic}",
}
BEYOND_LATIN = r"[\x{0400}-\x{10FFFF}]"  # a cheap first test; holds all scripts above
ANY_SCRIPT = "[" + "".join(SCRIPTS.values()) + r"\p{IsHiragana}\p{IsKatakana}]"
KANA = r"[\p{IsHiragana}\p{IsKatakana}]"


def letters_of(text: Column) -> Column:
    """Lower-cased runs of letters with one space around each."""
    runs = F.trim(F.regexp_replace(F.lower(text), NON_LETTERS, " "))
    return F.concat(F.lit(" "), runs, F.lit(" "))


def _gram_codes(chars: np.ndarray) -> np.ndarray:
    """Each three characters in a row as one number."""
    c = chars.astype(np.int64)
    return (c[:-2] << 2 * CODE_BITS) | (c[1:-1] << CODE_BITS) | c[2:]


def _joined_grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The trigrams of some texts, and the text of each.

    Texts are joined.  A gram belongs to the text of its first character when its last
    character is in that text too.
    """
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    owner = np.repeat(np.arange(len(texts)), lengths)
    grams = _gram_codes(np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32))
    inside = owner[:-2] == owner[2:] if len(owner) > 2 else np.zeros(0, bool)
    return grams[inside], owner[:-2][inside]


def _chunks(texts: list[str]) -> Iterator[list[str]]:
    at = size = 0
    for i, t in enumerate(texts):
        if i > at and size + len(t) > CHARS_AT_ONCE:
            yield texts[at:i]
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        yield texts[at:]


def _count_grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Partial counts (lang, gram, n) of trigrams."""
    for batch in batches:
        for lang, rows in batch.groupby("lang"):
            for texts in _chunks(rows["letters"].tolist()):
                grams, n = np.unique(_joined_grams(texts)[0], return_counts=True)
                yield pd.DataFrame({"lang": lang, "gram": grams, "n": n})


def language_profile(df: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Table (lang, gram, weight) of smoothed log-probabilities.

    The texts are read once; the counts are written, as they are used three times.
    Every language has a row for every trigram that any language uses.  Each batch is counted
    where it is read, so the shuffle carries distinct trigrams and not positions.
    """
    letters = df.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).alias("lang"), letters_of(F.col(text_col)).alias("letters")
    )
    counts = (
        letters.mapInPandas(_count_grams, "lang string, gram bigint, n bigint")
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
    )
    kept = settle(
        counts.groupBy("gram").agg(F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("counts")), "grams"
    )
    totals = kept.select(F.explode("counts").alias("lang", "n")).groupBy("lang").agg(F.sum("n").alias("total"))
    # The languages with their totals and the size of the vocabulary, as scalars.
    langs = totals.agg(F.collect_list(F.struct("lang", "total"))).scalar()
    vocabulary = kept.agg(F.count("*")).scalar()
    share = (F.coalesce(F.try_element_at("counts", F.col("l.lang")), F.lit(0)) + 1.0) / (
        F.col("l.total") + F.col("vocabulary")
    )
    return (
        kept.select("gram", "counts", langs.alias("langs"), vocabulary.alias("vocabulary"))
        .select("gram", "counts", "vocabulary", F.explode("langs").alias("l"))
        .select(
            F.col("l.lang").alias("lang"),
            "gram",
            F.round(F.log(share) * WEIGHT_SCALE).cast("long").alias("weight"),
        )
    )


class _Index:
    """Rows of known trigrams: one look into a table for most, a sorted list for those whose place is taken."""

    def __init__(self, known: np.ndarray):
        self.known, self.size = known, 4 * len(known) + 1
        self.row_of = np.full(self.size, -1, np.int32)
        self.row_of[(known % self.size)[::-1]] = np.arange(len(known))[::-1]
        lost = np.flatnonzero(self.row_of[known % self.size] != np.arange(len(known)))
        order = np.argsort(known[lost])
        self.others, self.rows = known[lost][order], lost[order]

    def find(self, grams: np.ndarray) -> np.ndarray:
        """Row of each trigram, -1 where it is not known."""
        if not len(self.known):
            return np.full(len(grams), -1, np.int64)
        row = self.row_of[grams % self.size].astype(np.int64)
        wrong = np.flatnonzero((row >= 0) & (self.known[row] != grams))
        if len(self.others):
            at = np.minimum(np.searchsorted(self.others, grams[wrong]), len(self.others) - 1)
            row[wrong] = np.where(self.others[at] == grams[wrong], self.rows[at], -1)
        else:
            row[wrong] = -1
        return row


def _wide(profile: DataFrame) -> DataFrame:
    """(gram, weights): one weight for each language, in their order."""
    ordered = F.sort_array(F.collect_list(F.struct("lang", "weight")))
    return profile.groupBy("gram").agg(F.transform(ordered, lambda r: r["weight"]).alias("weights"))


def _frequent(wide: DataFrame, most: int) -> Column:
    """Whether a trigram is among about ``most`` with the largest weight in any language, none more."""
    sizes = wide.groupBy(F.array_max("weights").alias("w")).agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy(F.desc("w")))  # one row for each weight, a whole number of small range
    least = sizes.withColumn("n", before).where(F.col("n") <= most).agg(F.min("w")).first()[0]
    return F.lit(False) if least is None else F.array_max("weights") >= least


def _scores(index: _Index, weights: np.ndarray, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per text the scores by known trigrams and their number; the other trigrams and their texts."""
    grams, owner = _joined_grams(texts)
    row = index.find(grams)
    unknown = row < 0
    rest, of = grams[unknown], owner[unknown]
    row, owner = row[~unknown], owner[~unknown]
    hits = np.bincount(owner, minlength=len(texts))
    scores = np.zeros((len(texts), weights.shape[1]), np.int64)
    some = np.flatnonzero(hits)
    if len(some):
        # Owners ascend, so the rows of a text lie together.
        scores[some] = np.add.reduceat(weights[row], np.searchsorted(owner, some), axis=0)
    return scores, hits, rest, of


def _sent(profile: DataFrame, wide: DataFrame) -> tuple[list[str], Broadcast]:
    """The languages, and the trigrams with their weights for the workers."""
    langs = sorted(r["lang"] for r in profile.select("lang").distinct().collect())
    table = wide.toPandas()  # bounded: languages x MOST
    weights = np.array(table["weights"].tolist(), np.int64).reshape(len(table), len(langs))
    return langs, profile.sparkSession.sparkContext.broadcast((table["gram"].to_numpy(np.int64), weights))


def _decide(text: Column, by_grams: Column) -> Column:
    """Scripts decide first; a text without letters is ``error``."""
    # Texts without any of these scripts skip the counts.
    letters = F.length(F.regexp_replace(text, r"\P{L}+", ""))
    other = F.when(text.rlike(KANA), F.lit("ja"))
    for lang, script in SCRIPTS.items():
        other = other.when(F.regexp_count(text, F.lit(script)) * 2 > letters, F.lit(lang))
    by_script = F.when(text.rlike(BEYOND_LATIN) & text.rlike(ANY_SCRIPT), other)
    no_letters = text.isNull() | ~text.rlike(r"\p{L}")
    return F.when(no_letters, F.lit("error")).otherwise(F.coalesce(by_script, by_grams))


class LanguageDetector:
    """Finds languages by all trigrams of a profile, which the texts of a column or of a table's rows have.

    Scripts decide first.  A text without letters or without any known trigram
    is ``error``; when ``margin`` is set, a lead below it (in weight per gram) is
    ``unknown``.  Equal scores go to the language that sorts first.  Up to ``most`` trigrams go to
    the workers; of a larger profile only the most frequent ones do, and the others are joined.
    """

    def __init__(self, profile: DataFrame, margin: int, most: int):
        wide = settle(_wide(profile), "wide profile")
        self.margin, self.most, self.whole = margin, most, wide.count() <= most
        frequent = F.lit(True) if self.whole else _frequent(wide, most)
        self.rest = wide.where(~frequent)
        self.langs, self.shared = _sent(profile, wide.where(frequent))

    def __call__(self, text: Column) -> Column:
        """Language of a text column, for a profile whose trigrams all go to the workers."""
        if not self.whole:
            raise ValueError(f"the profile has more than {self.most} trigrams, the others need a join: use add()")
        langs, shared, margin = self.langs, self.shared, self.margin

        @F.arrow_udf("string")
        def best_language(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            known, weights = shared.value
            index = _Index(known)
            answers = np.array(langs + ["error", "unknown"], dtype=object)

            def best(texts: list[str]) -> np.ndarray:
                scores, hits, _, _ = _scores(index, weights, texts)
                out = np.full(len(texts), len(langs))
                some = np.flatnonzero(hits)
                if len(some):
                    out[some] = scores[some].argmax(axis=1)
                    if margin and len(langs) > 1:
                        two = np.sort(scores[some], axis=1)[:, -2:]
                        out[some[two[:, 1] - two[:, 0] < margin * hits[some]]] = len(langs) + 1
                return out

            for texts in text_blocks(batches, SCORED_BYTES):
                yield pa.array(answers[best(texts)], pa.string())

        return _decide(text, best_language(letters_of(text)))

    def add(self, df: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
        """Adds the language of each row, by a profile of any size."""
        kept = [c for c in df.columns if c != lang_col]
        if self.whole:
            return df.select(*kept, self(F.col(text_col)).alias(lang_col))
        langs, shared, margin = self.langs, self.shared, self.margin
        rows = settle(df.withColumn("_row", F.monotonically_increasing_id()), "rows")

        def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            known, weights = shared.value
            index = _Index(known)
            for batch in batches:
                low, whole = 0, batch["letters"].fillna("").tolist()
                for texts in _chunks(whole):
                    scores, hits, rest, of = _scores(index, weights, texts)
                    pairs, times = np.unique(np.stack([of, rest]), axis=1, return_counts=True)
                    lists = [[] for _ in texts]
                    for i, g, n in zip(pairs[0].tolist(), pairs[1].tolist(), times.tolist()):
                        lists[i].append({"gram": g, "n": n})
                    part = batch["_row"].iloc[low : low + len(texts)].to_numpy()
                    low += len(texts)
                    yield pd.DataFrame({"_row": part, "scores": list(scores), "hits": hits, "rest": lists})

        schema = "_row bigint, scores array<bigint>, hits bigint, rest array<struct<gram: bigint, n: bigint>>"
        letters = rows.select("_row", letters_of(F.col(text_col)).alias("letters"))
        scored = settle(letters.mapInPandas(score, schema), "scores")
        left = scored.select("_row", F.explode("rest").alias("r")).select("_row", "r.gram", "r.n").join(self.rest, "gram")
        sums = F.array(*[F.sum(F.col("weights")[i] * F.col("n")) for i in range(len(langs))])
        more = left.groupBy("_row").agg(sums.alias("more"), F.sum("n").alias("more_hits"))
        whole = scored.drop("rest").join(more, "_row", "left").select(
            "_row", (F.col("hits") + F.coalesce("more_hits", F.lit(0))).alias("_hits"),
            F.when(F.col("more").isNull(), F.col("scores")).otherwise(F.zip_with("scores", "more", lambda x, y: x + y)).alias("_scores"),
        )
        best = F.array_max("_scores")
        second = F.element_at(F.sort_array("_scores", asc=False), 2) if len(langs) > 1 else best
        name = F.element_at(F.array(*[F.lit(x) for x in langs]), F.array_position("_scores", best).cast("int")) if langs else F.lit("error")
        unsure = (best - second < margin * F.col("_hits")) if margin and len(langs) > 1 else F.lit(False)
        by_grams = F.when(F.col("_hits") == 0, "error").when(unsure, "unknown").otherwise(name)
        return rows.join(whole, "_row").select(*kept, _decide(F.col(text_col), by_grams).alias(lang_col))


def language_detector(profile: DataFrame, margin: int = 0, most: int = MOST) -> LanguageDetector:
    """A function from a text column to its language code; its ``add`` takes a table and a profile of any size."""
    return LanguageDetector(profile, margin, most)


def detect_languages(
    df: DataFrame, profile: DataFrame, text_col: str = "text", lang_col: str = "lang", margin: int = 0, most: int = MOST
) -> DataFrame:
    """Adds the language of each row by all trigrams of a profile of any size."""
    return language_detector(profile, margin, most).add(df, text_col, lang_col)
