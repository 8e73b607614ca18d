"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are the distinct hashes of its words, of neighbouring words, and of words
with one word between. Training goes over labelled texts one by one; each coordinate has its
own rate, and the L1 term keeps weights at zero until enough evidence speaks for them. What
is left is a short list of hashes and weights, which every task holds.

Learning reads at most ``max_rows`` labelled rows, those with the smallest hash of their id, in
one task; that bound is a parameter of the model. Scoring reads every whole text.

Labels that are null or not 0 or 1 teach nothing; an id with several labels counts for each.
Null and empty texts have no features and get the score of the bias. Without labels all
weights are zero and each score is 0.5. Rows that repeat a doc_id are scored each; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.llm.arrays import LOWER, Hasher, Words, byte_mask, chains, give_back, text_blocks
from textloom.llm.decontam import PARTING
from textloom.llm.ppm import fold
from textloom.sources.scratch import settle

MAX_ROWS = 12_000
LEAST_TEXTS = 3  # a feature of fewer training texts is left out
EPOCHS = 8
ALPHA, BETA, L1, L2 = 2.0, 1.0, 8.0, 0.0
COUNT_BITS = 22
RANGES = 64  # of hashes, which are looked at one after another

# Names that no column of the input has: they end in a space.
TEXT, SCORE = "text ", "score "
FILTER_BITS = 22


def features(rows: list[bytes], hasher: Hasher) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of all features of a block of texts, with repeats."""
    words = Words(rows, LOWER, byte_mask(PARTING))
    one, text = hasher.words(words), words.text_of_word()
    hashes, owners = [one], [text]
    for gap in (1, 2):
        pair = chains(one, 2, gap)
        same = text[gap:] == text[:-gap] if len(text) > gap else np.zeros(0, bool)
        hashes.append(pair[same])
        owners.append(text[gap:][same])
    return np.concatenate(hashes), np.concatenate(owners)


def distinct_features(rows: list[bytes], hasher: Hasher) -> list[np.ndarray]:
    hashes, owners = features(rows, hasher)
    order = np.argsort(owners, kind="stable")
    return [np.unique(h) for h in np.split(hashes[order], np.cumsum(np.bincount(owners, minlength=len(rows)))[:-1])]


def buckets(s: np.ndarray) -> np.ndarray:
    return (s & np.uint64((1 << COUNT_BITS) - 1)).astype(np.int64)


def count_texts(sets: list[np.ndarray], counts: np.ndarray) -> None:
    """Adds to each hash bucket the texts that have it, up to LEAST_TEXTS."""
    for s in sets:
        at = np.unique(buckets(s))
        counts[at] = np.minimum(counts[at] + 1, LEAST_TEXTS)


def frequent(sets: list[np.ndarray], counts: np.ndarray) -> list[np.ndarray]:
    """The sets without most features of fewer than LEAST_TEXTS texts, by counts per hash bucket."""
    return [s[counts[buckets(s)] >= LEAST_TEXTS] for s in sets]


def without_rare(sets: list[np.ndarray]) -> list[np.ndarray]:
    counts = np.zeros(1 << COUNT_BITS, np.uint8)
    count_texts(sets, counts)
    return frequent(sets, counts)


def frequent_features(blocks: list[list[bytes]]) -> list[np.ndarray]:
    """The sets of all texts of some blocks without rare features.

    The features are made twice, so that those of all texts are never held together: most are rare.
    The list of blocks is empty at the end.
    """
    hasher, counts, sets = Hasher(), np.zeros(1 << COUNT_BITS, np.uint8), []
    for rows in blocks:
        count_texts(distinct_features(rows, hasher), counts)
    give_back()
    while blocks:
        sets += frequent(distinct_features(blocks.pop(0), hasher), counts)
    return sets


def shared_keys(sets: list[np.ndarray]) -> np.ndarray:
    """The hashes that LEAST_TEXTS of the sets have, ascending; each set ascends. One range of hashes at a time is put together."""
    edges = np.arange(1, RANGES, dtype=np.uint64) * np.uint64((1 << 64) // RANGES)
    cuts = np.array([[0, *np.searchsorted(s, edges), len(s)] for s in sets], np.int32).reshape(-1, RANGES + 1)
    far, keys = LEAST_TEXTS - 1, []  # a text has a feature once
    for k in range(RANGES):
        every = np.concatenate([s[a:b] for s, a, b in zip(sets, cuts[:, k].tolist(), cuts[:, k + 1].tolist())])
        every.sort()
        keys.append(np.unique(every[: len(every) - far][every[: len(every) - far] == every[far:]]))
    return np.concatenate(keys)


def ftrl(sets: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray, float]:
    """(hashes, weights, bias) of the weights that are not zero, from sets without rare features; the list is used up."""
    if not len(sets):
        return np.zeros(0, np.uint64), np.zeros(0), 0.0
    keys = shared_keys(sets)
    z, s = np.zeros(len(keys) + 1), np.zeros(len(keys) + 1)  # the last is the bias, without L1
    index = sets
    for k, x in enumerate(sets):
        at = np.searchsorted(keys, x)
        at = at[at < len(keys)]
        x = x[: len(at)] if len(at) == len(x) else x[np.searchsorted(keys, x) < len(keys)]
        index[k] = np.append(at[keys[at] == x], len(keys)).astype(np.int32)
    penalty = np.full(len(keys) + 1, L1)
    penalty[-1] = 0

    def weights(i: np.ndarray) -> np.ndarray:
        over = np.abs(z[i]) - penalty[i]
        return np.where(over > 0, -np.sign(z[i]) * over / ((BETA + np.sqrt(s[i])) / ALPHA + L2), 0.0)

    order = np.random.default_rng(7)
    for _ in range(epochs):
        for k in order.permutation(len(index)):
            i = index[k]
            w = weights(i)
            p = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30)))
            g = p - labels[k]
            sigma = (np.sqrt(s[i] + g * g) - np.sqrt(s[i])) / ALPHA
            z[i] += g - sigma * w
            s[i] += g * g
    w = weights(np.arange(len(keys) + 1))
    kept = np.flatnonzero(w[:-1])
    return keys[kept], w[kept], float(w[-1])


def train(texts: DataFrame) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights from (text, label), a sample of bounded size in one partition."""

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, labels = [], []
        for batch, rows in text_blocks(batches):
            blocks.append(rows)
            labels += batch.column("label").to_pylist()
        keys, w, bias = ftrl(frequent_features(blocks), np.array(labels, float))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(keys.view(np.int64), 0)), pa.array(np.append(w, bias)), pa.array([False] * len(keys) + [True])],
            ["key", "weight", "is_bias"],
        )

    rows = texts.select(F.col("text").cast("binary").alias("text"), "label").mapInArrow(
        learn, "key long, weight double, is_bias boolean"
    )
    got = rows.toArrow()  # no more weights than features of the bounded sample
    keys, weights = got.column("key").to_numpy().view(np.uint64), got.column("weight").to_numpy()
    bias = got.column("is_bias").to_numpy(zero_copy_only=False).astype(bool)
    return keys[~bias], weights[~bias], float(weights[bias].sum())


def labelled(docs: DataFrame, labels: DataFrame, name: str, folds: int, held_out: int, max_rows: int = MAX_ROWS) -> DataFrame:
    """(text, label) of rows that may teach, in one partition: ``max_rows`` of them at most, in a fixed order."""
    order = (F.xxhash64("doc_id"), "doc_id", "label")
    known = labels.select("doc_id", F.col(name).cast("int").alias("label")).where("label in (0, 1)").distinct()
    own = docs.select("doc_id").where(fold("doc_id", folds) != held_out)
    sample = settle(known.join(own, "doc_id", "left_semi").orderBy(*order).limit(max_rows), "sample")
    # The sample has a fixed bound; ids that rows repeat are cut to the bound again.
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id")
    rows = settle(rows, "taught").orderBy(*order, F.xxhash64("text")).limit(max_rows)
    return rows.select("text", "label").coalesce(1)


def with_bytes(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The batch with its texts as bytes, which share their memory."""
    if TEXT in batch.schema.names:
        return batch
    return batch.append_column(TEXT, batch.column(batch.schema.names.index("text")).cast(pa.binary()))


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], keep: list[str]) -> DataFrame:
    """``keep`` columns of ``docs`` and, in the column SCORE, the score of each whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    bits = np.uint64((1 << FILTER_BITS) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, (keys, weights, bias) = Hasher(), shared.value
        may = np.zeros(1 << FILTER_BITS, bool)
        may[(keys & bits).astype(np.int64)] = True
        for batch, rows in text_blocks(map(with_bytes, batches), TEXT):
            total = np.full(len(rows), bias)
            hashes, owners = features(rows, hasher)
            near = may[(hashes & bits).astype(np.int64)]
            hashes, owners = hashes[near], owners[near]
            if len(keys) and len(hashes):
                at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
                hit = keys[at] == hashes
                pairs = np.unique(owners[hit].astype(np.int64) * len(keys) + at[hit])
                total += np.bincount(pairs // len(keys), weights[pairs % len(keys)], len(rows))
            columns = [batch.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(1 / (1 + np.exp(-np.clip(total, -30, 30))))], [*keep, SCORE])

    # A kept text goes to Python once.
    kept = "text" in keep and docs.schema["text"].dataType == T.StringType()
    rows = docs.select(*keep) if kept else docs.select(*keep, F.col("text").cast("binary").alias(TEXT))
    return rows.mapInArrow(run, rows.drop(TEXT).schema.add(SCORE, "double"))


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1, threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    model = train(labelled(docs, labels, "toxic", folds, held_out))
    rows = docs.select("doc_id", (fold("doc_id", folds) == held_out).alias("held_out"), "text")
    scored = score(rows, model, ["doc_id", "held_out"]).withColumnRenamed(SCORE, "score")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, all columns as they were."""
    model = train(labelled(docs, labels, "toxic", 3, 1))
    return score(docs, model, docs.columns).where(F.col(SCORE) < threshold).select(*docs.columns)
