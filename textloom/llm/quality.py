"""Quality: supervised subword embeddings with a softmax, trained by stochastic gradient descent.

Each word and each run of 3 and 4 bytes of a text (a space as the edge of words) is hashed to a
row of a table of learned vectors; a word pair that is the same word twice shares one row. A document is the mean of its vectors; a linear layer
and a softmax give the classes. Vectors and layer are learnt together.

Once trained, a row's share of the difference between the two classes is one number, so tasks
hold one float for each bucket: a table of fixed size, whatever the corpus.

Learning reads at most ``max_rows`` labelled rows in one task; that bound is a parameter.
Scoring reads every whole text. Null and empty texts have no features: their score is that of
the layer's bias. Without labels each score is 0.5. Labels that are null or not 0 or 1 teach
nothing. Rows that repeat a doc_id are scored each; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.arrays import BASE, SPACES, Hasher, Words, byte_mask, mix, text_blocks
from textloom.llm.ppm import fold
from textloom.llm.toxicity import labelled

MAX_ROWS = 6_000
BUCKET_BITS = 18
WIDTHS = (3, 4)
SAME = 1  # bucket of a word that repeats the one before
DIMENSIONS = 8
EPOCHS = 6
RATE = 1.5


def features(rows: list[bytes], hasher: Hasher) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text) of all words and byte runs of a block of texts, with repeats."""
    words = Words(rows, None)
    shift = np.uint64(64 - BUCKET_BITS)
    buckets, owners = [(hasher.words(words) >> shift).astype(np.int32)], [words.text_of_word().astype(np.int32)]
    same = (buckets[0][1:] == buckets[0][:-1]) & (owners[0][1:] == owners[0][:-1])
    buckets.append(np.full(int(same.sum()), SAME, np.int32))
    owners.append(owners[0][1:][same])
    data = np.where(byte_mask(SPACES)[words.data], np.uint8(32), words.data)
    text = np.repeat(np.arange(len(rows), dtype=np.int32), np.diff(np.concatenate(([0], words.text_ends))))
    for width in WIDTHS:
        n = len(data) - width + 1
        if n <= 0:
            continue
        run = np.zeros(n, np.uint32)
        for j in range(width):
            run = run << np.uint32(8) | data[j : j + n]
        inside = text[:n] == text[width - 1 :]
        hashed = (run[inside].astype(np.uint64) + np.uint64(width << 40)) * np.uint64(BASE)
        buckets.append((mix(hashed) >> shift).astype(np.int32))
        owners.append(text[:n][inside])
    return np.concatenate(buckets), np.concatenate(owners)


def bags(rows: list[bytes], hasher: Hasher) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per text its distinct buckets and their shares."""
    buckets, owners = features(rows, hasher)
    key, n = np.unique(owners.astype(np.int64) << BUCKET_BITS | buckets, return_counts=True)
    cuts = np.searchsorted(key >> BUCKET_BITS, np.arange(len(rows) + 1))
    out = []
    for a, b in zip(cuts[:-1], cuts[1:]):
        share = n[a:b].astype(np.float32)
        out.append(((key[a:b] & ((1 << BUCKET_BITS) - 1)).astype(np.int32), share / max(share.sum(), 1)))
    return out


def embed_and_train(texts: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """(per bucket its share of the logit of class 1, bias)."""
    random = np.random.default_rng(11)
    vectors = random.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (1 << BUCKET_BITS, DIMENSIONS)).astype(np.float32)
    layer, bias = np.zeros((DIMENSIONS, 2), np.float32), np.zeros(2, np.float32)
    total, done = epochs * len(texts), 0
    for _ in range(epochs):
        for k in random.permutation(len(texts)):
            buckets, share = texts[k]
            rate = RATE * (1 - done / total)
            done += 1
            mean = share @ vectors[buckets]
            logits = mean @ layer + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[labels[k]] -= 1
            back = layer @ p
            layer -= rate * np.outer(mean, p)
            bias -= 0.1 * rate * p
            # A distinct bucket moves by its share of the text, raised so that long texts also teach.
            vectors[buckets] -= rate * np.outer(share * np.float32(len(share) ** 0.5), back)
    return (vectors @ (layer[:, 1] - layer[:, 0])).astype(np.float32), float(bias[1] - bias[0])


def train(texts: DataFrame) -> tuple[np.ndarray, float]:
    """The folded table from (text, label), a sample of bounded size in one partition."""

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, own, labels = Hasher(), [], []
        for batch, rows in text_blocks(batches):
            own += bags(rows, hasher)
            labels += batch.column("label").to_pylist()
        table, bias = embed_and_train(own, np.array(labels, np.int64)) if own else (np.zeros(1 << BUCKET_BITS, np.float32), 0.0)
        yield pa.RecordBatch.from_arrays([pa.array([table.tobytes()]), pa.array([bias])], ["table", "bias"])

    rows = texts.select(F.col("text").cast("binary").alias("text"), "label").mapInArrow(learn, "table binary, bias double").collect()
    if not rows:
        return np.zeros(1 << BUCKET_BITS, np.float32), 0.0
    return np.frombuffer(rows[0]["table"], np.float32), rows[0]["bias"]


def quality(docs: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2, threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row; the score is the probability of label 1."""
    shared = docs.sparkSession.sparkContext.broadcast(train(labelled(docs, labels, "quality", folds, held_out, MAX_ROWS)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, (table, bias) = Hasher(), shared.value
        for batch, rows in text_blocks(batches):
            buckets, owners = features(rows, hasher)
            n = np.bincount(owners, minlength=len(rows))
            logit = bias + np.bincount(owners, table[buckets], len(rows)) / np.maximum(n, 1)
            score = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
            columns = [batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select("doc_id", (fold("doc_id", folds) == held_out).alias("held_out"), F.col("text").cast("binary").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")
