"""Language-model scoring: prediction by partial matching over bytes, and a word baseline.

The model is a trie of byte contexts (0 to ORDER bytes) with the counts of the next byte,
from all training texts. In a context with n seen bytes of d kinds, a kind that was seen c
times has c / (n + d); the rest, d / (n + d), escapes to the context that is one byte shorter,
where kinds that the longer contexts know are excluded from the counts. Below the empty
context all kinds left are equal. A text is its lower-cased bytes and an end (byte 0); the
score is the sum of log10 of each symbol's probability after its longest known context.

Counts are made and summed by Spark over every training text, and all contexts score. Tasks hold
the contexts seen most: the largest set by frequency that fits CONTEXTS, so the broadcast has a
fixed bound. A context's distribution is worked out once, so a task only looks rows up. Symbols
whose longest context may lie outside that set are counted per document; each distinct one is
scored from the whole table of contexts, and the documents are joined to these scores.

The baseline counts every distinct training word. The words of the frequency classes that fit
HOT_WORDS are broadcast, all others are joined.

Null texts are empty: one end token. Rows that repeat a doc_id are scored and returned each;
a null doc_id counts as the empty string for the fold. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.arrays import LOWER, Hasher, Words, text_blocks
from textloom.llm.ragged import Tally
from textloom.sources.scratch import settle

ORDER = 4
CONTEXTS = 1 << 15
HOT_WORDS = 1 << 19
END = 0x1F0D  # stands for the end token among word hashes
HELD_ENTRIES = 1 << 20


def fold(column: str, n: int):
    """crc32 of an id as text, modulo n."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n): counts of all words by hash, and of the ends."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, tally = Hasher(), Tally(kind=np.uint64)
        for _, rows in text_blocks(batches):
            tally.add(np.concatenate((hasher.words(Words(rows)), np.full(len(rows), END, np.uint64))))
            if len(tally.keys) > HELD_ENTRIES:
                yield tally.rows("word")
        yield tally.rows("word")

    return texts.mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _symbols(rows: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes with ``order`` zeros before each text; places of the coded symbols; number of them per text."""
    pad = b"\0" * order
    data = np.frombuffer((pad + pad.join(r.translate(LOWER) for r in rows) + pad), np.uint8)
    lengths = np.fromiter(map(len, rows), np.int64, len(rows))
    coded = np.ones(len(data) - order, bool)
    ends = np.cumsum(lengths + order) - order  # place of each text's end, after the first padding
    for j in range(1, order):
        coded[(ends + j)[ends + j < len(coded)]] = False
    return data, np.flatnonzero(coded) + order, lengths + 1


def gram_counts(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, n): counts of each symbol after its ``order`` bytes of context, packed into one number."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally(kind=np.uint64)
        for _, rows in text_blocks(batches):
            data, places, _ = _symbols(rows, order)
            grams = np.zeros(len(places), np.uint64)
            for back in range(order, -1, -1):
                grams <<= np.uint64(8)
                grams |= data[places - back]
            tally.add(grams)
            if len(tally.keys) > HELD_ENTRIES:
                yield tally.rows("gram")
        yield tally.rows("gram")

    return texts.mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def _lowest_class(table: DataFrame, count: str, limit: int, per_octave: int) -> int:
    """Smallest frequency class such that it and those above have ``limit`` rows at most."""
    level = F.floor(F.log2(count) * per_octave).alias("level")
    total, lowest = 0, None
    for r in sorted(table.groupBy(level).agg(F.count("*").alias("rows")).collect(), reverse=True):  # 64 * per_octave at most
        total += r["rows"]
        if total > limit:
            break
        lowest = r["level"]
    return lowest if lowest is not None else 1 << 20


def trie(grams: DataFrame, order: int = ORDER, contexts: int = CONTEXTS) -> tuple[pa.Table, DataFrame]:
    """(depth, context, symbol, n) of the most frequent contexts, about ``contexts`` of them at most, and of all others."""
    depth = F.explode(F.sequence(F.lit(0), F.lit(order))).alias("depth")
    nodes = grams.select("gram", "n", depth).select(
        "depth",
        F.shiftright("gram", 8).bitwiseAND(F.expr("shiftleft(1L, 8 * depth) - 1")).alias("context"),
        F.col("gram").bitwiseAND(255).alias("symbol"),
        "n",
    )
    nodes = settle(nodes.groupBy("depth", "context", "symbol").agg(F.sum("n").alias("n")), "trie")
    totals = settle(nodes.groupBy("depth", "context").agg(F.sum("n").alias("total")), "contexts")
    level = _lowest_class(totals, "total", contexts, 16)
    hot = (F.floor(F.log2("total") * 16) >= level) | (F.col("depth") == 0)
    kept, rest = (totals.where(c).select("depth", "context") for c in (hot, ~hot))
    return nodes.join(kept, ["depth", "context"]).toArrow(), nodes.join(rest, ["depth", "context"])


def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
    return np.where(keys[at] == wanted, at, -1) if len(keys) else np.full(len(wanted), -1)


class Model:
    """``log10[node, symbol]`` and ``deeper[node, byte before]``; node 0 is the empty context."""

    def __init__(self, rows: pa.Table, order: int = ORDER):
        depth, context, symbol, n = (rows.column(c).to_numpy() for c in ("depth", "context", "symbol", "n"))
        key = depth.astype(np.int64) << 56 | context
        keys, where = np.unique(np.append(key, 0), return_inverse=True)
        counts = np.zeros((len(keys), 256), np.float64)
        counts[where[:-1], symbol] = n
        depths, contexts = keys >> 56, keys & ((1 << 56) - 1)
        shorter = np.where(depths > 0, contexts & ((1 << 8 * np.maximum(depths - 1, 0)) - 1), 0)
        suffix = _find(keys, np.maximum(depths - 1, 0) << 56 | shorter)
        self.order = order
        self.deeper = np.full((len(keys), 256), -1, np.int16 if len(keys) < 1 << 15 else np.int32)
        child = np.flatnonzero(depths > 0)
        self.deeper[suffix[child], contexts[child] >> 8 * (depths[child] - 1)] = child
        self.log10 = np.empty((len(keys), 256), np.float32)
        for low in range(0, len(keys), 4096):
            part = slice(low, low + 4096)
            self.log10[part] = np.log10(_distributions(counts, suffix, np.arange(len(keys))[part], order))

    def score(self, rows: list[bytes]) -> np.ndarray:
        """log10 probability of each text and its end."""
        return self.parts(rows, whole=True)[0]

    def parts(self, rows: list[bytes], whole: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """log10 probability of each text; the (text, gram, times) of symbols that a longer context outside the model may score.

        If the model is the ``whole`` trie there are none; otherwise the probability leaves them out.
        """
        data, places, lengths = _symbols(rows, self.order)
        node = np.zeros(len(places), np.int64)
        live = np.arange(len(places))
        for back in range(1, self.order + 1):
            step = self.deeper[node[live], data[places[live] - back]]
            known = step >= 0
            live = live[known]
            node[live] = step[known]
        terms = self.log10[node, data[places]].astype(np.float64)
        left = np.ones(len(places), bool)
        left[live] = False
        left = np.flatnonzero(left & (not whole))
        terms[left] = 0
        grams = np.zeros(len(left), np.int64)
        for back in range(self.order, -1, -1):
            grams = grams << 8 | data[places[left] - back]
        owner = np.repeat(np.arange(len(rows)), lengths)[left]
        by = np.lexsort((grams, owner))
        owner, grams = owner[by], grams[by]
        first = np.flatnonzero((np.diff(owner, prepend=-1) != 0) | (np.diff(grams, prepend=-1) != 0))
        times = np.diff(np.append(first, len(grams)))
        return np.add.reduceat(terms, np.concatenate(([0], np.cumsum(lengths)[:-1]))), owner[first], grams[first], times


def gram_scores(wanted: DataFrame, hot: pa.Table, rest: DataFrame, order: int) -> DataFrame:
    """(gram, log10) of each ``gram`` of ``wanted`` by the whole trie: the ``hot`` part and the ``rest``."""
    by_context = wanted.groupBy(F.shiftright("gram", 8).alias("c")).agg(F.collect_set(F.col("gram").bitwiseAND(255)).alias("symbols"))
    lists = rest.groupBy("depth", "context").agg(F.collect_list("symbol").alias("s"), F.collect_list("n").alias("n"))
    lists = settle(lists, "lists")
    for k in range(1, order + 1):
        own = lists.where(F.col("depth") == k).select(F.col("context").alias(f"c{k}"), F.col("s").alias(f"s{k}"), F.col("n").alias(f"n{k}"))
        by_context = by_context.withColumn(f"c{k}", F.col("c").bitwiseAND((1 << 8 * k) - 1)).join(own, f"c{k}", "left")
    columns = [x for k in range(1, order + 1) for x in (f"s{k}", f"n{k}")]
    share = wanted.sparkSession.sparkContext.broadcast(hot)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = share.value
        depth, context, symbol, n = (known.column(c).to_numpy() for c in ("depth", "context", "symbol", "n"))
        keys, where = np.unique(depth.astype(np.int64) << 56 | context, return_inverse=True)
        counts = np.zeros((len(keys) + 1, 256), np.float32)  # the last row is of contexts that are not hot
        counts[where, symbol] = n
        for whole in batches:
            for low in range(0, whole.num_rows, 1024):
                batch = whole.slice(low, 1024)
                contexts = batch.column("c").to_numpy()
                chain = []
                for k in range(order, -1, -1):
                    level = counts[_find(keys, k << 56 | contexts & ((1 << 8 * k) - 1))].astype(np.float64)
                    if k:
                        symbols, times = batch.column(f"s{k}"), batch.column(f"n{k}")
                        rows = np.repeat(np.arange(len(contexts)), symbols.value_lengths().fill_null(0).to_numpy())
                        level[rows, symbols.flatten().to_numpy()] = times.flatten().to_numpy()
                    chain.append(level)
                logs = np.log10(_chained(chain))
                symbols = batch.column("symbols")
                rows, symbols = np.repeat(np.arange(len(contexts)), symbols.value_lengths().to_numpy()), symbols.flatten().to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(contexts[rows] << 8 | symbols), pa.array(logs[rows, symbols])], ["gram", "log10"])

    return by_context.select("c", "symbols", *columns).mapInArrow(score, "gram long, log10 double")


def _distributions(counts: np.ndarray, suffix: np.ndarray, nodes: np.ndarray, order: int) -> np.ndarray:
    def chain() -> Iterator[np.ndarray]:
        at = nodes
        for _ in range(order + 1):
            yield counts[at]
            at = suffix[at]

    return _chained(chain())


def _chained(chain: Iterable[np.ndarray]) -> np.ndarray:
    """Distributions from the counts in the longest contexts and then in each shorter one."""
    out = None
    for counts in chain:
        if out is None:
            out, escape, excluded = np.zeros(counts.shape), np.ones((len(counts), 1)), np.zeros(counts.shape, bool)
        here = np.where(excluded, 0, counts)
        n, kinds = here.sum(1, keepdims=True), (here > 0).sum(1, keepdims=True)
        whole = np.maximum(n + kinds, 1)
        out += escape * here / whole
        escape = np.where(kinds > 0, escape * kinds / whole, escape)
        excluded |= here > 0
    left = 256 - excluded.sum(1, keepdims=True)
    out += np.where(excluded, 0, escape / np.maximum(left, 1))
    return out / out.sum(1, keepdims=True)


def score_texts(docs: DataFrame, folds: int = 10, order: int = ORDER, contexts: int = CONTEXTS, hot_words: int = HOT_WORDS) -> DataFrame:
    """Per document the word baseline and the model's log10 probability; fold 0 is held out."""
    docs = docs.select("doc_id", (fold("doc_id", folds) == 0).alias("held_out"), F.col("text").cast("binary").alias("text"))
    train = docs.where("not held_out").select("text")
    counts = settle(word_counts(train), "words")
    total, distinct = counts.select(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    floor = total + 0.1 * (distinct + 1)
    level = _lowest_class(counts, "n", hot_words, 8)
    hot = (F.floor(F.log2("n") * 8) >= level) | (F.col("word") == END)
    table = counts.where(hot).toArrow()
    keys = table.column("word").to_numpy().view(np.uint64)
    by_key = np.argsort(keys)
    logs = np.log10((table.column("n").to_numpy()[by_key] + 0.1) / floor)
    grams = settle(gram_counts(train, order), "grams")
    frequent, others = trie(grams, order, contexts)
    model, whole = Model(frequent, order), others.isEmpty()
    share = docs.sparkSession.sparkContext.broadcast((keys[by_key], logs, model.order, model.deeper, model.log10))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        words_known, word_logs, *parts = share.value
        model = Model.__new__(Model)
        model.order, model.deeper, model.log10 = parts
        first = TaskContext.get().partitionId() << 36
        for batch, rows in text_blocks(batches):
            words = Words(rows)
            hashes = np.concatenate((hasher.words(words), np.full(len(rows), END, np.uint64)))
            owner = np.concatenate((words.text_of_word(), np.arange(len(rows))))
            found = _find(words_known, hashes)
            known = found >= 0
            sums = np.bincount(owner[known], word_logs[found[known]] if len(word_logs) else None, len(rows))
            rare, whose = hashes[~known], owner[~known]
            by_text = np.argsort(whose, kind="stable")
            own, of, grams, times = model.parts(rows, whole)

            def listed(values: np.ndarray, texts: np.ndarray) -> pa.Array:
                offsets = np.concatenate(([0], np.cumsum(np.bincount(texts, minlength=len(rows)))))
                return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))

            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(first + np.arange(len(rows))),
                    batch.column("doc_id"),
                    batch.column("held_out"),
                    pa.array(words.counts + 1),
                    pa.array(np.bincount(owner[known], minlength=len(rows))),
                    pa.array(sums.astype(np.float64)),
                    pa.array(own),
                    listed(rare[by_text].view(np.int64), whose),
                    listed(grams, of),
                    listed(times, of),
                ],
                ["row", "doc_id", "held_out", "n_tokens", "known", "sum", "own", "rare", "grams", "times"],
            )
            first += len(rows)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"row long, doc_id {kind}, held_out boolean, n_tokens long, known long, sum double, own double, rare array<long>"
    schema += ", grams array<long>, times array<long>"
    scored = settle(docs.mapInArrow(score, schema), "scored")
    rare = scored.select("row", F.explode("rare").alias("word")).join(counts.where(~hot), "word", "left")
    base = F.log10((F.coalesce("n", F.lit(0)) + 0.1) / F.lit(floor))
    rare = rare.groupBy("row").agg(F.sum(base).alias("more"), F.count("n").alias("more_known"))
    result = scored.drop("rare", "grams", "times").join(rare, "row", "left")
    score_column = F.col("own")
    if not whole:
        left = scored.select("row", F.explode(F.arrays_zip("grams", "times")).alias("g")).select("row", "g.grams", "g.times")
        left = left.withColumnRenamed("grams", "gram")
        logs = settle(gram_scores(left.select("gram").distinct(), frequent, others, order), "gram scores")
        left = left.join(logs, "gram").groupBy("row").agg(F.sum(F.col("times") * F.col("log10")).alias("left"))
        result = result.join(left, "row", "left")
        score_column = F.col("own") + F.coalesce("left", F.lit(0.0))
    return result.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("sum") + F.coalesce("more", F.lit(0.0))).alias("base_score"),
        score_column.alias("score"),
    )
