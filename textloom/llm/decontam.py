"""Benchmark decontamination with an Aho-Corasick automaton over normalised items.

Texts are normalised to lower-case words between single spaces. Every window of
``width`` consecutive item words (an item of fewer words is one window) is a pattern, bounded
by spaces, so that a match begins and ends at a word. The automaton reads each text once and
reports all patterns, overlapping ones too. Words inside a match are hits; their places are
mapped back to code points of the original text.

A benchmark of up to ``pattern_limit`` bytes of patterns is one automaton, which each worker builds
once. A larger one is dealt to parts by hashes of its windows, and the texts are read once all the same:

1. A filter of fixed size holds the hashes of all windows. Each document looks up its own windows
   and so learns which parts may find something in it; most learn that none does.
2. Those documents go to the tasks of their parts, many tasks for a part with many documents. A
   task reads its part's patterns first, builds their automaton, and scans its documents.
3. Hits and found windows are put together per document; windows lead to items by a join.

Null or wordless texts have no words and are clean. Null or wordless items have no windows.
Items that share a window are all counted; rows that repeat an item_id count once. The windows
of items with a null item_id hit words like all others; all such items count once in n_items, as
rows of one id do, and are left out of the digest, as in the SQL. All rows are returned, also with repeated doc_ids; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from textloom.llm.arrays import LOWER, Hasher, Words, byte_mask, chains, mix, text_blocks
from textloom.sources.scratch import settle

WIDTH = 13
SHARE = 20
PATTERN_BYTES = 4 << 20  # a node takes some 50 bytes

FILTER_BITS = 28  # a filter of 32 MB: of 10^7 windows, four places each, one in 2,000 others seems to be one
PROBES = 4
TASK_BYTES = 64 << 20  # texts that one task scans for one part

# Names that no column of the input has: they end in a space.
TEXT, KEY, SIZE, WORDS, PARTS = "text ", "key ", "size ", "n_words ", "parts "
RESULT = {"n_words ": "long", "n_hit ": "long", "n_items ": "long", "items_sha256 ": "string", "contaminated ": "boolean", "spans ": "string"}

# Bytes that part words after lower-casing.
PARTING = bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
NORMAL = bytes(32 if b in PARTING else b for b in LOWER)


def normal_words(text: bytes) -> list[bytes]:
    return text.translate(NORMAL).split()


def windows(words: list[bytes], width: int) -> list[bytes]:
    """Patterns of an item."""
    if not words:
        return []
    return [b" %b " % b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]


def automaton_of(patterns: list[bytes]):
    import ahocorasick

    found = ahocorasick.Automaton()
    for i, pattern in enumerate(patterns):
        found.add_word(pattern.decode("latin-1"), (pattern.count(b" ") - 1, i))
    if patterns:
        found.make_automaton()
    return found if patterns else None


def find(automaton, text: bytes) -> tuple[np.ndarray, set[int]]:
    """Whether each word of a text is hit, and the patterns that occur."""
    words = normal_words(text)
    flags, who = np.zeros(len(words), bool), set()
    if automaton is not None and words:
        normal = b" %b " % b" ".join(words)
        hits = set()
        for end, (n, i) in automaton.iter(normal.decode("latin-1")):
            hits.add((end, n))
            who.add(i)
        if hits:
            places = np.cumsum(np.frombuffer(normal, np.uint8) == 32) - 2
            for end, n in hits:
                stop = places[end] + 1
                flags[stop - n : stop] = True
    return flags, who


def _ranges(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.flatnonzero(np.diff(flags.astype(np.int8), prepend=0, append=0))
    return edges[0::2], edges[1::2]


def _spans(text: bytes, flags: np.ndarray) -> str:
    """Runs of hit words as code point ranges of the original text."""
    words = Words([text], LOWER, byte_mask(PARTING))
    lead = np.concatenate(([0], np.cumsum((words.data & 0xC0) != 0x80)))
    first, after = _ranges(flags)
    return ",".join(f"{lead[words.starts[a]]}:{lead[words.ends[b - 1]]}" for a, b in zip(first, after))


def _scan(docs: DataFrame, items: list[tuple[str | None, bytes]], keep: list[str], width: int, share: int) -> DataFrame:
    """``keep`` columns and the result, by one automaton for all items."""
    # A Python worker keeps a broadcast's value between its tasks, and so the automaton.
    process = docs.sparkSession.sparkContext.broadcast({"items": items})

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if "automaton" not in process.value:
            of: dict[bytes, set[str | None]] = {}
            for name, text in process.value["items"]:
                for w in windows(normal_words(text), width):
                    of.setdefault(w, set()).add(name)
            process.value.update(automaton=automaton_of(list(of)), owners=list(of.values()))
        automaton, owners = process.value["automaton"], process.value["owners"]
        for batch, rows in text_blocks(batches, TEXT):
            found = [find(automaton, text) for text in rows]
            n = np.array([len(f) for f, _ in found], np.int64)
            hit = np.array([int(f.sum()) for f, _ in found], np.int64)
            items = [set().union(*(owners[i] for i in who)) for _, who in found]
            digests = [hashlib.sha256(",".join(sorted(x - {None})).encode()).hexdigest() for x in items]
            spans = [_spans(text, f) if h else "" for text, (f, _), h in zip(rows, found, hit)]
            result = [n, hit, np.array([len(x) for x in items], np.int64), digests, (hit > 0) & (share * hit >= n), spans]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *map(pa.array, result)], [*keep, *RESULT])

    return docs.mapInArrow(scan, _schema(docs, keep, RESULT))


def _schema(rows: DataFrame, keep: list[str], more: dict):
    schema = rows.select(keep).schema
    for name, kind in more.items():
        schema = schema.add(name, kind)
    return schema


def _item_windows(items: DataFrame, width: int) -> DataFrame:
    """(item, h, n, pattern): the windows of items, with hash and number of words."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch, rows in text_blocks(batches):
            words = Words(rows, LOWER, byte_mask(PARTING))
            hashes = hasher.words(words)
            for item, text, a, b in zip(batch.column("item").to_pylist(), rows, words.first[:-1], words.first[1:]):
                patterns = windows(normal_words(text), width)
                n = min(width, int(b - a))
                h = chains(hashes[a:b], n).view(np.int64) if patterns else np.empty(0, np.int64)
                columns = [pa.array([item] * len(h), pa.string()), pa.array(h), pa.array([n] * len(h), pa.int32()), pa.array(patterns, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["item", "h", "n", "pattern"])

    return items.mapInArrow(cut, "item string, h long, n int, pattern binary")


def _place(h: np.ndarray, k: int, bits: int) -> np.ndarray:
    """The k-th place of hashes in the filter."""
    return (mix(h + np.uint64(k + 1)) >> np.uint64(64 - bits)).astype(np.int64)


def _filter(found: DataFrame, bits: int) -> np.ndarray:
    """A bitmap of fixed size with the places of all hashes, put together in pieces of 4 KB."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column("h").to_numpy().view(np.uint64)
            at = np.unique([_place(h, k, bits) for k in range(PROBES)])
            yield pa.RecordBatch.from_arrays([pa.array(at + 1)], ["at"])  # the functions below count from 1

    at = found.select("h").distinct().mapInArrow(places, "at long")
    piece = F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")
    out = np.zeros(1 << max(bits - 3, 12), np.uint8)
    for r in at.groupBy(F.bitmap_bucket_number("at").alias("b")).agg(piece).collect():  # the filter's fixed size
        out[(r["b"] - 1) << 12 : r["b"] << 12] = np.frombuffer(r["bits"], np.uint8)
    return out


def _with_parts(docs: DataFrame, keep: list[str], found: DataFrame, n_parts: int, bits: int) -> DataFrame:
    """``keep`` columns, number of words, and for documents of parts that may find something the text and those parts."""
    widths = sorted(r["n"] for r in found.select("n").distinct().collect())  # at most the width of a window
    shared = docs.sparkSession.sparkContext.broadcast(_filter(found, bits))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, bitmap = Hasher(), shared.value
        for batch, rows in text_blocks(batches, TEXT):
            words = Words(rows, LOWER, byte_mask(PARTING))
            hashes, of_word = hasher.words(words), words.text_of_word()
            parts: list[set[int]] = [set() for _ in rows]
            for n in widths:
                runs = chains(hashes, n)
                inside = of_word[: len(runs)] == of_word[n - 1 :][: len(runs)]
                here, runs = np.flatnonzero(inside), runs[inside]
                for k in range(PROBES):
                    at = _place(runs, k, bits)
                    known = (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
                    here, runs = here[known], runs[known]
                for i, part in zip(of_word[here].tolist(), (runs % np.uint64(n_parts)).tolist()):
                    parts[i].add(part)
            columns = [
                pa.array(words.counts.astype(np.int64)),
                pa.array([t if p else None for t, p in zip(rows, parts)], pa.binary()),
                pa.array([len(t) for t in rows], pa.int64()),
                pa.array([sorted(p) for p in parts], pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *columns], [*keep, WORDS, TEXT, SIZE, PARTS])

    more = {WORDS: "long", TEXT: "binary", SIZE: "long", PARTS: ArrayType(LongType())}
    looked = docs.mapInArrow(look, _schema(docs, keep, more))
    return settle(looked.withColumn(KEY, F.monotonically_increasing_id()), "looked")


def _scan_parts(looked: DataFrame, found: DataFrame, n_parts: int) -> DataFrame:
    """(key, patterns, runs): per document and part the windows that occur and the runs of hit words."""
    texts = looked.select(KEY, TEXT, SIZE, F.explode(PARTS).alias("part"))
    # Parts with many documents are split; each share gets the part's patterns.
    shares = texts.groupBy("part").agg(F.greatest(F.ceil(F.sum(SIZE) / TASK_BYTES), F.lit(1)).alias("shares"))
    texts = texts.join(shares, "part").withColumn("share", F.pmod(F.xxhash64(KEY), "shares"))
    patterns = found.select("pattern", _part("h", n_parts).alias("part")).distinct()
    patterns = patterns.join(shares, "part").withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
    rows = patterns.select("part", "share", F.lit(None).cast("long").alias(KEY), F.col("pattern").alias(TEXT))
    rows = rows.unionByName(texts.select("part", "share", KEY, TEXT)).repartition("part", "share")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, patterns, automaton = None, [], None
        for batch, rows in text_blocks(batches, TEXT):
            out = []
            for part, share, key, text in zip(*(batch.column(c).to_pylist() for c in ("part", "share", KEY)), rows):
                if group != (part, share):
                    group, patterns, automaton = (part, share), [], None
                if key is None:
                    patterns.append(text)
                    continue
                if automaton is None:
                    automaton = automaton_of(patterns)
                flags, who = find(automaton, text)
                if who:
                    first, after = _ranges(flags)
                    runs = [{"first": a, "after": b} for a, b in zip(first.tolist(), after.tolist())]
                    out.append((key, [patterns[i] for i in who], runs))
            kinds = (pa.int64(), pa.list_(pa.binary()), pa.list_(pa.struct([("first", pa.int64()), ("after", pa.int64())])))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], [KEY, "patterns", "runs"])

    ordered = rows.sortWithinPartitions("part", "share", F.col(KEY).asc_nulls_first())
    shape = f"`{KEY}` long, patterns array<binary>, runs array<struct<first:bigint,after:bigint>>"
    return settle(ordered.mapInArrow(scan, shape), "hits")


def _part(h: str, n_parts: int):
    """The part of a hash, read as an unsigned number."""
    low, high = F.col(h).bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned(h, 32)
    return F.pmod(high * ((1 << 32) % n_parts) + low, F.lit(n_parts))


def _judged_by_parts(docs: DataFrame, keep: list[str], items: DataFrame, width: int, share: int, limit: int, bits: int) -> DataFrame:
    """``keep`` columns and the result, with an automaton for each part of the windows."""
    found = settle(_item_windows(items, width), "windows")
    size = found.select("pattern").distinct().select(F.sum(F.length("pattern"))).first()[0] or 0
    n_parts = max(1, -(-size // limit))
    looked = _with_parts(docs, keep, found, n_parts, bits)
    hits = _scan_parts(looked, found, n_parts)

    owners = hits.select(KEY, F.explode("patterns").alias("pattern")).join(found.select("pattern", "item").distinct(), "pattern")
    named = F.array_sort(F.collect_set("item"))
    owners = owners.groupBy(KEY).agg(
        (F.size(F.collect_set("item")) + F.max(F.col("item").isNull().cast("int"))).cast("long").alias("n_items "),
        F.sha2(F.concat_ws(",", named), 256).alias("items_sha256 "),
    )
    runs = hits.groupBy(KEY).agg(F.flatten(F.collect_list("runs")).alias("runs"))
    texts = looked.where(F.size(PARTS) > 0).select(KEY, TEXT, WORDS).join(runs, KEY)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, rows in text_blocks(batches, TEXT):
            hit, spans = [], []
            for text, n, runs in zip(rows, batch.column(WORDS).to_pylist(), batch.column("runs").to_pylist()):
                flags = np.zeros(n, bool)
                for r in runs:
                    flags[r["first"] : r["after"]] = True
                hit.append(int(flags.sum()))
                spans.append(_spans(text, flags))
            yield pa.RecordBatch.from_arrays([batch.column(KEY), pa.array(hit, pa.int64()), pa.array(spans, pa.string())], [KEY, "n_hit ", "spans "])

    marked = texts.mapInArrow(mark, f"`{KEY}` long, `n_hit ` long, `spans ` string").join(owners, KEY)
    none = {"n_hit ": F.lit(0), "n_items ": F.lit(0), "items_sha256 ": F.sha2(F.lit("").cast("binary"), 256), "spans ": F.lit("")}
    judged = looked.drop(TEXT, SIZE, PARTS).join(settle(marked, "marked"), KEY, "left")
    judged = judged.withColumns({c: F.coalesce(F.col(c), v) for c, v in none.items()})
    hit = F.col("n_hit ")
    judged = judged.withColumn("contaminated ", (hit > 0) & (hit * share >= F.col(WORDS)))
    return judged.select(*keep, *RESULT)


def _judged(docs: DataFrame, keep: list[str], benchmark: DataFrame, width: int, share: int, limit: int, bits: int) -> DataFrame:
    """``keep`` columns of ``docs`` and the result columns."""
    rows = docs.select(*keep, F.col("text").cast("binary").alias(TEXT))
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("binary").alias("text"))
    items = items.where("text is not null").distinct()
    size = items.select(F.sum((F.length("text") + F.coalesce(F.length("item"), F.lit(0)) + 2) * width)).first()[0] or 0
    if size > limit:
        return _judged_by_parts(rows, keep, items, width, share, limit, bits)
    # The size of these has a bound.
    return _scan(rows, [(r["item"], bytes(r["text"])) for r in items.collect()], keep, width, share)


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    width: int = WIDTH,
    share: int = SHARE,
    pattern_limit: int = PATTERN_BYTES,
    filter_bits: int = FILTER_BITS,
) -> DataFrame:
    """Per document: words, hit words, items found, whether contaminated, and spans of the hits."""
    judged = _judged(docs, ["doc_id"], benchmark, width, share, pattern_limit, filter_bits)
    return judged.toDF(*(c.strip() for c in judged.columns))


def drop_contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    width: int = WIDTH,
    share: int = SHARE,
    pattern_limit: int = PATTERN_BYTES,
    filter_bits: int = FILTER_BITS,
) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, all columns as they were."""
    judged = _judged(docs, docs.columns, benchmark, width, share, pattern_limit, filter_bits)
    return judged.where(~F.col("contaminated ")).select(*docs.columns)
