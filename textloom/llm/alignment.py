"""Alignment of the tokens of two tokenizers by merge-path partitioning.

A text with a space before it is cut by both tokenizers, A (byte-level pairs) and B (word
pieces with a mark for spaces), into the same bytes. Where a token of A and one of B end
together, the two are linked and a group of tokens closes.

1. A block of texts is cut before single spaces, where neither tokenizer joins anything, and each
   distinct part is encoded once. Parts' tokens are verified to be the text's bytes.
2. The ends of A's and of B's tokens are two ascending arrays for the whole block. Binary searches
   along diagonals cut their merging into pieces of equal work; each piece finds its own common
   ends, and ends that a cut has parted are stitched where two pieces meet.
3. The ids of the links are written, once for each link. Linked pairs are counted over the corpus:
   partial counts in the tasks, sums by Spark. The most frequent pairs, a bounded number, are sent to
   all tasks; links of other pairs join the table of counts, once per document and pair. Texts are
   read once and never shuffled.

Texts that are null, empty, or not the same bytes in the tokens of both have no tokens: all counts
are 0 and the digest is the empty string. Rows that repeat and rows without doc_id are aligned and
counted each; other columns are ignored. Texts are never cut, whatever their length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.arrays import text_blocks
from textloom.llm.ppm import _find, _lowest_class
from textloom.llm.ragged import Tally, distinct_pieces, gather, sums
from textloom.sources.scratch import settle

WORK = 1 << 16  # ends in a piece of the merge path
CACHE_PARTS = 250_000
CACHE_TOKENS = 1 << 22
GROUP = 2_000
HOT_PAIRS = 1 << 19
HELD_PAIRS = 1 << 20
KEPT = ("row", "doc_id", "n_a", "n_b", "n_links", "groups_sha256")
SPACE = 0x20
MARK = "▁"  # fixed value: B's sign for a space

# First bytes of characters that are surely no white space.
SAFE = np.zeros(256, bool)
SAFE[0x21:0x7F] = SAFE[0xC3:0xF5] = True
SAFE[[0xE1, 0xE2, 0xE3]] = False


def diagonals(a: np.ndarray, b: np.ndarray, work: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the merge path of two ascending arrays (equal ones: first a) crosses each ``work``-th diagonal."""
    at = np.append(np.arange(0, len(a) + len(b), work), len(a) + len(b))
    low, high = np.maximum(0, at - len(b)), np.minimum(at, len(a))
    while (searching := np.flatnonzero(low < high)).size:
        middle = (low[searching] + high[searching]) // 2
        first_a = a[middle] <= b[at[searching] - 1 - middle]
        low[searching] = np.where(first_a, middle + 1, low[searching])
        high[searching] = np.where(first_a, high[searching], middle)
    return low, at - low


def common_ends(a: np.ndarray, b: np.ndarray, work: int = WORK) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of all a[i] == b[j] of two strictly ascending arrays, piece by piece of their merge path."""
    rows, columns = diagonals(a, b, work)
    found_a, found_b = [], []
    for i0, i1, j0, j1 in zip(rows[:-1], rows[1:], columns[:-1], columns[1:]):
        if i0 and j0 < len(b) and a[i0 - 1] == b[j0]:  # parted by the cut
            found_a.append(np.array([i0 - 1]))
            found_b.append(np.array([j0]))
        if i0 == i1 or j0 == j1:
            continue
        own = b[j0:j1]
        at = np.minimum(np.searchsorted(own, a[i0:i1]), len(own) - 1)
        met = np.flatnonzero(own[at] == a[i0:i1])
        found_a.append(met + i0)
        found_b.append(at[met] + j0)
    none = np.empty(0, np.int64)
    return np.concatenate([none, *found_a]), np.concatenate([none, *found_b])


class Grown:
    """An array that grows at its end."""

    def __init__(self, kind: type):
        self.held, self.size = np.empty(1024, kind), 0

    def add(self, values: np.ndarray | list) -> None:
        while self.size + len(values) > len(self.held):
            self.held = np.concatenate((self.held, np.empty_like(self.held)))
        self.held[self.size : self.size + len(values)] = values
        self.size += len(values)


class Parts:
    """Tokens of distinct parts by one tokenizer: ids in one array, and whether they are the part's bytes."""

    def __init__(self):
        self.ids, self.first, self.count, self.same = Grown(np.int32), Grown(np.int64), Grown(np.int32), Grown(bool)

    def add(self, ids: np.ndarray, counts: np.ndarray, same: np.ndarray) -> None:
        self.first.add(self.ids.size + np.cumsum(counts) - counts)
        self.ids.add(ids)
        self.count.add(counts)
        self.same.add(same)


class Tokenizers:
    """Both tokenizers, the bytes and decimal names of their ids, and a cache of bounded size."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        from textloom.llm.token_counts import byte_symbols

        tokenizer = Tokenizer.from_file(a_path)
        tokenizer.encode_special_tokens = True
        vocabulary = tokenizer.get_vocab()
        byte = {c: b for b, c in enumerate(byte_symbols())}
        a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            a_bytes[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        pieces = sentencepiece.SentencePieceProcessor(model_file=b_path)
        names = [pieces.id_to_piece(i) for i in range(pieces.vocab_size())]
        if any(MARK in n.lstrip(MARK) for n in names):
            raise ValueError("a piece holds a space after other signs, so texts cannot be cut at spaces")
        b_bytes = [bytes([int(n[3:5], 16)]) if pieces.is_byte(i) else n.replace(MARK, " ").encode() for i, n in enumerate(names)]
        self.encode = [lambda t: tokenizer.encode(t, add_special_tokens=False).ids, lambda t: pieces.encode(t[1:])]
        self.bytes = [a_bytes, b_bytes]
        self.kinds = [np.uint16 if len(x) <= 1 << 16 else np.uint32 for x in self.bytes]
        self.lengths = [np.fromiter(map(len, x), np.int64, len(x)) for x in self.bytes]
        # The decimal of each id, as it stands inside a group and at the end of its side.
        self.names = [
            np.array([b"%d%c" % (i, c) for c in ends for i in range(len(x))], object) for x, ends in zip(self.bytes, (b",|", b",;"))
        ]
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.parts = [Parts(), Parts()]

    def _one(self, side: int, part: bytes) -> tuple[list[int], bool]:
        ids = self.encode[side](part.decode("utf-8", "replace"))
        return ids, b"".join(map(self.bytes[side].__getitem__, ids)) == part

    def _learn_group(self, side: int, group: list[bytes]) -> None:
        """Encode all parts as one text; one by one if the tokens do not end with the parts."""
        ids, same = self._one(side, b"".join(group))
        ids = np.array(ids, np.int64)
        ends = np.cumsum(self.lengths[side][ids])
        wanted = np.cumsum([len(p) for p in group])
        cuts = np.searchsorted(ends, wanted)
        if same and (ends[np.minimum(cuts, len(ends) - 1)] == wanted).all():
            self.parts[side].add(ids, np.diff(cuts + 1, prepend=0), np.ones(len(group), bool))
            return
        for part in group:
            ids, same = self._one(side, part)
            self.parts[side].add(ids, np.array([len(ids)]), np.array([same]))

    def learn(self, new: list[bytes]) -> None:
        joins = [len(p) > 1 and SAFE[p[1]] and p[-1] != SPACE and len(p) < GROUP for p in new]
        together = [p for p, j in zip(new, joins) if j]
        groups = [together[i : i + GROUP] for i in range(0, len(together), GROUP)] + [[p] for p, j in zip(new, joins) if not j]
        for group in groups:
            self.known.update(zip(group, range(len(self.known), len(self.known) + len(group))))
            for side in (0, 1):
                self._learn_group(side, group)

    def codes(self, distinct: list[bytes]) -> np.ndarray:
        """Numbers of the parts in the cache."""
        if len(self.known) > CACHE_PARTS or self.parts[0].ids.size > CACHE_TOKENS:
            self.clear()
        new = [p for p in distinct if p not in self.known]
        if new:
            self.learn(new)
        return np.fromiter(map(self.known.__getitem__, distinct), np.int64, len(distinct))


class Aligned:
    """The tokens of a block of texts and their links.

    ``ids[side]``: token ids in a row; ``first[side]``: of each text its first token, with the number
    of tokens at the end; ``links[side]``: places of the linked tokens; ``first_link``: the same for links.
    """

    def __init__(self, tokenizers: Tokenizers, texts: list[bytes], work: int = WORK):
        spaced = [b" " + t if t else t for t in texts]
        raw = b"".join(spaced)
        lengths = np.fromiter(map(len, spaced), np.int64, len(spaced))
        data = np.frombuffer(raw, np.uint8)
        cut = np.zeros(len(data), bool)
        cut[1:-1] = (data[1:-1] == SPACE) & (data[:-2] != SPACE) & SAFE[data[2:]]
        opens = np.cumsum(lengths) - lengths
        cut[opens[lengths > 0]] = True
        starts = np.flatnonzero(cut)
        if len(starts):
            codes, distinct = distinct_pieces(data, starts)
            codes = tokenizers.codes(distinct)[codes]
        else:
            codes = np.empty(0, np.int64)
        first_part = np.append(np.searchsorted(starts, opens), len(starts))
        same = tokenizers.parts[0].same.held[codes] & tokenizers.parts[1].same.held[codes]
        good = sums(~same, first_part) == 0
        for i in np.flatnonzero(~good):
            # Parts that differ may still make the same text together.
            own = codes[first_part[i] : first_part[i + 1]]
            good[i] = all(self._joined(tokenizers, side, own) == spaced[i] for side in (0, 1))
        keep = np.repeat(good, np.diff(first_part))
        codes, first_part = codes[keep], np.concatenate(([0], np.cumsum(np.diff(first_part) * good)))
        self.ids, self.first, self.links, ends = [], [], [], []
        for side in (0, 1):
            parts = tokenizers.parts[side]
            counts = parts.count.held[codes].astype(np.int64)
            self.ids.append(parts.ids.held[gather(parts.first.held[codes], counts)])
            self.first.append(np.concatenate(([0], np.cumsum(counts)))[first_part])
            ends.append(np.cumsum(tokenizers.lengths[side][self.ids[-1]]))
        self.links = common_ends(*ends, work)
        self.first_link = np.searchsorted(self.links[0], self.first[0])

    @staticmethod
    def _joined(tokenizers: Tokenizers, side: int, codes: np.ndarray) -> bytes:
        parts = tokenizers.parts[side]
        ids = parts.ids.held[gather(parts.first.held[codes], parts.count.held[codes].astype(np.int64))]
        return b"".join(map(tokenizers.bytes[side].__getitem__, ids.tolist()))

    def digests(self, tokenizers: Tokenizers) -> list[str]:
        """sha256 of each text's groups as decimal ids; '' for a text without tokens."""
        in_group = [np.diff(self.links[s], prepend=-1) for s in (0, 1)]
        before = [np.cumsum(n) - n for n in in_group]
        places = (
            np.arange(len(self.ids[0])) + np.repeat(before[1], in_group[0]),
            np.arange(len(self.ids[1])) + np.repeat(before[0] + in_group[0], in_group[1]),
        )
        named = np.empty(len(places[0]) + len(places[1]), object)
        for side in (0, 1):
            last = np.zeros(len(self.ids[side]), np.int64)
            last[self.links[side]] = len(tokenizers.bytes[side])
            named[places[side]] = tokenizers.names[side][self.ids[side] + last]
        first = (self.first[0] + self.first[1]).tolist()
        return [hashlib.sha256(b"".join(named[a:b].tolist())[:-1]).hexdigest() if b > a else "" for a, b in zip(first[:-1], first[1:])]


def list_array(first: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(values, kind))


class _Blocks:
    """The aligned blocks of a task; the tokenizers stay with the worker."""

    def __init__(self, docs: DataFrame, a_path: str, b_path: str):
        # A Python worker keeps a broadcast's value between its tasks, and so the caches, which have a bound.
        self.process = docs.sparkSession.sparkContext.broadcast({})
        self.paths = (a_path, b_path)

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Tokenizers, Aligned]]:
        if "tokenizers" not in self.process.value:
            self.process.value["tokenizers"] = Tokenizers(*self.paths)
        tokenizers = self.process.value["tokenizers"]
        for batch, rows in text_blocks(batches):
            yield batch, tokenizers, Aligned(tokenizers, rows)


def alignments(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(doc_id, a_ids, b_ids, a_last, b_last): token ids, and for each group the place of its last token on each side."""
    blocks = _Blocks(docs, a_path, b_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, block in blocks(batches):
            columns = [list_array(block.first[s], block.ids[s], pa.int32()) for s in (0, 1)]
            for s in (0, 1):
                own = block.links[s] - np.repeat(block.first[s][:-1], np.diff(block.first_link))
                columns.append(list_array(block.first_link, own, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "a_ids", "b_ids", "a_last", "b_last"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, a_ids array<int>, b_ids array<int>, a_last array<int>, b_last array<int>")


def aligned_texts(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(row, doc_id, n_a, n_b, n_links, groups_sha256, a, b): numbers of tokens and links, digest of the groups, and the ids of each link as bytes."""
    blocks = _Blocks(docs, a_path, b_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 36
        for batch, tokenizers, block in blocks(batches):
            n = len(block.first_link) - 1
            counts = [pa.array(np.diff(x)) for x in (*block.first, block.first_link)]
            linked = [packed(block.first_link, block.ids[s][block.links[s]].astype(tokenizers.kinds[s])) for s in (0, 1)]
            digests = pa.array(block.digests(tokenizers), pa.string())
            columns = [pa.array(row + np.arange(n)), batch.column("doc_id"), *counts, digests, *linked]
            yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "n_a", "n_b", "n_links", "groups_sha256", "a", "b"])
            row += n

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, f"row long, doc_id {kind}, n_a long, n_b long, n_links long, groups_sha256 string, a binary, b binary")


def packed(first: np.ndarray, values: np.ndarray) -> pa.Array:
    """The runs values[first[i]:first[i + 1]] as bytes."""
    offsets = (first * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(first) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(values.tobytes())])


def unpacked(column: pa.Array, n: int) -> np.ndarray:
    """All ``n`` numbers of a column of packed runs."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    size = int(offsets[-1] - offsets[0])
    kind = np.uint16 if size == 2 * n else np.uint32
    return np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]].copy().view(kind).astype(np.int64)


def linked_pairs(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The two ids of each link in one number, and of each row its first link, with the number of links at the end."""
    first = np.concatenate(([0], np.cumsum(batch.column("n_links").to_numpy())))
    a, b = (unpacked(batch.column(c), int(first[-1])) for c in ("a", "b"))
    return a << 32 | b, first


def slices(batches: Iterator[pa.RecordBatch], most: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """Parts of the batches with about ``most`` links, one row at least."""
    for batch in batches:
        ends = np.cumsum(batch.column("n_links").to_numpy())
        low = before = 0
        while low < batch.num_rows:
            high = max(low + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield batch.slice(low, high - low)
            low, before = high, int(ends[high - 1])


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n, best): links of each pair of ids in the corpus, and whether no other pair of its B id has more."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally()
        for batch in slices(batches):
            tally.add(linked_pairs(batch)[0])
            if len(tally.keys) > HELD_PAIRS:
                yield tally.rows("pair")
        yield tally.rows("pair")

    counts = aligned.select("n_links", "a", "b").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counts = settle(counts.withColumn("b", F.col("pair").bitwiseAND((1 << 32) - 1)), "pair counts")
    most = counts.groupBy("b").agg(F.max("n").alias("most"))  # one row for each id of B's vocabulary at most
    return settle(counts.join(F.broadcast(most), "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "pairs")


def alignment_digest(docs: DataFrame, a_path: str, b_path: str, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """Per document the numbers of tokens, groups and links, the corpus-wide counts of its links, and a digest of its groups."""
    aligned = settle(aligned_texts(docs, a_path, b_path), "aligned")
    pairs = pair_counts(aligned)
    level = _lowest_class(pairs, "n", hot_pairs, 8)
    hot = F.floor(F.log2("n") * 8) >= level
    table = pairs.where(hot).toArrow().sort_by("pair")
    share = docs.sparkSession.sparkContext.broadcast([table.column(c).to_numpy() for c in ("pair", "n", "best")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n, best = share.value
        for batch in slices(batches):
            found, at = linked_pairs(batch)
            place = _find(keys, found)
            known = place >= 0
            weight = np.zeros((2, len(found)), np.int64)
            weight[:, known] = best[place[known]], n[place[known]]
            # The rest once per document and pair.
            owner, rest = np.repeat(np.arange(len(at) - 1), np.diff(at))[~known], found[~known]
            order = np.lexsort((rest, owner))
            owner, rest = owner[order], rest[order]
            new = np.flatnonzero((np.diff(owner, prepend=-1) != 0) | (np.diff(rest, prepend=-1) != 0))
            first, times = np.searchsorted(owner[new], np.arange(len(at))), np.diff(np.append(new, len(rest)))
            lists = [list_array(first, rest[new], pa.int64()), list_array(first, times, pa.int64())]
            numbers = [pa.array(x) for x in (sums(weight[0], at), sums(weight[1], at))]
            columns = [*(batch.column(c) for c in KEPT), *numbers, *lists]
            yield pa.RecordBatch.from_arrays(columns, [*KEPT, "best", "sum", "pair", "times"])

    kinds = "".join(f"{c} {aligned.schema[c].dataType.simpleString()}, " for c in KEPT)
    found = aligned.mapInArrow(run, f"{kinds} best long, sum long, pair array<long>, times array<long>")
    more = [F.lit(0).cast("long").alias(c) for c in ("more_best", "more_sum")]
    others = pairs.where(~hot)
    if others.isEmpty():
        found = found.select("*", *more)
    else:
        found = settle(found, "found")
        rest = found.select("row", F.explode(F.arrays_zip("pair", "times")).alias("r")).select("row", "r.pair", "r.times")
        rest = rest.join(others, "pair").groupBy("row").agg(
            F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum")
        )
        found = found.join(rest, "row", "left")
    return found.select(
        "doc_id", "n_a", "n_b", F.col("n_links").alias("n_groups"), "n_links",
        (F.col("best") + F.coalesce("more_best", F.lit(0))).alias("n_best"),
        (F.col("sum") + F.coalesce("more_sum", F.lit(0))).alias("count_sum"), "groups_sha256",
    )
