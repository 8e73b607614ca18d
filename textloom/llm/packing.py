"""Best-fit packing with dominance reduction over the histogram of lengths.

1. Tasks tokenize whole texts, cut long ones into pieces of ``room`` tokens, and number the
   pieces of each length within the task. The table of pieces holds numbers only.
2. Spark sums the histogram: at most ``room`` rows, whatever the corpus.
3. On the histogram, small sets that provably dominate all others are fixed first: a piece
   that nothing fits beside; a pair that fills a sequence; a pair or triple when no other
   choice of the pieces that still fit can do better. One decision holds for all equal
   lengths at once. The rest is packed best fit, longest first.
4. The plan is a list of ranges (length, ranks) -> (sequences, offset). A piece's rank is its
   number in the task plus the pieces of that length in earlier tasks, so no task sees all
   pieces of a length.

Null texts are empty and have one token, the closing id 0. Repeated rows and doc_ids are
packed each; other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.arrays import SPACES, Words, byte_mask, text_blocks
from textloom.llm.ragged import coded_pieces, gather
from textloom.llm.token_counts import PlainWords
from textloom.sources.scratch import settle

ROOM = 2048
CACHE_WORDS = 250_000
CACHE_RUNS = 800_000
GROUP = 2_000
PARTING_TOKEN = "<|startoftext|>"


class RunTable:
    """Token ids of distinct runs as flat arrays: run i has ids[starts[i]:starts[i + 1]].

    A run takes some 40 bytes; a dict of bytes to bytes takes five times that.
    """

    def __init__(self):
        self.clear()

    def __len__(self) -> int:
        return len(self.keys)

    def clear(self) -> None:
        self.keys, self.ids, self.starts = pa.array([], pa.binary()), np.empty(0, "<u4"), np.zeros(1, np.int64)

    def places(self, runs: pa.Array, learn: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """The place of each of some distinct runs; ``learn`` gives the ids of new ones in a row, and how many each has."""
        found = pc.index_in(runs, value_set=self.keys)
        at = found.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        if found.null_count:
            new = runs.filter(found.is_null())
            ids, counts = learn(new.to_pylist())
            at[at < 0] = len(self.keys) + np.arange(len(new))
            self.keys = pa.concat_arrays([self.keys, new])
            self.starts = np.append(self.starts, len(self.ids) + np.cumsum(counts))
            self.ids = np.append(self.ids, ids)
        return at


class WordTokens:
    """Token ids of texts as bytes, by caches of words and of their parts.

    The tokenizer drops white space, so the ids of a text are those of its words in a row. It
    lower-cases words and cuts them into runs of letters, digits and signs, and the last token
    of each run has a word end. For words of ASCII and common Latin letters the runs are found
    by classes of bytes, so that each run is tokenized once, whatever case and signs it comes with.
    Other words are tokenized whole, many at a time, with a special token between them. The ids of
    a block of texts are then gathered as one array.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.parting = self.tokenizer.token_to_id(PARTING_TOKEN)
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.known: dict[bytes, bytes] = {}
        self.runs = RunTable()

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def _cut(self, into: dict, keys: list, ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        raw = ids.tobytes()
        for k, a, b in zip(keys, (starts * 4).tolist(), (ends * 4).tolist()):
            into[k] = raw[a:b]

    def _run_ids(self, runs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all runs in a row, and how many each has."""
        every, counts = [], []
        for i in range(0, len(runs), GROUP):
            group = runs[i : i + GROUP]
            ids = self._ids(b" ".join(group).decode())
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) == len(group):
                every.append(ids)
                counts.append(np.diff(ends, prepend=0))
            else:
                own = [self._ids(r.decode()) for r in group]
                every += own
                counts.append(np.array([len(x) for x in own], np.int64))
        return np.concatenate(every), np.concatenate(counts)

    def _learn_whole(self, words: list[bytes]) -> None:
        for w in words:
            if b"<|" in w:
                self.known[w] = self._ids(w.decode("utf-8", "replace")).tobytes()
        plain = [w for w in words if b"<|" not in w]
        for i in range(0, len(plain), GROUP):
            group = plain[i : i + GROUP]
            ids = self._ids(f" {PARTING_TOKEN} ".join(w.decode("utf-8", "replace") for w in group))
            cuts = np.flatnonzero(ids == self.parting)
            self._cut(self.known, group, ids, np.append(0, cuts + 1), np.append(cuts, len(ids)))

    def texts(self, rows: list[bytes]) -> list[bytes]:
        words = Words(rows, None, byte_mask(SPACES))
        if not len(words):
            return [b""] * len(rows)
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        if len(self.runs) > CACHE_RUNS:
            self.runs.clear()
        plain = PlainWords(words)
        codes, runs = coded_pieces(plain.data, plain.offsets) if len(plain.starts) else (np.empty(0, np.int64), pa.array([], pa.binary()))
        run = self.runs.places(runs, self._run_ids)[codes]
        raw, odd = words.data.tobytes(), plain.odd_words
        whole = [raw[a:b] for a, b in zip(words.starts[odd].tolist(), words.ends[odd].tolist())]
        self._learn_whole(list(set(whole).difference(self.known)))

        # The ids of all known runs, then of each other word; all units in the order of the texts.
        held = [*map(self.known.__getitem__, whole)]
        sizes = np.fromiter(map(len, held), np.int64, len(held)) // 4
        ids = np.append(self.runs.ids, np.frombuffer(b"".join(held), "<u4")) if held else self.runs.ids
        firsts = np.concatenate((self.runs.starts[run], len(self.runs.ids) + np.cumsum(sizes) - sizes))
        counts = np.concatenate((self.runs.starts[run + 1] - self.runs.starts[run], sizes))
        places = np.concatenate((plain.starts, words.starts[odd]))
        order = np.argsort(places, kind="stable")
        places, counts = places[order], counts[order]
        out = ids[gather(firsts[order], counts)].tobytes()
        ends = np.concatenate(([0], np.cumsum(counts)))[np.searchsorted(places, words.text_ends)] * 4
        return [out[a:b] for a, b in zip([0, *ends.tolist()], ends.tolist())]


def pieces(docs: DataFrame, tokenizer: str, room: int = ROOM) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, part, rank): rank among the task's pieces of that length."""

    # A Python worker keeps a broadcast's value between its tasks, and so the caches, which have a bound.
    process = docs.sparkSession.sparkContext.broadcast({})

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if "tokens" not in process.value:
            process.value["tokens"] = WordTokens(tokenizer)
        tokens, part = process.value["tokens"], TaskContext.get().partitionId()
        met = np.zeros(room + 1, np.int64)
        for batch, rows in text_blocks(batches):
            of, piece, start, length, crc, rank = [], [], [], [], [], []
            for i, ids in enumerate(tokens.texts(rows)):
                ids += b"\0\0\0\0"
                for k, at in enumerate(range(0, len(ids), 4 * room)):
                    own = ids[at : at + 4 * room]
                    n = len(own) // 4
                    of.append(i)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(n)
                    crc.append(zlib.crc32(own))
                    rank.append(met[n])
                    met[n] += 1
            numbers = [pa.array(x, t) for x, t in ((piece, pa.int32()), (start, pa.int64()), (length, pa.int64()), (crc, pa.int64()))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(of)), *numbers, pa.array([part] * len(of), pa.int32()), pa.array(rank, pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, part int, rank long")


class Plan:
    """Ranges of equal pieces laid into sequences."""

    def __init__(self, room: int, counts: dict[int, int]):
        self.room = room
        self.left = {w: n for w, n in counts.items() if n > 0}
        self.taken = dict.fromkeys(self.left, 0)
        self.sequences = 0
        self.ranges: list[tuple[int, int, int, int, int]] = []  # length, first rank, rank after, first sequence, offset

    def lay(self, w: int, n: int, sequence: int, offset: int) -> None:
        self.ranges.append((w, self.taken[w], self.taken[w] + n, sequence, offset))
        self.taken[w] += n
        self.left[w] -= n
        if not self.left[w]:
            del self.left[w]

    def fix(self, group: tuple[int, ...], times: int) -> None:
        """The same set of lengths in ``times`` new sequences."""
        offset = 0
        for w in group:
            self.lay(w, times, self.sequences, offset)
            offset += w
        self.sequences += times


def _three_least(sizes: list[int], left: dict[int, int], above: int = 0) -> list[int]:
    """The three smallest pieces longer than ``above``, fewer if there are not so many."""
    out: list[int] = []
    for w in sizes[bisect_left(sizes, above + 1) :]:
        out += [w] * min(left[w], 3 - len(out))
        if len(out) == 3:
            break
    return out


def dominant_set(w: int, room: int, left: dict[int, int]) -> tuple[int, ...] | None:
    """A set with ``w`` that dominates every other set with ``w``, when a simple test proves it.

    A set dominates another if the other's pieces can be grouped so that each group fits in
    the place of one piece of the set.
    """
    gap = room - w
    rest = dict(left)
    rest[w] -= 1
    sizes = sorted(x for x, n in rest.items() if n and x <= gap)
    if not sizes:
        return (w,)
    first = sizes[-1]
    if first == gap:
        return (w, first)
    least = _three_least(sizes, rest)
    if sum(least[:2]) > gap or len(least) < 2:
        return (w, first)
    if len(least) == 3 and sum(least) <= gap:
        return None
    rest[first] -= 1
    second = max((x for x in sizes if rest[x] and x <= gap - first), default=0)
    rest[first] += 1
    if not second:
        return None
    above = _three_least(sizes, rest, second)[:2]
    return (w, first, second) if len(above) < 2 or sum(above) > gap else None


def reduce_by_dominance(plan: Plan) -> None:
    changed = True
    while changed:
        changed = False
        for w in sorted(plan.left, reverse=True):
            while w in plan.left and (group := dominant_set(w, plan.room, plan.left)):
                times = min(plan.left[x] // group.count(x) for x in group)
                plan.fix(group, times)
                changed = True


def best_fit(plan: Plan) -> None:
    """Longest first, each into the fullest open sequence that still takes it."""
    opened: dict[int, list[tuple[int, int]]] = {}  # by room left: (first sequence, how many)
    rooms: list[int] = []

    def put(room: int, sequence: int, n: int) -> None:
        if n and room:
            if room not in opened:
                opened[room] = []
                insort(rooms, room)
            opened[room].append((sequence, n))

    for w in sorted(plan.left, reverse=True):
        while w in plan.left:
            n, at = plan.left[w], bisect_left(rooms, w)
            if at < len(rooms):
                room = rooms[at]
                sequence, many = opened[room].pop()
                if not opened[room]:
                    del opened[room], rooms[at]
            else:
                room, sequence, many = plan.room, plan.sequences, -(-n // (plan.room // w))
                plan.sequences += many
            each = room // w
            full = min(many, n // each)
            for j in range(each if full else 0):
                plan.lay(w, full, sequence, plan.room - room + j * w)
            put(room - each * w, sequence, full)
            rest = n - full * each
            if full < many and rest:
                for j in range(rest):
                    plan.lay(w, 1, sequence + full, plan.room - room + j * w)
                put(room - rest * w, sequence + full, 1)
                full += 1
            put(room, sequence + full, many - full)


def plan_packing(counts: dict[int, int], room: int = ROOM) -> Plan:
    plan = Plan(room, counts)
    reduce_by_dominance(plan)
    best_fit(plan)
    return plan


def pack(docs: DataFrame, tokenizer: str, room: int = ROOM) -> DataFrame:
    """One row per piece with its sequence and its offset there."""
    spark = docs.sparkSession
    rows = settle(pieces(docs, tokenizer, room), "pieces")
    counts = settle(rows.groupBy("part", "length").count(), "counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    plan = plan_packing(histogram, room)
    names = ["length", "low", "high", "sequence", "offset"]
    table = pa.table({n: pa.array([r[i] for r in plan.ranges], pa.int64()) for i, n in enumerate(names)})
    ranges = spark.createDataFrame(table)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    earlier = counts.select("part", "length", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("earlier"))
    ranked = rows.join(earlier, ["part", "length"]).withColumn("rank", F.col("rank") + F.col("earlier"))
    # The ranges come from a histogram of ``room`` lengths, so their number has a bound.
    placed = ranked.join(F.broadcast(ranges), "length").where("rank >= low and rank < high")
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("sequence") + F.col("rank") - F.col("low")).alias("sequence_id"), "offset"
    )
