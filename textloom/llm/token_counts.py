"""Token counts by rank-synchronous merging of arrays.

Tasks cut a block of texts into pre-tokens: words of ASCII and common Latin letters by
classes of bytes, all at once; other words, and words with special strings, by the
vocabulary's own normalizer and word pattern, each distinct word once. The pre-tokens that
a batch has for the first time are held as one ragged array of symbols. In each round every
sequence finds its pair of lowest rank, all sequences merge all places of their pair at
once, and those without a pair leave with the number of symbols that survive. A sum over
the words of each text gives its count. Only narrow stages; no text is shuffled.

Counts are those of the library, with its special strings inside texts as one token each.
Null and empty texts have no bytes and no tokens. Rows are counted each, also repeated ones
and those without doc_id; other columns are ignored. Texts are never cut, whatever their length.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.arrays import SPACES, Words, byte_mask, text_blocks
from textloom.llm.ragged import distinct_pieces, gather, sums

LIMIT = 2048
CACHE_WORDS = 400_000
GROUP = 4_000
LONG = 4_096  # symbols above which a sequence is merged by a queue of ranks
NONE = np.int64(1) << 40

# The word pattern that the classes below stand for, and its endings after an apostrophe.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
SPACE, LETTER, DIGIT, SIGN, ODD = range(5)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself, or one of those from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class MergeTable:
    """The merges of a byte-level vocabulary file as sorted arrays."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocabulary, suffix = spec["model"]["vocab"], spec["model"].get("end_of_word_suffix") or ""
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        left, right, made = (
            np.array([vocabulary[x] for x in column], np.int64)
            for column in ([a for a, _ in merges], [b for _, b in merges], [a + b for a, b in merges])
        )
        born = np.full(max(vocabulary.values()) + 1, -1, np.int64)
        born[made] = np.arange(len(merges))
        if len(np.unique(made)) < len(made) or (np.maximum(born[left], born[right]) >= np.arange(len(merges))).any():
            raise ValueError("a merge comes before its parts, so places of one pair cannot be merged at once")
        keys = left << 32 | right
        order = np.argsort(keys)
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made[order]
        self.inner = np.array([vocabulary[c] for c in byte_symbols()], np.int64)
        self.last = np.array([vocabulary[c + suffix] for c in byte_symbols()], np.int64)
        self.back = str.maketrans({c: chr(b) for b, c in enumerate(byte_symbols())})
        self.tokenizer = Tokenizer.from_file(path)
        cutters = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        self.pattern = cutters[0].get("pattern", {}).get("Regex")
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True))) or "(?!)")

    def pairs(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair (NONE where it is not merged) and its place in the table."""
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE), at

    def survivors(self, symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """How many symbols of each sequence are left when nothing can be merged."""
        left = lengths.astype(np.int64)
        first = np.cumsum(left) - left
        long = np.flatnonzero(left > LONG)
        for i in long:
            left[i] = self._queue(symbols[first[i] : first[i] + left[i]])
        short = np.flatnonzero((lengths <= LONG) & (lengths > 1))
        symbols, own = symbols[gather(first[short], lengths[short])], np.repeat(short, lengths[short])
        while len(symbols):
            ranks, at = self.pairs(symbols[:-1], symbols[1:])
            ranks = np.append(np.where(own[1:] == own[:-1], ranks, NONE), NONE)
            edge = np.append(True, own[1:] != own[:-1])
            starts, row = np.flatnonzero(edge), np.cumsum(edge) - 1
            least = np.minimum.reduceat(ranks, starts)
            hit = np.flatnonzero((ranks == least[row]) & (ranks < NONE))
            # Places of a pair of equal symbols may overlap: of a run of such places, every other one merges.
            run = np.append(True, np.diff(hit) > 1)[: len(hit)]
            hit = hit[(np.arange(len(hit)) - np.flatnonzero(run)[np.cumsum(run) - 1]) % 2 == 0]
            symbols[hit] = self.made[at[hit]]
            keep = np.repeat(least < NONE, np.diff(np.append(starts, len(own))))
            keep[hit + 1] = False
            np.subtract.at(left, own[hit], 1)
            symbols, own = symbols[keep], own[keep]
        return left

    def _queue(self, symbols: np.ndarray) -> int:
        """The same for one long sequence: ranks from a heap, each with all its places."""
        ranks, _ = self.pairs(symbols[:-1], symbols[1:])
        order = np.argsort(self.ranks)
        made, keys = self.made[order], self.keys[order]
        sym, n = symbols.tolist(), len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        known = dict(zip(self.keys.tolist(), self.ranks.tolist()))
        places: dict[int, list[int]] = {}
        for i in np.flatnonzero(ranks < NONE).tolist():
            places.setdefault(int(ranks[i]), []).append(i)
        heap = list(places)
        heapq.heapify(heap)
        left = n

        def note(i: int) -> None:
            rank = known.get(sym[i] << 32 | sym[after[i]])
            if rank is not None:
                if rank not in places:
                    places[rank] = []
                    heapq.heappush(heap, rank)
                places[rank].append(i)

        while heap:
            rank = heapq.heappop(heap)
            key, new = int(keys[rank]), int(made[rank])
            for i in sorted(places.pop(rank)):
                j = after[i]
                if j >= n or sym[i] << 32 | sym[j] != key:
                    continue
                sym[i], sym[j], after[i] = new, -1, after[j]
                left -= 1
                if after[i] < n:
                    before[after[i]] = i
                    note(i)
                if before[i] >= 0:
                    note(before[i])
        return left


def byte_classes() -> np.ndarray:
    """Class of each byte; the lead byte of common Latin letters is a letter, all others beyond ASCII are odd."""
    of = np.full(256, ODD, np.int8)
    of[33:127] = SIGN
    of[48:58] = DIGIT
    of[65:91] = of[97:123] = of[0xC3] = LETTER
    of[list(SPACES)] = SPACE
    of[ord("<")] = ODD  # may open a special string
    return of


class PlainWords:
    """Pre-tokens of the plain words of a block, and the words that are left for the library."""

    classes = byte_classes()

    def __init__(self, words: Words):
        data = words.data.copy()
        kind = self.classes[data]
        lead = np.flatnonzero(data[:-1] == 0xC3)
        second = data[lead + 1]
        sign = (second == 0x97) | (second == 0xB7)
        kind[lead + 1] = np.where(sign, ODD, LETTER)
        upper = lead[(second < 0x9F) & ~sign] + 1
        data[upper] += 0x20
        data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
        odd = np.concatenate(([0], np.cumsum(kind == ODD)))
        self.odd_words = np.flatnonzero(odd[words.ends] > odd[words.starts])
        for a, b in zip(words.starts[self.odd_words].tolist(), words.ends[self.odd_words].tolist()):
            kind[a:b] = SPACE
        before = np.append(np.int8(SPACE), kind[:-1])
        start = (kind != SPACE) & ((kind != before) | (kind == DIGIT))
        lone = np.flatnonzero((data[:-1] == ord("'")) & (before[:-1] != SIGN) & (kind[1:] == LETTER) & (kind[:-1] == SIGN))
        padded = np.append(data, np.zeros(2, np.uint8))
        taken = np.zeros(len(lone), bool)
        for ending in ENDINGS:
            fits = ~taken
            for k, c in enumerate(ending.encode()):
                fits &= padded[lone + 1 + k] == c
            at = lone[fits]
            start[at + 1] = False
            after = at + 1 + len(ending)
            start[after[kind[after] != SPACE]] = True
            taken |= fits
        inside = kind != SPACE
        self.starts = np.flatnonzero(start)
        self.data = data[inside]
        self.offsets = (np.cumsum(inside) - 1)[self.starts]


class Counter:
    """Tokens of texts, with caches of bounded size for pre-tokens and odd words."""

    def __init__(self, path: str):
        self.table = MergeTable(path)
        self.pre_tokens: dict[bytes, int] = {}
        self.words: dict[bytes, int] = {}
        self.plain = self.table.pattern == WORD_PATTERN

    def _learn_pre_tokens(self, new: list[bytes]) -> None:
        """Merge pre-tokens given as bytes."""
        if len(self.pre_tokens) > CACHE_WORDS:
            self.pre_tokens.clear()
        new = [t for t in new if t not in self.pre_tokens]
        if not new:
            return
        lengths = np.fromiter(map(len, new), np.int64, len(new))
        raw = np.frombuffer(b"".join(new), np.uint8)
        symbols = self.table.inner[raw]
        ends = np.cumsum(lengths) - 1
        symbols[ends] = self.table.last[raw[ends]]
        self.pre_tokens.update(zip(new, self.table.survivors(symbols, lengths).tolist()))

    def _cut(self, words: list[str]) -> list[tuple[int, str]]:
        """(number of the word, pre-token) in any order, by the library."""
        tokenizer = self.table.tokenizer
        joined = tokenizer.normalizer.normalize_str(" ".join(words)) if tokenizer.normalizer else " ".join(words)
        if joined.count(" ") != len(words) - 1:
            # Some word holds white space that is not ASCII.
            if len(words) == 1:
                return [(0, t) for t, _ in tokenizer.pre_tokenizer.pre_tokenize_str(joined)]
            return [(i, t) for i, w in enumerate(words) for _, t in self._cut([w])]
        found = tokenizer.pre_tokenizer.pre_tokenize_str(joined)
        ends = np.cumsum([len(w) + 1 for w in joined.split(" ")])
        of = np.searchsorted(ends, [a for _, (a, _) in found], side="right").tolist()
        return list(zip(of, (t for t, _ in found)))

    def _learn_words(self, words: list[bytes]) -> None:
        counts = np.zeros(len(words), np.int64)
        parts, owner = [], []
        for i, w in enumerate(words):
            text = w.decode("utf-8", "replace")
            counts[i] += len(self.table.special.findall(text))
            cut = [t for t in self.table.special.split(text) if t]
            parts += cut
            owner += [i] * len(cut)
        found: list[tuple[int, bytes]] = []
        back = self.table.back
        for i in range(0, len(parts), GROUP):
            found += [(owner[i + j], t.translate(back).encode("latin-1")) for j, t in self._cut(parts[i : i + GROUP])]
        self._learn_pre_tokens(list({t for _, t in found}))
        for i, t in found:
            counts[i] += self.pre_tokens[t]
        self.words.update(zip(words, counts.tolist()))

    def _odd_words(self, words: list[bytes]) -> np.ndarray:
        if len(self.words) > CACHE_WORDS:
            self.words.clear()
        missing = list(set(words).difference(self.words))
        if missing:
            self._learn_words(missing)
        return np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))

    def texts(self, rows: list[bytes]) -> np.ndarray:
        words = Words(rows, None, byte_mask(SPACES))
        total = np.zeros(len(rows), np.int64)
        if not len(words):
            return total
        if self.plain:
            plain = PlainWords(words)
            odd = plain.odd_words
            if len(plain.starts):
                codes, distinct = distinct_pieces(plain.data, plain.offsets)
                self._learn_pre_tokens(distinct)
                counts = np.fromiter(map(self.pre_tokens.__getitem__, distinct), np.int64, len(distinct))
                total += sums(counts[codes], np.concatenate(([0], np.searchsorted(plain.starts, words.text_ends))))
        else:
            odd = np.arange(len(words))
        raw = words.data.tobytes()
        found = [raw[a:b] for a, b in zip(words.starts[odd].tolist(), words.ends[odd].tolist())]
        if found:
            total += sums(self._odd_words(found), np.searchsorted(odd, words.first))
        return total


def token_counts(docs: DataFrame, tokenizer: str, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row, for a byte-level vocabulary file whose words never hold white space."""
    # A Python worker keeps a broadcast's value between its tasks, and so the caches, which have a bound.
    process = docs.sparkSession.sparkContext.broadcast({})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if "counter" not in process.value:
            process.value["counter"] = Counter(tokenizer)
        counter = process.value["counter"]
        for batch, rows in text_blocks(batches):
            counts = counter.texts(rows)
            sizes = np.fromiter(map(len, rows), np.int64, len(rows))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes), pa.array(counts), pa.array(counts > limit)],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
